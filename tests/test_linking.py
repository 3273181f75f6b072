import pytest

from sigspark.config import Dictionary
from sigspark.operators.linking import link_entities, unlink_generic_terms

SCHEMA = "id int, text string, ticker_hint string, ticker_hints array<string>, source string"

# text, hint, source -> linked, primary, type, n, other cashtags
CASES = [
    ("My aunt bakes an apple tart every sunday", None, "newsapi", [], None, None, 0, []),
    ("Apple presents the next iPhone", None, "newsapi", ["AAPL"], "AAPL", "company_name", 1, []),
    ("The film got a PG-13 rating", None, "newsapi", [], None, None, 0, []),
    ("$PG margins widen again", None, "twitter", ["PG"], "PG", "cashtag", 1, []),
    ("Procter & Gamble lifts detergent prices", None, "newsapi", ["PG"], "PG", "company_name", 1, []),
    ("Meta Platforms trims its workforce", None, "newsapi", ["META"], "META", "company_name", 1, []),
    ("The essay is meta about writing", None, "newsapi", [], None, None, 0, []),
    ("A KO in the second round stunned the arena", None, "newsapi", [], None, None, 0, []),
    ("The COST of rent keeps rising", None, "newsapi", [], None, None, 0, []),
    ("Amazon forest fires spread after drought", None, "newsapi", [], None, None, 0, []),
    ("AWS downtime hurts Amazon customers", None, "newsapi", ["AMZN"], "AMZN", "company_name", 1, []),
    ("Pupils built a Tesla coil at school", None, "newsapi", [], None, None, 0, []),
    ("Inspectors ground the 787 fleet", None, "newsapi", ["BA"], "BA", "product_or_exec", 1, []),
    ("The Fed lifts interest rates, S&P 500 drops", None, "newsapi", ["MARKET"], "MARKET", "company_name", 0, []),
    ("$MSFT $AMZN $SNOW $GOOGL $ORCL", "PG", "twitter", ["AMZN", "GOOGL", "MSFT"], None, "cashtag", 3, ["ORCL", "SNOW"]),
    ("Bezos on patience, see $AMZN", "MSFT", "twitter", ["AMZN"], "AMZN", "cashtag", 1, []),
    ("$FB and $GOOG both fell", "KO", "twitter", ["GOOGL", "META"], "GOOGL", "cashtag", 2, []),
    ("holding $brk.b and $tsla for years", None, "twitter", ["TSLA"], "TSLA", "cashtag", 1, ["BRK.B"]),
    ("$SPY slides all day", None, "twitter", ["MARKET"], "MARKET", "cashtag", 0, []),
    ("$SPY and $AAPL break out", "AAPL", "twitter", ["AAPL", "MARKET"], "AAPL", "cashtag", 1, []),
    ("paid $5bn and $10M and $1.2B and $100 in $USD", None, "twitter", [], None, None, 0, []),
    ("long ETF$VOO $VIG", None, "twitter", [], None, None, 0, ["VOO", "VIG"]),
    ("Nothing to see here today", "KO", "twitter", ["KO"], "KO", "hint_only", 1, []),
    ("Nothing to see here today", "KO", "gdelt", [], None, None, 0, []),
    ("$AAPL beats $MSFT today", "MSFT", "twitter", ["MSFT", "AAPL"], "MSFT", "cashtag", 2, []),
    ("$AAPL up, more $AAPL, while $MSFT lags", "KO", "twitter", ["AAPL", "MSFT"], "AAPL", "cashtag", 2, []),
    ("$MSFT then $AAPL report next week", "KO", "twitter", ["MSFT", "AAPL"], "MSFT", "cashtag", 2, []),
    ("JPM tops NVDA", None, "gdelt", ["JPM", "NVDA"], "JPM", "ticker_symbol", 2, []),
]


@pytest.fixture(scope="module")
def linked(spark):
    rows = [(i, case[0], case[1], None, case[2]) for i, case in enumerate(CASES)]
    return {row["id"]: row for row in link_entities(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("index", range(len(CASES)))
def test_link(linked, index):
    text, hint, source, tickers, primary, kind, n, other = CASES[index]
    row = linked[index]
    assert row["linked_tickers"] == tickers
    assert row["primary_ticker"] == primary
    assert row["link_type"] == kind
    assert row["n_linked_tickers"] == n
    assert row["other_cashtags"] == other
    assert row["is_broadcast"] == (n >= 3)
    assert row["is_relevant"] == bool(tickers)
    weight = round(1 / n, 4) if n else (1.0 if tickers else 0.0)
    assert row["attribution_weight"] == weight


def test_resolved_hint_is_lowest_matching(spark):
    rows = [
        (0, "$MSFT and $PG move", "AMZN", ["PG", "AMZN", "MSFT"], "twitter"),
        (1, "quiet session", "PG", ["PG", "AMZN"], "twitter"),
        (2, "quiet session", None, [], "newsapi"),
    ]
    got = {r["id"]: r["ticker_hint"] for r in link_entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "MSFT", 1: "AMZN", 2: None}


def test_generic_terms_unlink(spark):
    df = spark.createDataFrame(
        [
            (1, "Seat without Windows", "Windows", ["MSFT"], "MSFT", "product_or_exec", ""),
            (2, "Microsoft Windows update", "Windows", ["MSFT"], "MSFT", "product_or_exec", ""),
        ],
        "id int, text string, matched_term string, linked_tickers array<string>, primary_ticker string, link_type string, title string",
    )
    got = {r["id"]: (r["linked_tickers"], r["primary_ticker"], r["link_type"]) for r in unlink_generic_terms(df).collect()}
    assert got[1] == ([], None, None)
    assert got[2] == (["MSFT"], "MSFT", "product_or_exec")


def test_dictionary_is_a_parameter(spark):
    custom = Dictionary.from_mapping({"ACME": {"aliases": ["Acme Tools"], "products": ["Anvil"]}})
    df = spark.createDataFrame([(1, "the new ANVIL ships", None, None, "gdelt")], SCHEMA)
    row = link_entities(df, custom).first()
    assert (row["primary_ticker"], row["matched_term"]) == ("ACME", "ANVIL")


def plan_size(df):
    """Calls and operators in the optimized plan, whatever the length of its literals."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "100000")
    return df._jdf.queryExecution().optimizedPlan().toString().count("(")


def many_companies(n):
    return Dictionary.from_mapping(
        {
            f"T{i}": {
                "aliases": [f"Firm{i}", f"Firm{i} Holdings"], "products": [f"Gadget {i}x"], "executives": [f"Ann Chief{i}"],
                "context_words": ["shares", f"town{i}"], "is_ambiguous": i % 3 == 0,
            }
            for i in range(n)
        }
    )


def test_plan_does_not_grow_with_the_dictionary(spark):
    df = spark.createDataFrame([(1, "Firm7 Holdings and Gadget 900x, $T5", None, None, "gdelt")], SCHEMA)
    small, large = (link_entities(df, many_companies(n)) for n in (21, 1000))
    assert plan_size(large) == plan_size(small)
    assert large.first()["linked_tickers"] == ["T5", "T7", "T900"]


def test_scan_equals_one_pattern_a_company():
    import random
    import re

    from sigspark.operators.linking import DictionaryScan

    dictionary = Dictionary.default()
    companies = [c for c in dictionary.companies if dictionary.synonyms.get(c.ticker, c.ticker) != "MARKET"]
    scan = DictionaryScan(dictionary, companies)
    terms = [t for c in companies for t in (c.ticker, *c.aliases, *c.products, *c.executives, *c.context_words)]
    rng = random.Random(2)
    fill = ["the", "market", "x", "K", "ſ", "é", "interest rates", "S&P 500", "-", ".", "$", "\n"]
    for _ in range(400):
        parts = [rng.choice(rng.choice([terms, fill])) for _ in range(rng.randint(0, 9))]
        text = "".join(rng.choice([p, p.lower(), p.upper()]) + rng.choice([" ", " ", "", ", "]) for p in parts)
        got = {e["ticker"]: e for e in scan.evidence(text, [])["entries"]}
        for company in companies:
            kinds = {"product": company.products + company.executives, "alias": company.aliases, "symbol": ()}
            if company.ticker not in dictionary.wordlike_symbols:
                kinds["symbol"] = (company.ticker,)
            want = {}
            for kind, names in kinds.items():
                found = names and re.search("|".join(rf"\b{re.escape(n)}\b" for n in names), text, 0 if kind == "symbol" else re.IGNORECASE)
                if found:
                    want[kind] = (found.group(), found.start())
            entry = got.get(company.ticker, {})
            assert {k: (entry[k], entry[f"{k}_at"]) for k in kinds if k in entry} == want
            if "alias" in want and company.is_ambiguous:
                assert entry["in_context"] == bool(re.search("|".join(rf"\b{re.escape(n)}\b" for n in company.context_words) or "(?!)", text, re.IGNORECASE))


def test_null_and_empty_texts(spark):
    rows = [(1, None, None, None, "gdelt"), (2, "", None, [], "gdelt"), (3, None, "PG", None, "twitter")]
    got = {r["id"]: r for r in link_entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["linked_tickers"] == got[2]["linked_tickers"] == [] and not got[1]["is_relevant"]
    assert got[3]["linked_tickers"] == ["PG"] and got[3]["link_type"] == "hint_only"
