import pytest

from sigspark.operators.classify import classify_events, matched_rules

# text, source -> event, (low, high) confidence, runner-up, flags that must be true
CASES = [
    ("Takeover bid lifts the payments firm", "newsapi", "Merger/Acquisition", (0.8, 1.0), None, ()),
    ("State sues to block the studio merger", "newsapi", "Merger/Acquisition", (0.8, 1.0), "Regulatory", ()),
    ("Capital hit by new sanctions on Iran banks", "newsapi", "Geopolitical", (0.8, 1.0), None, ()),
    ("Phone maker faces a lawsuit over photos", "gdelt", "Regulatory", (0.8, 1.0), None, ()),
    ("Bank reports earnings on Friday", "newsapi", "Earnings", (0.8, 1.0), None, ()),
    ("Traders await the CPI report", "newsapi", "Macroeconomic", (0.8, 1.0), None, ()),
    ("A robotaxi fleet on the streets", "newsapi", "Product Launch", (0.8, 1.0), None, ()),
    ("Moody's downgrades the plane maker to junk", "newsapi", "Credit Event", (0.8, 1.0), None, ()),
    ("Retailer files for chapter 11 bankruptcy", "newsapi", "Credit Event", (0.8, 1.0), None, ()),
    ("Builder fails to pay its bond coupon payment", "newsapi", "Credit Event", (0.8, 1.0), None, ()),
    ("BARCLAYS downgrades $NFLX and cuts its price target", "twitter_kaggle", "Earnings", (0.8, 1.0), None, ("is_analyst_action",)),
    ("giveaway today, pls retweet $AAPL", "twitter_kaggle", "Other", (0.2, 0.2), None, ("is_template",)),
    ("I think $TSLA will be the largest bankruptcy filing ever", "twitter_kaggle", "Other", (0.2, 0.2), None, ()),
    ("the credit default swap desk is noisy", "twitter_kaggle", "Other", (0.2, 0.2), None, ()),
    ("Pretty sure the merger is next", "twitter_kaggle", "Merger/Acquisition", (0.6, 0.6), None, ()),
    ("Built for national security systems under sanctions", "twitter_kaggle", "Other", (0.2, 0.2), None, ()),
    ("Russia sanctions the founder of $FB", "twitter_kaggle", "Geopolitical", (0.8, 1.0), None, ()),
    ("tariffs again, oh well", "twitter_kaggle", "Geopolitical", (0.6, 0.6), None, ()),
    ("Most Anticipated Releases $AAPL", "twitter_kaggle", "Other", (0.2, 0.2), None, ("is_calendar", "is_template")),
    ("$A $B $C $D $E", "newsapi", "Other", (0.2, 0.2), None, ("is_calendar", "is_template")),
    ("lovely weather for a walk", "twitter_kaggle", "Other", (0.2, 0.2), None, ()),
    ("   ", "twitter_kaggle", "Other", (0.0, 0.0), None, ()),
]


@pytest.fixture(scope="module")
def classified(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "id int, text string, source string")
    return {row["id"]: row for row in classify_events(df).collect()}


@pytest.mark.parametrize("index", range(len(CASES)))
def test_classify(classified, index):
    text, source, event, (low, high), second, flags = CASES[index]
    row = classified[index]
    assert row["event_type"] == event
    assert low <= row["event_confidence"] <= high
    if second:
        assert row["secondary_event"] == second
    for flag in ("is_template", "is_calendar", "is_analyst_action"):
        assert row[flag] == (flag in flags)
    assert ("analyst_action" in row["matched_triggers"]) == row["is_analyst_action"]


def test_score_bonus_and_trigger_order(spark):
    df = spark.createDataFrame([(1, "quarterly earnings: earnings beat, EPS up", "newsapi")], "id int, text string, source string")
    row = classify_events(df).first()
    assert row["event_confidence"] == 1.0
    assert row["matched_triggers"] == ["earnings beat", "quarterly earnings"]
    rules = matched_rules(df, "id").collect()
    assert {(r["event_type"], r["term"]) for r in rules} == {("Earnings", "quarterly earnings"), ("Earnings", "earnings beat")}


def test_external_tags(spark):
    df = spark.createDataFrame(
        [(1, "nothing here", "newsapi", ["CPI"]), (2, "nothing here", "newsapi", None)],
        "id int, text string, source string, macro_tags array<string>",
    )
    got = {r["id"]: (r["event_type"], r["event_confidence"], r["matched_triggers"]) for r in classify_events(df).collect()}
    assert got[1] == ("Macroeconomic", 0.9, ["macro_tag:CPI"])
    assert got[2] == ("Other", 0.2, [])


def test_guard_words_are_necessary():
    """Every string a rule can match holds one of the rule's guard words as a token."""
    import re

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from sigspark import fixed_values as fv
    from sigspark.operators.classify import CALENDAR_PIECES, CALENDAR_WORDS, RULE_WORDS, SPACED_GIVEAWAY, TEMPLATE_WORDS

    cases = [
        (re.compile(body, re.IGNORECASE), RULE_WORDS[event][index], [])
        for event, rules in fv.EVENT_TRIGGERS.items()
        for index, (body, _) in enumerate(rules)
        if RULE_WORDS[event][index]
    ]
    cases.append((re.compile(fv.CALENDAR_PATTERN, re.IGNORECASE), CALENDAR_WORDS, CALENDAR_PIECES))
    cases.append((re.compile(fv.TEMPLATE_PATTERN, re.IGNORECASE), TEMPLATE_WORDS, []))

    @settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.data())
    def check(data):
        body, needed, pieces = data.draw(st.sampled_from(cases))
        text = data.draw(st.from_regex(body, fullmatch=True, alphabet=st.characters(codec="ascii")))
        tokens = set(re.split(r"[^a-z0-9]+", text.lower()))
        spaced = needed is TEMPLATE_WORDS and re.search(SPACED_GIVEAWAY.removeprefix("(?U)"), text.lower())
        assert tokens & set(needed) or spaced or any(piece in text.lower() for piece in pieces)

    check()


def test_plan_does_not_grow_with_the_rules(spark):
    from sigspark.config import EventRules

    def plan_size(df):
        spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
        return df._jdf.queryExecution().optimizedPlan().toString().count("(")

    df = spark.createDataFrame([(1, "a zeppelin fleet, earnings beat", "newsapi")], "id int, text string, source string")
    plain = EventRules()
    longer = EventRules({event: [*rules, *((rf"\bzeppelin{i or ''}\s+fleet\b", 0.99) for i in range(len(rules)))] for event, rules in plain.triggers.items()})
    assert len(longer.rows()) == 2 * len(plain.rows())
    assert plan_size(classify_events(df, longer)) == plan_size(classify_events(df, plain))
    found = {(r["event_type"], r["term"]) for r in matched_rules(df, "id", longer).collect()}
    assert found == {("Earnings", "earnings beat")} | {(event, "zeppelin fleet") for event in plain.triggers}


def test_index_finds_what_trying_all_rules_finds():
    import random
    import re

    from sigspark import fixed_values as fv
    from sigspark.functions.pattern_index import Pattern, PatternIndex
    from sigspark.operators.classify import rule_piece, rule_words

    rows = [(event, n, body) for event, rules in fv.EVENT_TRIGGERS.items() for n, (body, _) in enumerate(rules)]
    index = PatternIndex([Pattern(body, rule_words(event, n, body), piece=rule_piece(event, n, body)) for event, n, body in rows])
    words = sorted({w for event, n, body in rows for w in re.findall(r"[a-z]{2,}", body)})
    rng = random.Random(3)
    hits = 0
    for _ in range(1500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " to ", "s ", "ed ", "", " 11 ", "\n"]) for _ in range(rng.randint(1, 14)))
        text = rng.choice([text, text.upper(), text.replace("s", "ſ"), text.replace("i", "İ")])
        want = [(n, m.group()) for n, (_, _, body) in enumerate(rows) if (m := re.search(body, text, re.IGNORECASE))]
        assert [(n, m.group()) for n, m in index.matches(text)] == want
        hits += len(want)
    assert hits > 300
