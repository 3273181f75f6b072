"""Entity linking: text x company dictionary.

The dictionary is data: its terms are patterns of an inverted index (``functions/pattern_index.py``), which one Arrow call
looks a text up in. It hands back one entry for each company that the text has any evidence of; all weighing of evidence
is done by column expressions over these few entries. So neither the plan nor the work on a text grows with the dictionary.
Intermediate columns are materialized in separate projections because each is used several times.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import Company, Dictionary
from sigspark.functions import text as tx
from sigspark.functions.barrier import attach
from sigspark.functions.pattern_index import Pattern, PatternIndex, by_parts

NO_STRINGS = "array<string>"
# every macro pattern needs one of these words
MACRO_WORDS = [
    "federal", "fed", "fomc", "interest", "rate", "inflation", "cpi", "treasury", "p", "wall", "central", "monetary",
]
LINK_COLUMNS = [
    "linked_tickers", "primary_ticker", "link_type", "link_confidence", "n_linked_tickers", "is_broadcast",
    "other_cashtags", "attribution_weight", "is_relevant", "matched_term",
]


ENTRY = pa.struct(
    [
        ("company", pa.int32()), ("ticker", pa.string()), ("ambiguous", pa.bool_()), ("in_context", pa.bool_()), ("tags", pa.int32()),
        ("product", pa.string()), ("product_at", pa.int32()), ("alias", pa.string()), ("alias_at", pa.int32()),
        ("symbol", pa.string()), ("symbol_at", pa.int32()),
    ]
)
SCAN = pa.struct([("entries", pa.list_(ENTRY)), ("macro", pa.string())])
SCAN_SQL = (
    "struct<entries: array<struct<company: int, ticker: string, ambiguous: boolean, in_context: boolean, tags: int, product: string, "
    "product_at: int, alias: string, alias_at: int, symbol: string, symbol_at: int>>, macro: string>"
)


def literal(term: str, ignore_case: bool = True) -> Pattern:
    word = tx.key_word(term)
    return Pattern(rf"\b{re.escape(term)}\b", (word,) if word else None, ignore_case)


class DictionaryScan:
    """Evidence of companies in a text. Terms of a kind compete: the leftmost counts, then the first in the dictionary."""

    def __init__(self, dictionary: Dictionary, companies: list[Company]):
        self.companies = companies
        self.places = {company.ticker: n for n, company in enumerate(companies)}
        patterns: list[Pattern] = []
        self.meaning: list[tuple[int, str]] = []  # by pattern: company and kind
        for n, company in enumerate(companies):
            kinds = [("product", company.products + company.executives), ("alias", company.aliases)]
            if company.ticker not in dictionary.wordlike_symbols:
                kinds.append(("symbol", (company.ticker,)))
            for kind, terms in kinds:
                patterns += [literal(term, kind != "symbol") for term in terms]
                self.meaning += [(n, kind)] * len(terms)
        if dictionary.macro_patterns:
            words = tuple(MACRO_WORDS) if dictionary.macro_patterns == tuple(fv.MACRO_PATTERNS) else None
            patterns.append(Pattern("|".join(dictionary.macro_patterns), words))
            self.meaning.append((-1, "macro"))
        self.index = PatternIndex(patterns)

    def in_context(self, company: Company, text: str) -> bool:
        return any(literal(term).search(text) for term in company.context_words)

    def evidence(self, text: str, tags: list[str]) -> dict:
        entries: dict[int, dict] = {}
        macro = None

        def entry(n: int) -> dict:
            return entries.setdefault(n, {"company": n, "ticker": self.companies[n].ticker, "ambiguous": self.companies[n].is_ambiguous, "tags": 0})

        for tag in tags:
            if tag in self.places:
                entry(self.places[tag])["tags"] += 1
        for number, match in self.index.matches(text):
            n, kind = self.meaning[number]
            if kind == "macro":
                macro = match.group() or None
                continue
            found = entry(n)
            if match.start() < found.get(f"{kind}_at", len(text) + 1):  # patterns come in dictionary order
                found[kind], found[f"{kind}_at"] = match.group(), match.start()
        for n, found in entries.items():
            found["in_context"] = "alias" in found and found["ambiguous"] and self.in_context(self.companies[n], text)
        return {"entries": [entries[n] for n in sorted(entries)], "macro": macro}

    def column(self, text: Column, tags: Column) -> Column:
        def scan(texts: pa.Array, tag_lists: pa.Array) -> pa.Array:
            return by_parts(lambda t, known: self.evidence(t or "", known or []), SCAN, texts, tag_lists)

        scan.__annotations__ = {"texts": pa.Array, "tag_lists": pa.Array, "return": pa.Array}
        return F.arrow_udf(scan, SCAN_SQL)(text, tags)


def weighed(entry: Column) -> Column:
    """The best evidence of one company, and how often it is mentioned."""
    alias, product, symbol, tags, name = entry["alias"], entry["product"], entry["symbol"], entry["tags"], entry["ticker"]
    # an everyday word counts only with other evidence, as a longer name, or in context
    support = ~entry["ambiguous"] | (tags > 0) | product.isNotNull() | entry["in_context"] | F.rlike(alias, F.lit(r"(?U)\S\s+\S|\."))
    alias = F.when(support, alias)
    tests = [(tags > 0, "cashtag", F.concat(F.lit("$"), name)), (alias.isNotNull(), "company_name", alias),
             (product.isNotNull(), "product_or_exec", product), (symbol.isNotNull(), "ticker_symbol", name)]

    def best(pick) -> Column:
        out = None
        for test, kind, term in tests:
            out = F.when(test, pick(kind, term)) if out is None else out.when(test, pick(kind, term))
        return out

    return F.struct(
        name.alias("ticker"), best(lambda kind, _: F.lit(kind)).alias("kind"), best(lambda kind, _: F.lit(fv.LINK_CONFIDENCE[kind])).alias("confidence"),
        best(lambda _, term: term).alias("term"), (tags + product.isNotNull().cast("int") + alias.isNotNull().cast("int") + symbol.isNotNull().cast("int")).alias("mentions"),
        F.when(tags > 0, F.array_position(F.col("_tags"), name)).otherwise(F.lit(1_000_000).cast("long") + entry["company"]).alias("ordinal"),
        tags.alias("tags"), F.least(F.when(alias.isNotNull(), entry["alias_at"]), entry["product_at"], entry["symbol_at"]).alias("at"),
    )


def position(entry: Column, text: Column) -> Column:
    """0-based offset of a company's earliest evidence; only evaluated for ties."""
    tag = F.when(entry["tags"] > 0, F.greatest(F.lit(0), F.instr(F.upper(text), F.concat(F.lit("$"), entry["ticker"])) - 1))
    return F.least(tag, entry["at"])


def split_cashtags(tags: Column, dictionary: Dictionary) -> tuple[Column, Column]:
    """(known tickers, canonical; unknown symbols) — both in text order with duplicates."""
    universe = F.split(F.lit("\n".join(dictionary.universe)), "\n")
    canonical = lambda tag: tx.canonical_ticker(tag, dictionary.synonyms)
    symbols = F.filter(tags, lambda tag: ~tag.isin(*dictionary.currency_codes))
    known = lambda tag: F.array_contains(universe, canonical(tag)) | F.array_contains(universe, tag)
    return (
        F.transform(F.filter(symbols, known), canonical),
        F.filter(symbols, lambda tag: ~known(tag)),
    )


def link_entities(
    df: DataFrame,
    dictionary: Dictionary | None = None,
    text: str = "text",
    hint: str = "ticker_hint",
    hints: str = "ticker_hints",
    source: str = "source",
) -> DataFrame:
    """Attach linked tickers, primary ticker, evidence and the resolved hint to each text."""
    dictionary = dictionary or Dictionary.default()
    companies = [
        company for company in dictionary.companies
        if dictionary.synonyms.get(company.ticker, company.ticker) != fv.MARKET
    ]
    null_string = F.lit(None).cast("string")
    empty = F.array().cast(NO_STRINGS)
    hint_col = F.col(hint) if hint in df.columns else null_string
    has_hints = hints in df.columns
    source_col = F.col(source) if source in df.columns else null_string

    canonical = lambda value: tx.canonical_ticker(value, dictionary.synonyms)
    single = F.when(F.coalesce(hint_col, F.lit("")) != "", F.array(canonical(hint_col))).otherwise(empty)
    if has_hints:
        listed = F.coalesce(F.col(hints), empty)
        all_hints = F.when(
            F.size(listed) > 0, F.transform(F.filter(listed, lambda h: F.coalesce(h, F.lit("")) != ""), canonical)
        ).otherwise(single)
    else:
        all_hints = single

    # 1. cashtags, and evidence of companies
    known, unknown = split_cashtags(tx.cashtags(F.col(text)), dictionary)
    stage = df.withColumns({"_hints": all_hints, "_tags": known, "_unknown": unknown})
    stage = stage.withColumn("_scan", DictionaryScan(dictionary, companies).column(F.col(text), F.col("_tags")))

    # 2. best evidence per company
    stage = stage.withColumns(
        {
            "_found": F.filter(F.transform("_scan.entries", weighed), lambda entry: entry["mentions"] > 0),
            "_market": F.when(
                F.array_contains("_tags", fv.MARKET),
                F.struct(F.lit("cashtag").alias("kind"), F.lit(fv.LINK_CONFIDENCE["cashtag"]).alias("confidence"),
                         F.lit(f"${fv.MARKET}").alias("term")),
            ).when(
                F.col("_scan.macro").isNotNull(),
                F.struct(F.lit("company_name").alias("kind"), F.lit(fv.LINK_CONFIDENCE["company_name"]).alias("confidence"),
                         F.col("_scan.macro").alias("term")),
            ),
        }
    )
    found, market = F.col("_found"), F.col("_market")
    n = F.size(found)
    stage = stage.withColumn("_names", F.expr("transform(_found, entry -> entry.ticker)"))
    names = F.col("_names")

    # 3. two-company ties: hint, then mentions, then position, then order of appearance
    first, second = F.get(found, 0), F.get(found, 1)
    hinted = F.array_intersect(names, F.col("_hints"))
    equal_mentions = (n == 2) & (F.size(hinted) == 0) & (first["mentions"] == second["mentions"])
    located = F.transform(found, lambda entry: position(entry, F.col(text)))
    stage = stage.withColumn("_positions", F.when(equal_mentions, located))
    spot = F.col("_positions")
    first_leads = (
        F.when(first["mentions"] != second["mentions"], first["mentions"] > second["mentions"])
        .when(F.get(spot, 0) != F.get(spot, 1), F.get(spot, 0) < F.get(spot, 1))
        .otherwise(first["ordinal"] < second["ordinal"])
    )
    has_company, has_market = n > 0, market.isNotNull()
    tweet_with_hint = source_col.isin(*fv.TWEET_SOURCES) & (F.size("_hints") > 0)
    lowest_hint = F.array_min("_hints")
    primary = (
        F.when(n >= 3, null_string)
        .when(n == 2, F.when(F.size(hinted) > 0, F.array_min(hinted)).when(first_leads, first["ticker"]).otherwise(second["ticker"]))
        .when(n == 1, first["ticker"])
        .when(has_market, F.lit(fv.MARKET))
        .when(tweet_with_hint, lowest_hint)
    )
    stage = stage.withColumn("_primary", primary)
    primary = F.col("_primary")
    chosen = F.get(F.filter(found, lambda entry: entry["ticker"] == primary), 0)
    linked = F.array_sort(F.concat(names, F.when(has_market, F.array(F.lit(fv.MARKET))).otherwise(empty)))
    evidence = has_company | has_market
    hint_only = ~evidence & F.coalesce(tweet_with_hint, F.lit(False))

    def pick(many: Column, one: str, hint_value) -> Column:
        return (
            F.when(n >= 3, many)
            .when(has_company, chosen[one])
            .when(has_market, market[one])
            .when(hint_only, F.lit(hint_value))
        )

    matched_hints = F.array_intersect(F.col("_hints"), linked)
    resolved = F.coalesce(F.array_min(matched_hints), lowest_hint, hint_col)
    outputs = {
        "linked_tickers": F.when(hint_only, F.array(lowest_hint))
        .when(primary.isNotNull(), F.concat(F.array(primary), F.array_remove(linked, primary)))
        .otherwise(linked),
        "primary_ticker": primary,
        "link_type": pick(
            F.when(F.exists(found, lambda entry: entry["kind"] == "cashtag"), "cashtag").otherwise("company_name"),
            "kind", "hint_only",
        ),
        "link_confidence": pick(
            F.array_max(F.transform(found, lambda entry: entry["confidence"])), "confidence", fv.LINK_CONFIDENCE["hint_only"]
        ),
        "n_linked_tickers": F.when(hint_only, 1).otherwise(n),
        "is_broadcast": n >= 3,
        "other_cashtags": F.when(evidence, F.array_sort(F.array_distinct("_unknown"))).otherwise(F.col("_unknown")),
        "attribution_weight": F.when(has_company, F.round(1.0 / n, 4)).when(has_market | hint_only, 1.0).otherwise(0.0),
        "is_relevant": evidence | hint_only,
        "matched_term": pick(F.lit("broadcast"), "term", "hint"),
    }
    if has_hints and hint in df.columns:
        outputs[hint] = resolved
    return attach(stage, df.columns, outputs)


def unlink_generic_terms(df: DataFrame) -> DataFrame:
    """Drop MSFT where the only match was a dictionary word and the text does not name the company."""
    title = F.col("title") if "title" in df.columns else F.lit("")
    whole = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce(title, F.lit("")))
    generic = F.coalesce(
        F.lower("matched_term").isin(*fv.GENERIC_TERMS) & ~tx.matches(whole, fv.GENERIC_TERM_COMPANY_PATTERN), F.lit(False)
    )
    return df.withColumn("_generic", generic).withColumns(
        {
            "linked_tickers": F.when(F.col("_generic"), F.array_remove("linked_tickers", "MSFT")).otherwise(F.col("linked_tickers")),
            "primary_ticker": F.when(F.col("_generic") & (F.col("primary_ticker") == "MSFT"), None).otherwise(F.col("primary_ticker")),
            "link_type": F.when(~F.col("_generic"), F.col("link_type")),
        }
    ).drop("_generic")
