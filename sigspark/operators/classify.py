"""Event classification: weighted pattern rules, exclusions, precedence.

Rules are data: an inverted index (``functions/pattern_index.py``) finds which of them to try on a text, in one Arrow call
that hands back the rules that match. The plan grows with the classes, not with the rules.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import EventRules
from sigspark.functions import text as tx
from sigspark.functions.barrier import attach
from sigspark.functions.pattern_index import Pattern, PatternIndex, by_parts

EVENT_COLUMNS = [
    "event_type", "event_confidence", "matched_triggers", "secondary_event", "is_template", "is_calendar",
    "is_analyst_action",
]
# Words every match of a rule must contain as a whole token (any one of them), by position
# of the rule in its class. A rule without an entry is always evaluated.
RULE_WORDS = {
    "Credit Event": [
        ["downgrade", "downgraded", "downgrades", "downgrading", "rating", "junk", "outlook"],
        ["rating"],
        ["junk", "rating"],
        ["junk", "investment", "outlook"],
        ["bankruptcy", "chapter"],
        ["chapter"],
        ["default", "defaults", "defaulted", "defaulting"],
        ["payment", "payments"],
        ["breach", "restructuring", "distressed", "insolvent", "insolvency"],
        ["swap", "swaps"],
        ["swap", "swaps"],
    ],
    "Geopolitical": [
        ["sanction", "sanctions", "embargo", "embargoe", "embargos"],
        ["trade", "tariff", "tariffs", "export"],
        ["invasion", "declared", "military", "missile", "strike", "strikes", "airstrike", "airstrikes"],
        ["ministry", "bilateral"],
    ],
    "Merger/Acquisition": [
        ["buyout", "takeover"],
        ["merger", "mergers", "merging", "merge", "merged", "merges"],
        ["acquire", "acquired", "acquires", "acquisition", "acquisitions", "acquiring"],
        ["tender", "bid", "bids", "stake"],
        None,
    ],
    "Regulatory": [
        ["lawsuit", "lawsuits", "sue", "sues", "suing", "sued", "litigation", "litigate", "litigated", "litigates"],
        ["sec", "doj", "ftc", "cftc", "fcc", "epa", "faa", "fda"],
        ["regulator", "regulators", "regulatory"],
        ["renewal", "court", "subpoena", "subpoenas", "injunction", "infringement"],
        ["antitrust", "monopoly", "probe", "probes", "investigation", "investigated", "investigating"],
    ],
    "Earnings": [
        ["earnings"],
        ["earnings", "eps"],
        ["quarterly", "fiscal", "earnings"],
        ["report", "reports"],
        ["revenue", "sales"],
        ["profit", "guidance"],
        [
            "jpmorgan", "goldman", "barclays", "morgan", "citi", "citigroup", "bofa", "bank", "jefferies", "ubs",
            "wells", "bernstein", "cowen", "oppenheimer", "mizuho", "piper", "canaccord", "evercore", "stifel",
        ],
        ["analyst", "analysts", "brokerage", "brokerages"],
        ["target", "pt"],
        ["upgrade", "upgraded", "downgrade", "downgraded"],
    ],
    "Product Launch": [
        ["unveil", "unveils", "unveiled", "unveiling"],
        ["launch", "launches", "launched", "launching", "roll", "rolls", "rolled", "rolling", "rollout"],
        ["debut", "debuts", "debuted", "debuting", "reveal", "reveals", "revealed", "revealing"],
        ["cybercab", "robotaxi", "vision", "new"],
    ],
    "Macroeconomic": [
        ["cpi", "inflation", "inflationary", "consumer"],
        ["interest", "rate", "monetary"],
        ["federal", "fed", "fomc"],
        ["treasury", "yield"],
        ["jobs", "nonfarm", "unemployment", "gdp"],
    ],
}
# A string every match of a rule without guard words must contain.
RULE_PIECES = {("Merger/Acquisition", 4): "merger"}
# Same for the calendar pattern; weekday names may be glued to a prefix, hence the raw piece
CALENDAR_WORDS = [
    "earnings", "revenue", "week", "anticipated", "largest", "mon", "tue", "tues", "wed", "thu", "thurs", "thur", "fri",
    "ahead", "beginning",
]
CALENDAR_PIECES = ["day"]
# and for the template pattern, whose last two alternatives may start and end anywhere
TEMPLATE_WORDS = ["stickynote", "morning", "retweet"]
SPACED_GIVEAWAY = r"(?U)g\s*i\s*v\s*e\s*a\s*w\s*a\s*y"

CREDIT, GEO, EARNINGS, MACRO = "Credit Event", "Geopolitical", "Earnings", "Macroeconomic"


HITS = pa.list_(pa.struct([("event_type", pa.string()), ("rule", pa.int32()), ("term", pa.string()), ("weight", pa.float64())]))
HITS_SQL = "array<struct<event_type: string, rule: int, term: string, weight: double>>"


def rule_hits(text: Column, rules: EventRules | None = None) -> Column:
    """The rules that match a text, in the order of the table, each with its class, its weight and the matched text."""
    rows = (rules or EventRules()).rows()
    index = PatternIndex([Pattern(body, rule_words(event, n, body), piece=rule_piece(event, n, body)) for event, n, body, _ in rows])

    def hits(value: str) -> list[dict]:
        found = ((rows[n], match.group()) for n, match in index.matches(value))
        return [{"event_type": event, "rule": number, "term": term, "weight": weight} for (event, number, _, weight), term in found if term]

    def scan(texts: pa.Array) -> pa.Array:
        return by_parts(lambda t: hits(t) if t else [], HITS, texts)

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, HITS_SQL)(text)


def built_in(event: str, index: int, body: str) -> bool:
    """Guards hold only for the built-in pattern they were written for."""
    known = fv.EVENT_TRIGGERS.get(event, [])
    return index < len(known) and known[index][0] == body


def rule_words(event: str, index: int, body: str) -> tuple[str, ...] | None:
    words = RULE_WORDS[event][index] if built_in(event, index, body) else None
    return tuple(words) if words else None


def rule_piece(event: str, index: int, body: str) -> str:
    return RULE_PIECES.get((event, index), "") if built_in(event, index, body) else ""


def matched_rules(df: DataFrame, key: str, rules: EventRules | None = None, text: str = "text") -> DataFrame:
    """Long form: one row per (text, class, rule) that matched."""
    return df.select(key, rule_hits(F.col(text), rules).alias("_hits")).select(key, F.explode("_hits").alias("hit")).select(key, "hit.*")


def classify_events(
    df: DataFrame,
    rules: EventRules | None = None,
    text: str = "text",
    source: str = "source",
    macro_tags: str | None = "macro_tags",
) -> DataFrame:
    """Attach event type, confidence, triggers, runner-up and the template/calendar/analyst flags."""
    rules = rules or EventRules()
    clean = df.withColumn("_clean", tx.trim(F.coalesce(text, F.lit(""))))
    body = F.col("_clean")
    scanned = clean.withColumns({"_folded": tx.fold(body), "_hits": rule_hits(body, rules)})
    stage = scanned.withColumn("_words", tx.vocabulary_hits(F.col("_folded"), [*CALENDAR_WORDS, *TEMPLATE_WORDS]))
    src = F.lower(F.coalesce(F.col(source), F.lit(""))) if source in df.columns else F.lit("")
    is_tweet = src.isin(*fv.TWEET_SOURCES)
    empty = F.array().cast("array<string>")

    tags = empty
    if macro_tags and macro_tags in df.columns:
        tags = F.filter(F.coalesce(F.col(macro_tags), empty), lambda tag: F.coalesce(tag, F.lit("")) != "")

    # number of matched rules, best weight and terms per class
    measures = {}
    for event in rules.triggers:
        own = F.filter("_hits", lambda hit: hit["event_type"] == event)  # noqa: B023  evaluated here
        count = F.size(own)
        best = F.coalesce(F.greatest(F.lit(0.0), F.array_max(F.transform(own, lambda hit: hit["weight"]))), F.lit(0.0))
        terms = F.transform(own, lambda hit: hit["term"])
        if event == MACRO and macro_tags and macro_tags in df.columns:
            count = count + F.size(tags)
            best = F.greatest(best, F.when(F.size(tags) > 0, F.lit(0.90)))
            terms = F.concat(terms, F.transform(tags, lambda tag: F.concat(F.lit("macro_tag:"), tag)))
        key = rules.rank(event)
        measures[f"_n{key}"], measures[f"_w{key}"], measures[f"_t{key}"] = count, best, terms
    stage = stage.withColumns(measures)

    candidates = []
    for event in rules.triggers:
        key = rules.rank(event)
        present = F.col(f"_n{key}") > 0
        if event == CREDIT:
            speculation = tx.matches(body, fv.CREDIT_SPECULATION_PATTERN)
            bare_swap = tx.matches(body, fv.CREDIT_SWAP_PATTERN) & ~tx.matches(body, fv.CREDIT_SWAP_CONTEXT_PATTERN)
            grounded = tx.matches(body, fv.CREDIT_AGENCY_PATTERN) | tx.matches(body, fv.CREDIT_FILING_PATTERN)
            present = present & ~speculation & ~bare_swap & grounded
        if event == GEO:
            present = present & ~tx.matches(body, fv.GEO_EXCLUSION_PATTERN)
        candidate = F.expr(
            f"named_struct('loss', -least(1D, _w{key} + CASE WHEN _n{key} > 1 THEN least(0.1D, 0.05D * (_n{key} - 1)) ELSE 0D END), "
            f"'rank', {key}, 'event', {tx.sql_string(event)}, 'terms', array_sort(array_distinct(_t{key})))"
        )
        candidates.append(F.when(present, candidate))
    stage = stage.withColumn("_ranked", F.array_sort(F.array_compact(F.array(*candidates))))
    ranked = F.col("_ranked")
    winner, runner_up = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))

    cashtag_count = F.regexp_count(body, F.lit(r"\$[A-Za-z]+"))
    blank = body == ""
    stage = stage.withColumns(
        {
            "_event": winner["event"],
            "_score": -winner["loss"],
            "_terms": winner["terms"],
            "_second": runner_up["event"],
            "_calendar": ~blank & (
                (
                    (tx.any_word(F.col("_words"), CALENDAR_WORDS) | tx.contains_any(F.col("_folded"), CALENDAR_PIECES))
                    & tx.matches(body, fv.CALENDAR_PATTERN)
                )
                | (F.contains(body, F.lit("$")) & (cashtag_count >= fv.CALENDAR_MIN_CASHTAGS))
            ),
            "_spam": (tx.any_word(F.col("_words"), TEMPLATE_WORDS) & tx.matches(body, fv.TEMPLATE_PATTERN))
            | F.rlike(F.col("_folded"), F.lit(SPACED_GIVEAWAY)),
        }
    )
    event, score = F.col("_event"), F.col("_score")
    analyst = F.coalesce((event == EARNINGS) & tx.matches(body, fv.ANALYST_ACTION_PATTERN), F.lit(False))

    # geopolitical tweets need an event word, and an actor to keep full confidence
    geo_tweet = F.coalesce((event == GEO) & is_tweet, F.lit(False))
    actor = tx.matches(body, fv.GEO_ACTOR_PATTERN)
    rejected = geo_tweet & (
        ~tx.matches(body, fv.GEO_EVENT_PATTERN) | (tx.matches(body, fv.STOCK_OPINION_PATTERN) & ~actor)
    )
    hypothetical = (
        is_tweet & event.isNotNull() & tx.matches(body, fv.HYPOTHETICAL_PATTERN) & ~tx.matches(body, fv.CREDIT_AGENCY_PATTERN)
    )
    stage = stage.withColumns({"_rejected": rejected, "_analyst": analyst})
    rejected = F.col("_rejected")
    adjusted = F.when(rejected, F.lit(0.20)).when(geo_tweet & ~actor, F.least(score, F.lit(0.60))).otherwise(score)
    adjusted = F.when(hypothetical, F.least(adjusted, F.lit(0.60))).otherwise(adjusted)

    outputs = {
        "event_type": F.when(event.isNull() | rejected, fv.OTHER).otherwise(event),
        "event_confidence": F.when(blank, 0.0).when(event.isNull(), 0.20).otherwise(F.round(adjusted, 4)),
        "matched_triggers": F.when(event.isNull() | rejected, empty)
        .when(F.col("_analyst"), F.concat("_terms", F.array(F.lit("analyst_action"))))
        .otherwise(F.col("_terms")),
        "secondary_event": F.col("_second"),
        "is_template": F.col("_spam") | F.col("_calendar"),
        "is_calendar": F.col("_calendar"),
        "is_analyst_action": F.col("_analyst"),
    }
    return attach(stage, [name for name in df.columns if name not in outputs], outputs)
