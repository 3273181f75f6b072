"""Explicit schemas of the tables the operators exchange, and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv

RAW_TWEETS = "Date string, Tweet string, `Stock Name` string, `Company Name` string"
RAW_LABELLED = "raw_label string, text string"
RAW_ARTICLES = (
    "status string, articles array<struct<source: struct<id: string, name: string>, author: string, "
    "title: string, description: string, url: string, publishedAt: string, content: string>>"
)
RAW_HEADLINES = "url string, title string, seendate string, domain string, language string, ticker string"
LABEL_SHEET = "text_id string, source string, text string, my_label string, my_event string"

_COMPONENTS = (
    "severity_contrib", "sentiment_contrib", "source_contrib", "volume_contrib",
    "raw_severity", "raw_sentiment_abs", "raw_source_weight", "raw_volume_signal",
)
_TEXTS = [
    ("text_id", "string"), ("ts", "timestamp"), ("source", "string"), ("ticker_hint", "string"),
    ("ticker_hints", "array<string>"), ("title", "string"), ("text", "string"), ("url", "string"),
    ("author_or_domain", "string"), ("raw_label", "string"), ("dup_count", "bigint"),
]
_SIGNALS = [
    ("ts", "timestamp"), ("ticker", "string"), ("source", "string"), ("text_id", "string"),
    ("headline", "string"), ("sentiment_score", "double"), ("event_type", "string"),
    ("impact_score", "double"), ("confidence", "double"), ("event_confidence", "double"),
    ("secondary_event", "string"), ("attribution_weight", "double"), ("matched_triggers", "array<string>"),
    ("impact_components", f"struct<{', '.join(f'{name}: double' for name in _COMPONENTS)}>"),
    ("is_broadcast", "boolean"), ("is_analyst_action", "boolean"),
]
_PRICES = [
    ("date", "date"), ("ticker", "string"), ("open", "double"), ("high", "double"), ("low", "double"),
    ("close", "double"), ("adj_close", "double"), ("volume", "double"),
]


def ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


TEXTS, SIGNALS, PRICES = ddl(_TEXTS), ddl(_SIGNALS), ddl(_PRICES)
TEXT_COLUMNS = [name for name, _ in _TEXTS]
SIGNAL_COLUMNS = [name for name, _ in _SIGNALS]
PRICE_COLUMNS = [name for name, _ in _PRICES]
COMPONENT_COLUMNS = list(_COMPONENTS)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional(df: DataFrame, name: str, default: Column) -> Column:
    """The column, or a default where the table does not have it."""
    return F.col(name) if name in df.columns else default


def _within(name: str, low: float, high: float, required: bool) -> Column:
    inside = F.col(name).between(low, high) & ~F.isnan(name)
    if required:
        return F.coalesce(inside, F.lit(False))
    return F.coalesce(inside, F.col(name).isNull())


def signal_is_valid() -> Column:
    """Range, enumeration and required-field checks of one signal row."""
    required = ("ts", "ticker", "source", "text_id", "headline", "sentiment_score", "event_type", "impact_score")
    checks = [F.col(name).isNotNull() for name in required]
    checks += [
        _within("sentiment_score", -1.0, 1.0, True),
        _within("impact_score", 1.0, 10.0, True),
        _within("confidence", 0.0, 1.0, True),
        _within("event_confidence", 0.0, 1.0, False),
        _within("attribution_weight", 0.0, 1.0, False),
        F.coalesce(F.col("event_type").isin(*fv.EVENT_PRECEDENCE), F.lit(False)),
        F.coalesce(F.col("secondary_event").isin(*fv.EVENT_PRECEDENCE), F.col("secondary_event").isNull()),
    ]
    valid = checks[0]
    for check in checks[1:]:
        valid = valid & check
    return valid


def split_valid(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    flagged = signals.withColumn("_valid", signal_is_valid())
    return flagged.filter("_valid").drop("_valid"), flagged.filter("NOT _valid").drop("_valid")
