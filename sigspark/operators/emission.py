"""Signal emission: which texts become signals, for which tickers, with which weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import EventRules, ImpactParams
from sigspark.functions import text as tx
from sigspark.functions.numeric import clip
from sigspark.operators.classify import classify_events
from sigspark.operators.impact import daily_volume, dampen_broadcast, with_impact, with_volume_signal
from sigspark.operators.linking import unlink_generic_terms
from sigspark.schemas import SIGNAL_COLUMNS, optional

TARGETS = "array<struct<ticker: string, weight: double, broadcast: boolean>>"


def eligible(df: DataFrame) -> DataFrame:
    """Relevant texts outside the labelled benchmark."""
    return df.filter(F.coalesce("is_relevant", F.lit(False)) & (F.coalesce("source", F.lit("")) != fv.LABELLED_SOURCE))


def is_dropped() -> Column:
    return F.coalesce("is_template", F.lit(False)) | F.coalesce("is_calendar", F.lit(False))


def dropped_by_source(classified: DataFrame) -> DataFrame:
    """Audit of the template and calendar filter."""
    return classified.filter(is_dropped()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_dropped"), F.count_if(F.coalesce("is_calendar", F.lit(False))).alias("n_calendar")
    )


def targets(df: DataFrame, strict_hint: bool = False) -> Column:
    """Tickers a text emits for, by the first rule that applies.

    1. broadcast: every linked company, only for a confident, typed event
    2. market text; 3. linked company; 4. single scrape label; 5. unlinked macro text

    A hint-only text carries its hint as link and so falls under rule 3; ``strict_hint``
    sends such texts to rule 4, which wants exactly one scrape label.
    """
    null_string = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    hint = optional(df, "ticker_hint", null_string)
    primary = optional(df, "primary_ticker", null_string)
    link_type = optional(df, "link_type", null_string)
    hints = F.coalesce(
        optional(df, "ticker_hints", F.lit(None).cast("array<string>")), F.when(hint.isNotNull(), F.array(hint)).otherwise(empty)
    )
    broadcast = F.coalesce(optional(df, "is_broadcast", F.lit(False)), F.lit(False))
    companies = F.filter(
        F.coalesce(F.col("linked_tickers"), empty), lambda t: F.coalesce(t, F.lit("")).isin("", fv.MARKET) == F.lit(False)
    )
    n = F.size(companies)
    typed = (F.col("event_type") != fv.OTHER) & (F.col("event_confidence") >= 0.8)

    def one(ticker) -> Column:
        return F.array(F.struct(ticker.alias("ticker"), F.lit(1.0).alias("weight"), F.lit(False).alias("broadcast"))).cast(TARGETS)

    nothing = F.array().cast(TARGETS)
    spread = F.transform(
        companies, lambda t: F.struct(t.alias("ticker"), (F.lit(1.0) / n).alias("weight"), F.lit(True).alias("broadcast"))
    ).cast(TARGETS)
    linked = F.when(F.array_contains(companies, primary), primary).otherwise(F.get(companies, 0))
    hint_only = F.coalesce(link_type == "hint_only", F.lit(False))
    from_links = (n > 0) & ~hint_only if strict_hint else n > 0
    single_hint = hint_only & (F.size(hints) <= 1) & F.coalesce(hint != fv.MARKET, F.lit(False)) & (F.coalesce(hint, F.lit("")) != "")
    return (
        F.when(broadcast | (n >= 3), F.when(typed, spread).otherwise(nothing))
        .when((primary == fv.MARKET) | (hint == fv.MARKET), one(F.lit(fv.MARKET)))
        .when(from_links, one(linked))
        .when(single_hint, F.when(F.col("source").isin(*fv.TWEET_SOURCES), one(hint)).otherwise(one(F.lit(fv.MARKET))))
        .when((n == 0) & primary.isNull() & hint.isNull(), one(F.lit(fv.MARKET)))
        .otherwise(nothing)
    )


def route(classified: DataFrame, strict_hint: bool = False) -> DataFrame:
    """Fan-out: one row per emitted ticker; texts without a target emit nothing."""
    kept = [name for name in classified.columns if name not in ("ticker", "attribution_weight", "is_broadcast")]
    return (
        classified.withColumn("_target", F.explode(targets(classified, strict_hint)))
        .select(
            *kept,
            F.col("_target.ticker").alias("ticker"),
            F.col("_target.weight").alias("attribution_weight"),
            F.col("_target.broadcast").alias("is_broadcast"),
        )
    )


def project_signals(scored: DataFrame) -> DataFrame:
    """The 16 signal columns, rounded to 4 digits."""
    confidence = clip(
        0.5 * F.coalesce(optional(scored, "sentiment_confidence", F.lit(0.8)), F.lit(0.8))
        + 0.5 * F.coalesce("event_confidence", F.lit(0.5)),
        0.0,
        1.0,
    )
    values = {
        "headline": tx.headline(optional(scored, "title", F.lit(None).cast("string")), F.col("text")),
        "sentiment_score": F.round("sentiment_score", 4),
        "confidence": F.round(confidence, 4),
        "event_confidence": F.round("event_confidence", 4),
        "attribution_weight": F.round("attribution_weight", 4),
        "matched_triggers": F.coalesce("matched_triggers", F.array().cast("array<string>")),
        "is_analyst_action": F.coalesce(optional(scored, "is_analyst_action", F.lit(False)), F.lit(False)),
    }
    return scored.select(*[values.get(name, F.col(name)).alias(name) for name in SIGNAL_COLUMNS])


def emit_signals(
    scored: DataFrame,
    history: DataFrame | None = None,
    rules: EventRules | None = None,
    params: ImpactParams | None = None,
    as_of: str | None = None,
    strict_hint: bool = False,
    fit_history: bool = True,
) -> DataFrame:
    """Scored, linked texts -> signals.

    Volume history is counted per scrape label over all relevant tweets, before templates are
    dropped, and looked up by the emitted ticker. ``history`` may bring the daily counts from
    an earlier run. Texts without a timestamp take ``as_of`` or stay null.
    """
    relevant = eligible(scored)
    if "sentiment_score" not in relevant.columns:
        raise ValueError("texts must carry sentiment_score")
    tweets = relevant.filter(F.col("source").isin(*fv.TWEET_SOURCES))
    if history is None:
        hinted = tweets if "ticker_hint" in tweets.columns else tweets.withColumn("ticker_hint", F.lit(None).cast("string"))
        history = daily_volume(hinted if fit_history else hinted.limit(0))
    classified = relevant if {"event_type", "is_calendar"} <= set(relevant.columns) else classify_events(relevant, rules)
    kept = classified.filter(~is_dropped())
    if "matched_term" in kept.columns:
        kept = unlink_generic_terms(kept)
    if as_of is not None:
        kept = kept.withColumn("ts", F.coalesce("ts", F.lit(as_of).cast("timestamp")))
    routed = route(kept, strict_hint)
    volumes = with_volume_signal(routed, history, params=params)
    return project_signals(dampen_broadcast(with_impact(volumes, params)))
