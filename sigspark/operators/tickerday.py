"""Ticker-day observations: signals of one ticker and trading day become one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.functions.text import week_key
from sigspark.operators import stats
from sigspark.operators.alignment import Calendar, align_to_sessions, eligible_signals

HIGH_CONFIDENCE = 0.8
MIN_OBSERVATIONS = 30


def ticker_days(aligned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Aggregate per (ticker, t0) in two levels: per event type first, then across types.

    The first level carries plain sums and is reduced in the map tasks; the second sees one
    row per event type. The dominant event is the most frequent one, then the one with the
    highest impact, then the first by name.
    """
    keys = keys or ["ticker", "t0"]
    weight, sentiment, confidence = F.col("attribution_weight"), F.col("sentiment_score"), F.col("sentiment_confidence")
    per_event = aligned.groupBy(*keys, "event_type").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("impact_score").alias("_impact"),
        F.sum(weight).alias("_w"),
        F.sum(sentiment * weight).alias("_sw"),
        F.sum(confidence * weight).alias("_cw"),
        F.sum(sentiment).alias("_s"),
        F.sum(confidence).alias("_c"),
        F.collect_set("source").alias("_sources"),
        F.bool_or(confidence >= HIGH_CONFIDENCE).alias("_high"),
        F.min("t0_idx").alias("_idx"),
    )
    n, w = F.sum("_n"), F.sum("_w")
    best = F.max(F.struct("_n", "_impact"))
    merged = per_event.groupBy(*keys).agg(
        F.max("_impact").alias("max_impact_score"),
        F.when(w > 0, F.sum("_sw") / w).otherwise(F.sum("_s") / n).alias("mean_sentiment_score"),
        best.alias("_best"),
        F.collect_list(F.struct("_n", "_impact", "event_type")).alias("_events"),
        n.alias("signal_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sources")))).alias("sources"),
        F.when(w > 0, F.sum("_cw") / w).otherwise(F.sum("_c") / n).alias("weighted_sentiment_confidence"),
        F.bool_or("_high").alias("has_high_conf_sentiment"),
        F.min("_idx").alias("t0_idx"),
    )
    # at most one entry per event type: a handful
    dominant = F.array_min(
        F.transform(
            F.filter("_events", lambda e: (e["_n"] == F.col("_best._n")) & (e["_impact"] == F.col("_best._impact"))),
            lambda e: e["event_type"],
        )
    )
    return merged.select(
        *keys,
        "t0_idx",
        "max_impact_score",
        "mean_sentiment_score",
        dominant.alias("dominant_event_type"),
        "signal_count",
        "sources",
        F.array_join("sources", ",").alias("source_str"),
        "weighted_sentiment_confidence",
        "has_high_conf_sentiment",
    )


def sentiment_bucket(score: Column) -> Column:
    return F.when(score < -0.2, "Negative").when(score > 0.2, "Positive").otherwise("Neutral")


def event_windows(days: DataFrame, returns: DataFrame, calendar: Calendar) -> DataFrame:
    """Attach ar0..ar2 at the calendar days t0, t0+1, t0+2, CARs, volatility, week and bucket.

    Returns are spread to the observations they serve (one row per offset) and pivoted back
    with a single equi-join on (ticker, index).
    """
    indexed = returns.join(calendar.table, "date").select("ticker", "idx", "ar", "trailing_vol_20")
    spread = indexed.select(
        F.col("ticker").alias("_ticker"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("offset"), (F.col("idx") - k).alias("at")) for k in range(3)])).alias("_o"),
        "ar",
        "trailing_vol_20",
    )
    served = spread.groupBy("_ticker", F.col("_o.at").alias("_at")).agg(
        *[F.max(F.when(F.col("_o.offset") == k, F.col("ar"))).alias(f"ar{k}") for k in range(3)],
        F.max(F.when(F.col("_o.offset") == 0, F.col("trailing_vol_20"))).alias("trailing_vol_20"),
    )
    joined = days.join(served, (days["ticker"] == served["_ticker"]) & (days["t0_idx"] == served["_at"]), "left").drop("_ticker", "_at")
    return joined.withColumns(
        {"abs_ar0": F.abs("ar0"), "car_0_2": F.col("ar0") + F.col("ar1") + F.col("ar2")}
    ).withColumns(
        {
            "abs_car_0_2": F.abs("car_0_2"),
            "week": week_key(F.col("t0")),
            "sent_bucket": sentiment_bucket(F.col("mean_sentiment_score")),
        }
    )


def observations(signals: DataFrame, returns: DataFrame, calendar: Calendar) -> DataFrame:
    """Signals -> ticker-day observations with event-window returns."""
    return event_windows(ticker_days(eligible_signals(signals, calendar)), returns, calendar)


def with_era(days: DataFrame) -> DataFrame:
    """Observation era by t0; eras are never pooled."""
    return days.withColumn(
        "era", F.when(F.col("t0") < "2023-01-01", "early").when(F.col("t0") >= "2026-01-01", "late").otherwise("between")
    )


def group_means(days: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Count and means per group, with the too-few flag."""
    return days.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(name).alias(f"mean_{name}") for name in columns]
    ).withColumn("too_few", F.col("n") < MIN_OBSERVATIONS)


def market_days(signals: DataFrame, returns: DataFrame, calendar: Calendar, benchmark: str = fv.BENCHMARK) -> DataFrame:
    """Market signals per trading day against the benchmark return itself."""
    aligned = align_to_sessions(signals.filter(F.col("ticker") == fv.MARKET), calendar).filter("t0 IS NOT NULL")
    weight = F.sum("attribution_weight")
    days = aligned.groupBy("t0").agg(
        F.max("impact_score").alias("max_impact_score"),
        F.when(weight > 0, F.sum(F.col("sentiment_score") * F.col("attribution_weight")) / weight)
        .otherwise(F.avg("sentiment_score"))
        .alias("mean_sentiment_score"),
        F.count(F.lit(1)).alias("signal_count"),
    )
    bench = returns.filter((F.col("ticker") == benchmark) & F.col("ret").isNotNull()).select(
        F.col("date").alias("t0"), F.col("ret").alias("spy_ret"), F.abs("ret").alias("abs_spy_ret")
    )
    return days.join(bench, "t0")


def market_study(days: DataFrame) -> DataFrame:
    """Rank correlations of market days: impact with the size of the benchmark's return, sentiment with the return itself.

    (pair, rho, n, p_value, few); a pair with fewer than five days has no correlation.
    """
    out = None
    for pair, x, y in (("impact_abs_return", "max_impact_score", "abs_spy_ret"), ("sentiment_return", "mean_sentiment_score", "spy_ret")):
        found = stats.spearman(days, x, y)
        found = found.select(F.lit(pair).alias("pair"), F.when(F.col("n") >= stats.MIN_OBSERVATIONS, F.col("rho")).alias("rho"), "n")
        out = found if out is None else out.unionByName(found)
    return stats.with_p_value(out)
