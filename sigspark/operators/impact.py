"""Impact score: severity, sentiment, source and trailing volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import ImpactParams
from sigspark.functions.numeric import clip, lookup, sigmoid

CONTRIBUTIONS = ["severity_contrib", "sentiment_contrib", "source_contrib", "volume_contrib"]


def daily_volume(texts: DataFrame, ticker: str = "ticker_hint", ts: str = "ts") -> DataFrame:
    """Texts per ticker and UTC day; reduced in the map tasks, so a dominant ticker is no hot spot."""
    return (
        texts.filter(F.col(ts).isNotNull() & (F.coalesce(F.col(ticker), F.lit("")) != ""))
        .groupBy(F.col(ticker).alias("ticker"), F.to_date(ts).alias("date"))
        .agg(F.count(F.lit(1)).alias("volume"))
    )


def _signal(current: Column, params: ImpactParams) -> Column:
    mean, std = F.col("mean_volume"), F.col("std_volume")
    flat = F.when(current > mean, 1.0).when(current < mean, 0.0).otherwise(F.lit(params.fallback))
    return (
        F.when(F.coalesce("n_days", F.lit(0)) < params.min_days, F.lit(params.fallback))
        .when(std.isNull() | (std == 0), flat)
        .otherwise(sigmoid((current - mean) / F.when(std != 0, std)))
    )


def trailing_volume(daily: DataFrame, params: ImpactParams | None = None) -> DataFrame:
    """Mean, std and number of *observed* days in the window [d-30, d-1], per observed day.

    A ticker has one row per day here, so a window partition is bounded by the calendar.
    """
    params = params or ImpactParams()
    window = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-params.trailing_days, -1)
    return daily.select("ticker", "date", "volume").withColumns(
        {
            "mean_volume": F.avg("volume").over(window),
            "std_volume": F.stddev_samp("volume").over(window),
            "n_days": F.count("volume").over(window),
        }
    )


def volume_signals(daily: DataFrame, params: ImpactParams | None = None) -> DataFrame:
    """Volume signal for every day that can have one, observed or not.

    Each observed day contributes to the 30 days after it, which answers any query day without
    first collecting the days asked for. Days missing here have no history: fallback.
    """
    params = params or ImpactParams()
    reach = F.sequence(F.date_add("date", 1), F.date_add("date", params.trailing_days))
    stats = (
        daily.select("ticker", F.explode(reach).alias("date"), "volume")
        .groupBy("ticker", "date")
        .agg(
            F.avg("volume").alias("mean_volume"),
            F.stddev_samp("volume").alias("std_volume"),
            F.count("volume").alias("n_days"),
        )
    )
    current = F.coalesce(F.col("volume"), F.lit(0)).cast("double")
    return stats.join(daily.select("ticker", "date", "volume"), ["ticker", "date"], "left").withColumn(
        "volume_signal", _signal(current, params)
    )


def news_volume_signal(dup_count: Column, params: ImpactParams | None = None) -> Column:
    """Syndication depth: log(1 + copies) relative to log(1 + base), at most 1."""
    params = params or ImpactParams()
    copies = F.greatest(F.lit(1), F.coalesce(dup_count, F.lit(1))).cast("double")
    return clip(F.log(copies + 1.0) / F.log(F.lit(1.0 + params.dup_base)), 0.0, 1.0)


def with_volume_signal(
    rows: DataFrame, daily: DataFrame, ticker: str = "ticker", params: ImpactParams | None = None
) -> DataFrame:
    """Attach the volume signal: trailing volume for tweets, copies for everything else.

    The (ticker, day) table is joined without a broadcast hint; adaptive execution broadcasts
    it when its measured size allows and splits skewed partitions otherwise.
    """
    params = params or ImpactParams()
    is_tweet = F.lower(F.coalesce("source", F.lit(""))).isin(*fv.TWEET_SOURCES) & F.col("ts").isNotNull()
    signal = volume_signals(daily, params).select(
        F.col("ticker").alias("_key"), F.col("date").alias("_day"), F.col("volume_signal").alias("_signal")
    )
    # rows that look nothing up get keys that match nothing, spread over all partitions
    lookup_key = F.when(is_tweet, F.col(ticker)).otherwise(F.concat(F.lit("\x00"), F.spark_partition_id().cast("string")))
    copies = F.col("dup_count") if "dup_count" in rows.columns else F.lit(1)
    tweet_source = F.lower(F.coalesce("source", F.lit(""))).isin(*fv.TWEET_SOURCES)
    return (
        rows.withColumns({"_ticker": lookup_key, "_date": F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))})
        .join(signal, (F.col("_ticker") == F.col("_key")) & (F.col("_date") == F.col("_day")), "left")
        .withColumn(
            "volume_signal",
            F.when(tweet_source, F.coalesce("_signal", F.lit(params.fallback))).otherwise(news_volume_signal(copies, params)),
        )
        .drop("_ticker", "_date", "_key", "_day", "_signal")
    )


def impact_parts(volume: Column, params: ImpactParams | None = None) -> dict[str, Column]:
    """Unrounded parts; needs event_type, sentiment_score and source."""
    params = params or ImpactParams()
    severity = lookup(F.col("event_type"), params.severity, params.severity["Other"])
    strength = F.abs(F.col("sentiment_score"))
    source = lookup(F.lower(F.coalesce("source", F.lit(""))), params.source_weights, params.source_weights["unknown"])
    signal = clip(volume, 0.0, 1.0)
    weights = params.weights
    return {
        "severity_contrib": weights["severity"] * severity,
        "sentiment_contrib": weights["sentiment"] * strength,
        "source_contrib": weights["source"] * source,
        "volume_contrib": weights["volume"] * signal,
        "raw_severity": severity,
        "raw_sentiment_abs": strength,
        "raw_source_weight": source,
        "raw_volume_signal": signal,
    }


def with_impact(rows: DataFrame, params: ImpactParams | None = None, volume: str = "volume_signal") -> DataFrame:
    """Attach ``impact_raw`` (clipped, 4 digits) and the rounded components."""
    parts = impact_parts(F.col(volume), params)
    staged = rows.withColumns({f"_{name}": column for name, column in parts.items()})
    total = (
        F.col("_severity_contrib") + F.col("_sentiment_contrib") + F.col("_source_contrib") + F.col("_volume_contrib")
    )
    components = F.struct(*[F.round(F.col(f"_{name}"), 4).alias(name) for name in parts])
    return staged.withColumns(
        {"impact_raw": F.round(clip(1.0 + 9.0 * total, 1.0, 10.0), 4), "impact_components": components}
    ).drop(*[f"_{name}" for name in parts])


def dampen_broadcast(rows: DataFrame) -> DataFrame:
    """A text spread over n tickers moves each by 1/n: score towards 1, contributions scaled."""
    weight, raw = F.col("attribution_weight"), F.col("impact_raw")
    spread = F.col("is_broadcast") & (weight < 1.0)
    score = F.when(spread, 1.0 + (raw - 1.0) * weight).otherwise(raw)
    parts = F.col("impact_components")
    for name in CONTRIBUTIONS:
        parts = parts.withField(name, F.round(F.col(f"impact_components.{name}") * weight, 4))
    return rows.withColumns(
        {
            "impact_score": F.round(clip(score, 1.0, 10.0), 4),
            "impact_components": F.when(spread, parts).otherwise(F.col("impact_components")),
        }
    )
