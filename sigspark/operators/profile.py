"""Profiles of raw text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.functions import text as tx


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) in one pass."""
    names = df.columns
    counted = df.agg(*[F.count_if(F.col(f"`{name}`").isNull()).alias(f"c{i}") for i, name in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"c{i}").alias("nulls")) for i, name in enumerate(names)])
    return counted.select(F.explode(rows).alias("_r")).select("_r.*")


def duplicate_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows, distinct values and duplicates of one column, by a two-level aggregation."""
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return per_value.agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), (F.sum("_n") - F.count(F.lit(1))).alias("n_duplicates")
    )


def length_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """count, mean, std, min, quartiles, max of character and word lengths (long form)."""
    lengths = df.select(
        F.explode(
            F.array(
                F.struct(F.lit("chars").alias("measure"), F.length(text).alias("value")),
                F.struct(F.lit("words").alias("measure"), tx.word_count(F.col(text)).alias("value")),
            )
        ).alias("_m")
    ).select("_m.*")
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = lengths.groupBy("measure").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), quartiles.alias("_q"), F.max("value").alias("max"),
    )
    return stats.select("measure", "n", "mean", "std", "min", *[F.get("_q", i).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max")


def monthly_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).isNotNull()).groupBy(tx.month_key(F.col(ts)).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def pattern_shares(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows holding a URL, a mention or an HTML entity: count and percentage."""
    patterns = {"url": fv.URL_PATTERN, "mention": fv.MENTION_PATTERN, "html_entity": fv.HTML_ENTITY_PATTERN}
    flags = {name: tx.matches(F.coalesce(text, F.lit("")), body) for name, body in patterns.items()}
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(flag).alias(name) for name, flag in flags.items()])
    rows = F.array(
        *[F.struct(F.lit(name).alias("pattern"), F.col(name).alias("n"), (100.0 * F.col(name) / F.col("_n")).alias("pct")) for name in patterns]
    )
    return counted.select(F.explode(rows).alias("_r")).select("_r.*")


def grouped_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
