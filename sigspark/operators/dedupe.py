"""Deduplication as aggregations with map-side combine.

A key that holds a third of all rows is reduced in every map task before the shuffle, so
no task ever sees the whole group. Every keep-first follows a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv


def _names(keys: list[str | Column]) -> list[Column]:
    return [F.col(key) if isinstance(key, str) else key for key in keys]


def keep_first(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    count_column: str | None = None,
    counted: Column | None = None,
    null_keys_pass: bool = True,
) -> DataFrame:
    """First row per key by ``order``; optionally with the number of rows it stands for.

    ``order`` must be total within a key (ts, then position or id). Rows with a null key
    are not duplicates of each other and pass through with count 1.
    """
    payload = [name for name in df.columns if name not in keys]
    row = F.struct(*payload)
    rank = F.struct(*order)
    aggregates = [F.min_by(row, rank).alias("_row")]
    if count_column:
        aggregates.append(F.count(F.lit(1) if counted is None else counted).alias("_n"))
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & F.col(key).isNotNull()
    kept = df.filter(has_key) if null_keys_pass else df
    first = kept.groupBy(*keys).agg(*aggregates)
    columns = [F.col(name) if name in keys else F.col(f"_row.{name}") for name in df.columns if name != count_column]
    if count_column:
        first = first.select(*columns, F.col("_n").alias(count_column))
    else:
        first = first.select(*columns)
    if not null_keys_pass:
        return first
    loose = df.filter(~has_key)
    if count_column:
        loose = loose.withColumn(count_column, F.lit(1).cast("bigint"))
    return first.unionByName(loose)


def dup_count(df: DataFrame, keys: list[str], counted: str, name: str = "dup_count") -> DataFrame:
    """One row per key with its non-null count: what keep_first attaches to the kept row."""
    return df.groupBy(*keys).agg(F.count(counted).alias(name))


def merge_labels(df: DataFrame, keys: list[str], label: str, order: list[str], count_column: str = "dup_count") -> DataFrame:
    """Same text under several labels: labels united and sorted, counts summed, first row kept.

    Labels come from a small fixed universe, so the set per key is bounded.
    """
    payload = [name for name in df.columns if name not in (*keys, label, count_column)]
    merged = df.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("_row"),
        F.array_sort(F.collect_set(label)).alias(f"{label}s"),
        F.sum(count_column).alias(count_column),
    )
    return merged.select(
        *keys,
        *[F.col(f"_row.{name}") for name in payload],
        F.col(f"{label}s"),
        F.get(F.col(f"{label}s"), 0).alias(label),
        count_column,
    )


def merge_by_url(texts: DataFrame) -> DataFrame:
    """Copies of one article across files become one row.

    The earliest row wins; linked tickers, hints and other cashtags are united; counts are
    summed. Each copy is exploded into its set members plus one payload row, so the union
    is aggregated member by member instead of collecting all copies of a URL.
    """
    has_url = F.coalesce(F.trim("url") != "", F.lit(False))
    sets = {"linked_tickers": "L", "other_cashtags": "O", "ticker_hints": "H"}
    payload = [name for name in texts.columns if name not in ("url", *sets)]
    order = F.struct(F.col("ts").isNull(), "ts", "text_id")

    def member(tag: str):
        return lambda value: F.struct(
            F.lit(tag).alias("kind"), value.alias("value"), F.lit(None).cast(_payload_type).alias("row")
        )

    _payload_type = texts.select(F.struct(*payload).alias("p")).schema["p"].dataType
    copies = texts.filter(has_url).select(
        "url",
        F.explode(
            F.concat(
                F.array(
                    F.struct(
                        F.lit("R").alias("kind"), F.lit(None).cast("string").alias("value"), F.struct(*payload).alias("row")
                    )
                ),
                *[
                    F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), member(tag))
                    for name, tag in sets.items()
                ],
            )
        ).alias("item"),
    )
    is_row = F.col("item.kind") == "R"
    row_order = F.when(
        is_row, F.struct(F.col("item.row.ts").isNull(), F.col("item.row.ts"), F.col("item.row.text_id"))
    )
    merged = copies.groupBy("url").agg(
        F.min_by("item.row", row_order).alias("_row"),
        F.sum("item.row.dup_count").alias("_dup"),
        F.bool_or("item.row.is_relevant").alias("_relevant"),
        *[
            F.array_sort(F.collect_set(F.when(F.col("item.kind") == tag, F.col("item.value")))).alias(f"_{name}")
            for name, tag in sets.items()
        ],
    )
    n = F.size(F.array_remove(F.col("_linked_tickers"), fv.MARKET))
    values = {
        "url": F.col("url"),
        "linked_tickers": F.col("_linked_tickers"),
        "other_cashtags": F.col("_other_cashtags"),
        "ticker_hints": F.col("_ticker_hints"),
        "n_linked_tickers": n,
        "is_broadcast": n >= 3,
        "primary_ticker": F.when(n < 3, F.col("_row.primary_ticker")),
        "attribution_weight": F.when(n > 0, F.round(1.0 / n, 4)).otherwise(F.lit(1.0)),
        "dup_count": F.col("_dup"),
        "is_relevant": F.col("_relevant"),
    }
    merged = merged.select(
        *[values.get(name, F.col(f"_row.{name}") if name in payload else None).alias(name) for name in texts.columns]
    )
    return merged.unionByName(texts.filter(~has_url))


def step_counts(raw: DataFrame, reasons: dict[str, Column], marks: dict[str, Column] | None = None) -> DataFrame:
    """Audit in one pass: raw rows, rows dropped per reason (first reason wins), rows kept, and kept rows with a mark."""
    remaining = F.lit(True)
    aggregates = [F.count(F.lit(1)).alias("raw_count")]
    for name, condition in reasons.items():
        hit = remaining & F.coalesce(condition, F.lit(False))
        aggregates.append(F.count_if(hit).alias(f"dropped_{name}"))
        remaining = remaining & ~F.coalesce(condition, F.lit(False))
    aggregates.append(F.count_if(remaining).alias("kept_count"))
    aggregates += [F.count_if(remaining & condition).alias(f"kept_{name}") for name, condition in (marks or {}).items()]
    return raw.agg(*aggregates)
