"""Sinks: Parquet, JSON lines, CSV, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators.query import SignalFilter, ordered_slice, sanitized, select_signals


def folder_size(spark, path: str) -> int:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength()


def write_parquet(df: DataFrame, path: str, max_bytes: int | None = None, partition_by: list[str] | None = None) -> int:
    """Write and return the size in bytes; over ``max_bytes`` is an error."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    size = folder_size(df.sparkSession, path)
    if max_bytes is not None and size > max_bytes:
        raise ValueError(f"{path} has {size} bytes, more than the limit of {max_bytes}")
    return size


def flatten_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(field.name).alias(field.name) if isinstance(field.dataType, nested) else F.col(field.name) for field in df.schema]
    )


def write_signals(df: DataFrame, path: str, fmt: str = "jsonl") -> int:
    """Write all rows as jsonl, csv or parquet; returns the row count observed on the way."""
    kind = fmt.lower().strip()
    if kind not in ("jsonl", "csv", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}: use jsonl, csv or parquet")
    seen = Observation("rows")
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if kind == "jsonl":
        observed.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        flatten_nested(observed).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        observed.write.mode("overwrite").parquet(path)
    return seen.get["n"]


def export_signals(signals: DataFrame, path: str, fmt: str = "jsonl", where: SignalFilter | None = None,
                   limit: int | None = None, offset: int = 0) -> int:
    """Filtered export. Without limit and offset every matching row is written, unordered and in parallel; else exactly the rows asked for."""
    rows = select_signals(signals, where) if limit is None and offset == 0 else ordered_slice(signals, where, limit, offset)
    return write_signals(sanitized(rows), path, fmt)


def long_metrics(df: DataFrame, suite: str, keys: list[str] | None = None) -> DataFrame:
    """Result table -> (suite, key, metric, value) rows."""
    keys = keys or []
    numeric = [f.name for f in df.schema if f.name not in keys and isinstance(f.dataType, T.NumericType)]
    entries = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value")) for name in numeric])
    label = F.concat_ws("|", *[F.col(key).cast("string") for key in keys]) if keys else F.lit("all")
    return df.select(F.lit(suite).alias("suite"), label.alias("key"), F.explode(entries).alias("_m")).select("suite", "key", "_m.*")


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
