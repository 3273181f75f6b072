"""Structured Streaming: replay, stateless enrichment, dedupe, trading-day windows.

The batch operators are DataFrame -> DataFrame and run unchanged on streams; what is here
adds sources, watermarks and sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import Dictionary, EventRules
from sigspark.operators.classify import classify_events
from sigspark.operators.linking import link_entities
from sigspark.session import shared_dir


def stream_parquet(spark: SparkSession, path: str, schema, max_files: int | None = None, name: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, optionally only those matching ``name``."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def enrich(texts: DataFrame, dictionary: Dictionary | None = None, rules: EventRules | None = None) -> DataFrame:
    """Linking and classification: the batch operators, no state."""
    return classify_events(link_entities(texts, dictionary), rules)


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "2 days") -> DataFrame:
    """First row per key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def trading_day_window(ts: str = "ts", cutoff_hour: int = fv.CUTOFF_HOUR_UTC):
    """Daily window that opens at the cutoff, so it ends with the trading day."""
    return F.window(ts, "1 day", "1 day", f"{cutoff_hour} hours")


def trading_day_totals(signals: DataFrame, ts: str = "ts", keys: list[str] | None = None, delay: str | None = None) -> DataFrame:
    """Counts and weighted sentiment per trading day; with ``delay`` a streaming aggregation."""
    source = signals.withWatermark(ts, delay) if delay else signals
    weight = F.col("attribution_weight")
    grouped = source.groupBy(trading_day_window(ts), *(keys or ["ticker"])).agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.max("impact_score").alias("max_impact"),
        (F.sum(F.col("sentiment_score") * weight) / F.sum(weight)).alias("mean_sentiment"),
    )
    return grouped.withColumn("trading_day", F.to_date("window.end")).drop("window")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available now into a Parquet table in the shared folder."""
    spark = stream.sparkSession
    path, state = shared_dir(spark, f"{name}-data"), shared_dir(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def batch_writer(path: str):
    """For ``foreachBatch``: each micro-batch in a folder of its own, named by its number. A batch that is run again writes
    the same folder again, so a retry leaves one copy."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return save


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table of batches: a partly aggregated maximum of the batch number."""
    values = [name for name in table.columns if name not in (*keys, "batch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*[F.col(name) if name in keys else F.col(f"_row.{name}") for name in table.columns if name != "batch"])


def run_upserts(stream: DataFrame, name: str, keys: list[str], save_with=batch_writer) -> DataFrame:
    """Process everything available now in update mode; the current row of each key.

    Every micro-batch adds the rows that it changed, so a batch costs what it changes, not the whole result, and windows
    behind the watermark leave the state.
    """
    spark = stream.sparkSession
    path, state = shared_dir(spark, f"{name}-batches"), shared_dir(spark, f"{name}-state")
    query = (
        stream.writeStream.outputMode("update").foreachBatch(save_with(path)).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", batch long"
    return latest(spark.read.schema(schema).parquet(path), keys)
