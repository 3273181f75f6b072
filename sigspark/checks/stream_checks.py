"""Streaming operators; each runs over the whole table until no input is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.checks import text_sql  # noqa: F401  (defines the linking SQL)
from sigspark.checks.portfolio_checks import BASE, prepared
from sigspark.checks.registry import query, wrap
from sigspark.checks.views import PARAMS, UNIVERSE, signals, signals_from, sql_with, table, texts
from sigspark.operators import portfolio as pf
from sigspark.session import persist_table, shared_dir
from sigspark.streaming import replay, stateful

WINDOW = """SELECT ticker, CAST(ts + INTERVAL 3 HOUR AS DATE) AS trading_day, count(*) AS n_signals, max(impact_score) AS max_impact,
  sum(sentiment_score * attribution_weight) / sum(attribution_weight) AS mean_sentiment FROM signals_v GROUP BY ALL"""


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = replay.stream_parquet(spark, folder, schema, name="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("trading_day_window", wrap(sql_with("signals_v", WINDOW), "max_impact mean_sentiment", "n_signals"))
def trading_day_window(spark, folder):
    """Batch form of the windowed stream."""
    return replay.trading_day_totals(signals(spark, folder))


@query("stream_trading_day", wrap(sql_with("signals_v", WINDOW), "max_impact mean_sentiment", "n_signals"))
def stream_trading_day(spark, folder):
    """The same windows on a stream of four micro-batches, each of which changes every window; each is written twice, as after a retry."""
    path = shared_dir(spark, "event-parts")
    rows = table(spark, folder, "events")
    for part in range(4):
        rows.where(F.pmod("event_id", F.lit(4)) == part).coalesce(1).write.mode("append").parquet(path)
    stream = replay.stream_parquet(spark, path, rows.schema, max_files=1).withColumn("ts", F.col("ts").cast("timestamp"))
    totals = replay.trading_day_totals(signals_from(stream), delay="60 days")

    def twice(folder_):
        save = replay.batch_writer(folder_)

        def save_twice(batch, number):
            batch.persist()
            save(batch, number)
            save(batch, number)
            batch.unpersist()

        return save_twice

    return replay.run_upserts(totals, "day-totals", ["ticker", "trading_day"], twice)


@query("stream_replay", sql_with("signals_v", "SELECT text_id, ticker FROM signals_v WHERE ts >= TIMESTAMP '2024-01-10' AND ticker = 'TK02'"))
def stream_replay(spark, folder):
    stream = signals_from(event_stream(spark, folder)).filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return replay.run_to_table(stream.filter("ticker = 'TK02'").select("text_id", "ticker"), "replay")


@query("stream_dedupe", """SELECT count(DISTINCT event_id) AS n_kept, count(*) AS n_of_them_in_input, user_id, event_type FROM (
  SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type) GROUP BY user_id, event_type""")
def stream_dedupe(spark, folder):
    """One row per key within the watermark (longer than the data here), and that row is one of the key's own."""
    stream = replay.dedupe_stream(event_stream(spark, folder), ["user_id", "event_type"], delay="60 days")
    kept = replay.run_to_table(stream.select("event_id", "user_id", "event_type"), "dedupe")
    own = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.lit(1).alias("own"))
    return kept.join(own, ["event_id", "user_id", "event_type"], "left").groupBy("user_id", "event_type").agg(
        F.count_distinct("event_id").alias("n_kept"), F.count("own").alias("n_of_them_in_input")
    )


@query("stream_enrich", sql_with("classified", "SELECT text_id, primary_ticker, event_type FROM classified"))
def stream_enrich(spark, folder):
    """Linking and classification on a stream equal the batch result."""
    path = shared_dir(spark, "texts")
    texts(spark, folder).write.parquet(path)
    stream = replay.stream_parquet(spark, path, spark.read.parquet(path).schema)
    return replay.run_to_table(replay.enrich(stream).select("text_id", "primary_ticker", "event_type"), "enrich")


@query("stream_trailing_volume", wrap(sql_with("signals_v", """
SELECT ticker, date, volume, coalesce(avg(volume) OVER w, 0) AS mean_volume, coalesce(stddev_samp(volume) OVER w, 0) AS std_volume, count(volume) OVER w AS n_days
FROM (SELECT ticker, CAST(ts AS DATE) AS date, count(*) AS volume FROM signals_v GROUP BY ALL)
WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""),
    "mean_volume std_volume", "volume n_days"))
def stream_trailing_volume(spark, folder):
    """Trailing volume from state equals the window form; the days come out of order, over four micro-batches."""
    daily = signals(spark, folder).groupBy("ticker", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("volume"))
    rows = daily.select("ticker", F.col("day").cast("timestamp").alias("day_start"), "volume")
    stream = out_of_order(rows, "ticker", "day_start", "volume")
    result = replay.run_to_table(stateful.trailing_volume_stream(stream, delay="60 days"), "volume")
    zero = F.lit(0.0)
    return result.withColumns({"mean_volume": F.coalesce("mean_volume", zero), "std_volume": F.coalesce("std_volume", zero)})


def out_of_order(rows, key, day, value):
    """A stream of the rows, one file a micro-batch: every third day each, the latest first; a last file of heartbeats moves the watermark."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "days")
    stored = persist_table(rows.select(key, day, value), "days-in-order")
    for part in (2, 1, 0):
        stored.where(F.pmod(F.datediff(day, F.lit("1970-01-01")), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(path)
    later = F.timestamp_add("DAY", F.lit(100), F.max(day)).alias(day)
    beats = stored.groupBy(key).agg(later).withColumn(value, F.lit(None).cast(stored.schema[value].dataType))
    beats.coalesce(1).write.mode("append").parquet(path)
    return replay.stream_parquet(spark, path, stored.schema, max_files=1)


@query("stream_rebalance", wrap(sql_with("weights", "SELECT t0, ticker, score, weight, turnover FROM weights"), "score weight turnover"))
def stream_rebalance(spark, folder):
    """Incremental rebalancing from state equals the batch path; the days come out of order, over four micro-batches."""
    dense = pf.dense_scores(pf.daily_scores(prepared(spark, folder), BASE), UNIVERSE)
    days = dense.groupBy("t0").agg(F.array_sort(F.collect_list(F.struct("ticker", "raw_score"))).alias("s"))
    rows = days.select(F.lit("main").alias("portfolio"), F.col("t0").cast("timestamp").alias("t0"), F.transform("s", lambda e: e["raw_score"]).alias("scores"))
    stream = out_of_order(rows, "portfolio", "t0", "scores")
    return replay.run_to_table(stateful.rebalance_stream(stream, PARAMS, delay="60 days"), "rebalance").drop("portfolio")
