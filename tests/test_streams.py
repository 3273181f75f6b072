"""Upserts of a stream: several batches, a repeated one, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from sigspark.streaming import replay

FIELDS = "ticker string, ts timestamp, impact_score double, sentiment_score double, attribution_weight double"


def rows(day, n, ticker="A"):
    return [(ticker, dt.datetime(2024, 1, day, 12) + dt.timedelta(minutes=i), float(i), 0.5, 1.0) for i in range(n)]


def test_upserts_keep_one_current_row_a_key(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = [rows(2, 3) + rows(3, 1), rows(2, 2, "B") + rows(3, 4), rows(20, 1), rows(21, 1), rows(2, 5)]  # the last batch is late
    for part in parts:
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(source)
    stream = replay.stream_parquet(spark, source, spark.read.parquet(source).schema, max_files=1)
    seen = []

    def twice(path):
        save = replay.batch_writer(path)

        def run(batch, number):
            save(batch, number)
            save(batch, number)  # a retry
            seen.append((number, batch.count()))

        return run

    got = replay.run_upserts(replay.trading_day_totals(stream, delay="2 days"), "totals", ["ticker", "trading_day"], twice)
    want = {("A", dt.date(2024, 1, 2)): 3, ("A", dt.date(2024, 1, 3)): 5, ("B", dt.date(2024, 1, 2)): 2, ("A", dt.date(2024, 1, 20)): 1, ("A", dt.date(2024, 1, 21)): 1}
    assert {(r["ticker"], r["trading_day"]): r["n_signals"] for r in got.collect()} == want
    assert len(seen) >= 5 and sum(n for _, n in seen) == 6  # a batch hands on what it changed only


def test_latest_takes_the_newest_batch(spark):
    table = spark.createDataFrame([("a", 1, 0), ("a", 2, 3), ("a", 9, 1), ("b", 5, 2), (None, 7, 0)], "key string, n int, batch long")
    assert sorted(map(repr, (tuple(r) for r in replay.latest(table, ["key"]).collect()))) == sorted(map(repr, [("a", 2), ("b", 5), (None, 7)]))
    assert replay.latest(table.where(F.lit(False)), ["key"]).count() == 0
