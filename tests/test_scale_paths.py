"""The paths taken by large groups give the same rows as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigspark.streaming.stateful import fill_to_one
from sigspark.config import PortfolioParams
from sigspark.functions import pattern_index
from sigspark.operators import classify
from sigspark.operators import portfolio as pf
from sigspark.operators import ranking, sampling, stats
from sigspark.sources import readers


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"id": range(600), "g": rng.integers(0, 3, 600), "week": rng.integers(0, 9, 600), "x": rng.integers(0, 40, 600) / 4.0, "y": rng.normal(size=600)})
    frame["y"] = frame["y"] + frame["x"] * 0.1
    return frame, spark.createDataFrame(frame)


def test_few_texts_of_a_batch_are_python_objects(monkeypatch):
    taken = []

    class Column(list):
        def slice(self, at, n):
            return Column(self[at : at + n])

        def to_pylist(self):
            taken.append(len(self))
            return list(self)

    got = pattern_index.by_parts(lambda t, k: [{"event_type": t, "rule": k, "term": t, "weight": 1.0}] if t else [], classify.HITS, Column(["x", None] * 450), Column(range(900)))
    assert max(taken) <= pattern_index.ROWS < 900 and len(got) == 900
    assert got.to_pylist()[898] == [{"event_type": "x", "rule": 898, "term": "x", "weight": 1.0}] and got.to_pylist()[899] == []
    assert len(pattern_index.by_parts(lambda t: [], classify.HITS, Column())) == 0


def test_large_tables_spread_into_more_parts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one file")
    spark.range(5000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert readers.spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(readers, "PART_BYTES", 500)
    parts = readers.spread(df, "id").rdd.getNumPartitions()
    assert parts == readers.file_bytes(spark, df.inputFiles()) // 500 > spark.sparkContext.defaultParallelism
    assert readers.spread(df, "id").count() == 5000


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_split_ranks_equal_window_ranks(numbers, groups):
    frame, df = numbers
    points = {"x": [1.0, 3.0, 7.0], "y": [-0.5, 0.5, 1.0]}
    split = {tuple(r[g] for g in groups): r["rho"] for r in stats.spearman(df, "x", "y", groups, points=points).collect()}
    plain = {tuple(r[g] for g in groups): r["rho"] for r in stats.spearman(df, "x", "y", groups).collect()}
    for key, part in (frame.groupby("g") if groups else [((), frame)]):
        expected = part["x"].rank().corr(part["y"].rank())
        key = (key,) if groups else key
        assert split[key] == pytest.approx(expected, abs=1e-12)
        assert plain[key] == pytest.approx(expected, abs=1e-12)


def test_row_numbers_in_pieces(numbers):
    _, df = numbers
    rows = df.withColumns({"s0": -F.floor("x"), "s1": -F.floor(F.abs("y") * 2), "h": F.xxhash64("id"), "key": F.col("id").cast("string")})
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"))
    cut = ranking.row_numbers(rows, ["g"], ["s0", "s1"], [F.floor(F.col("s0") / 3)], "h", "key", sizes, limit=199)
    expected = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("s0", "s1", "h", "key")))
    assert {(r["id"], r["rank"]) for r in cut.collect()} == {(r["id"], r["rank"]) for r in expected.collect()}


def test_driving_signals_in_pieces(spark):
    rng = np.random.default_rng(2)
    n = 400
    frame = pd.DataFrame({
        "text_id": [f"t{i}" for i in range(n)], "t0": ["d1"] * 300 + ["d2"] * 100, "ticker": "T",
        "sentiment_score": rng.choice([0.0, 0.1, 0.5, -0.6, 0.9], n), "impact_score": rng.choice([2.0, 2.5, 8.0], n), "attribution_weight": 1.0,
    })
    df = spark.createDataFrame(frame)
    plain = {(r["text_id"], r["rank"]) for r in pf.driving_signals(df).collect()}
    cut = {(r["text_id"], r["rank"]) for r in pf.driving_signals(df, one_task_rows=50).collect()}
    assert plain == cut


def test_top_k_is_exact(numbers):
    frame, df = numbers
    got = ranking.top_k(df, ["g"], [F.desc("y"), F.asc("id")], 7, 7, F.col("id"))
    expected = frame.sort_values(["g", "y"], ascending=[True, False]).groupby("g").head(7)
    assert {r["id"] for r in got.collect()} == set(expected["id"])


def test_p_value_and_partial(spark, numbers):
    rows = [(0.1592, 2072), (-0.3304, 61), (None, 10), (1.0, 10), (0.5, 2), (0.5, 3), (0.5, 4), (0.5, 5)]
    p = [r["p_value"] for r in stats.with_p_value(spark.createDataFrame(rows, "rho double, n long")).collect()]
    assert p[0] == pytest.approx(3.08e-13, rel=0.05) and p[1] == pytest.approx(0.0093, abs=2e-4)
    assert p[2] is None and p[3] == 0.0 and p[4] is None
    assert p[5:] == pytest.approx([2 / 3, 0.5, 0.3910022], abs=1e-6)
    frame, df = numbers
    driven = df.withColumns({"a": F.col("x") + F.rand(1), "b": F.col("x") + F.rand(2)})
    row = stats.partial_spearman(driven, "a", "b", "x").first()
    assert abs(row["partial_rho"]) < 0.2 < row["xy"]


def test_resampling_invariants(numbers):
    _, df = numbers
    ci = stats.bootstrap_spearman(df, "x", "y", n_boot=60).first()
    assert ci["ci_low"] <= ci["estimate"] <= ci["ci_high"] and ci["n_replicates"] == 60
    again = stats.bootstrap_spearman(df, "x", "y", n_boot=60).first()
    assert again == ci
    mean = stats.bootstrap_mean_difference(df, "y", F.col("x") > 5, F.col("x") <= 5, n_boot=200).first()
    assert mean["ci_low"] < mean["estimate"] < mean["ci_high"]
    few = stats.bootstrap_spearman(df.withColumn("week", F.col("g") % 2), "x", "y", n_boot=10).first()
    assert few["ci_low"] == few["estimate"] == few["ci_high"]
    test = stats.permutation_test(df, "x", "y", "g", "id", n_perm=50).first()
    assert test["n_perm"] == 50 and 0 < test["p_value"] <= 1 and abs(test["null_mean"]) < test["actual_rho"]


def test_projection(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.exponential(1.0, 5).tolist()) for i in range(40)] + [(40, [10.0, 0.001, 0.001, 0.001, 0.001])]
    df = spark.createDataFrame(rows, "i int, w array<double>")
    got = {r["i"]: r["p"] for r in df.select("i", pf.project_bounded(F.col("w"), 0.1, 0.4).alias("p")).collect()}
    for i, w in rows:
        result, clipped = np.array(got[i]), np.clip(np.array(w) / np.sum(w), 0.1, 0.4)
        assert result.sum() == pytest.approx(1.0) and result.min() > 0.1 - 1e-9 and result.max() < 0.4 + 1e-9
        # all weights moved the same way by one amount, but for those that a bound stopped on the way
        moved = result - clipped
        free = (result > 0.1 + 1e-6) & (result < 0.4 - 1e-6)
        amount = moved[np.abs(moved).argmax()]
        assert moved[free] == pytest.approx(np.full(free.sum(), amount), abs=1e-8)
        assert (moved * np.sign(amount) > -1e-9).all()
        assert result == pytest.approx(fill_to_one(np.array(w) / np.sum(w), 0.1, 0.4), abs=1e-8)


def test_bounds_must_be_feasible():
    with pytest.raises(ValueError):
        PortfolioParams(min_weight_mult=1.5)


def filled_to_level(counts, quotas, target):
    """Whether a common level explains the quotas: whole months below it, the level (or one more, first months first) above."""
    if sum(counts) <= target:
        return quotas == counts
    cut = [q for q, n in zip(quotas, counts) if q < n]
    level = min(cut)
    ones = [q - level for q, n in zip(quotas, counts) if n > level]
    return sum(quotas) == target and ones == sorted(ones, reverse=True) and set(ones) <= {0, 1} and all(q == n for q, n in zip(quotas, counts) if n <= level)


def test_month_quotas_fill_to_a_level(spark):
    rng = np.random.default_rng(4)
    groups = {f"g{i}": rng.integers(1, 60, 6).tolist() for i in range(25)}
    rows = [(g, f"2024-{m + 1:02d}", int(n)) for g, ns in groups.items() for m, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "g string, m string, n bigint")
    got = {}
    for r in sampling.month_quotas(df, "g", "m", "n", 100).orderBy("g", "m").collect():
        got.setdefault(r["g"], []).append(r["quota"])
    assert all(filled_to_level(ns, got[g], 100) for g, ns in groups.items())


def test_samples_have_exact_size_and_repeat(numbers):
    _, df = numbers
    rows = df.select(F.col("id").cast("string").alias("text_id"), F.concat(F.lit("s"), "g").alias("event_type"), F.lit("a").alias("source"))
    for make in (
        lambda: sampling.stratified_sample(rows, 101, "event_type"),
        lambda: sampling.uniform_sample(rows, 101),
        lambda: sampling.rare_preserving_sample(rows, 101, ("s0",)),
        lambda: sampling.rare_preserving_sample(rows, 301, ("s0",)),
    ):
        first, second = make().collect(), make().collect()
        assert len(first) in (101, 301) and sorted(first) == sorted(second)
        assert len({r["text_id"] for r in first}) == len(first)
