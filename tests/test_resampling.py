"""Exact quantiles, permutations and the interval of a quantile spread against numpy."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import ranking, stats


def rank(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_order_statistics(spark, monkeypatch, bins):
    monkeypatch.setattr(stats, "BINS", bins)
    rng = np.random.default_rng(bins)
    values = np.concatenate([rng.normal(0, 1, 300), np.full(200, 0.25), rng.normal(1e9, 1, 20), [-1e12, 0.0, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    ranks = [0, 1, 100, 250, 251, 400, len(values) - 2, len(values) - 1]
    assert stats.order_statistics(df, "v", ranks) == {r: np.sort(values)[r] for r in ranks}
    some = df.unionByName(spark.createDataFrame([(None,)], "v double"))
    assert stats.quantile_edges(some, "v") == pytest.approx(np.quantile(values, [0.2, 0.4, 0.6, 0.8]))
    assert stats.quantile_edges(df.limit(0), "v") == []
    assert stats.quantile_edges(spark.createDataFrame([(3.0,)] * 5, "v double"), "v") == [3.0] * 4


def study_rows(n=160):
    rng = np.random.default_rng(5)
    days = [dt.date(2022, 1, 3) + dt.timedelta(i // 4) for i in range(n)]
    return [(f"T{i % 4}", d, d - dt.timedelta(d.weekday()), float(np.round(rng.uniform(1, 9), 1)), float(rng.normal()) if i % 9 else None) for i, d in enumerate(days)]


FIELDS = "ticker string, t0 date, week date, x double, y double"


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("split", [False, True])
def test_permutation(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 20)
    rows = study_rows()
    got = stats.permutation_test(spark.createDataFrame(rows, FIELDS), "x", "y", n_perm=50).first()
    full = [r for r in rows if r[4] is not None]
    rx, ry = rank([r[3] for r in full]), rank([r[4] for r in full])
    rhos = []
    for replicate in range(51):
        mixed = np.empty(len(full))
        for ticker in {r[0] for r in full}:
            at = [i for i, r in enumerate(full) if r[0] == ticker]
            drawn = sorted(at, key=lambda i: (md5(42, replicate, ticker, full[i][1]) if replicate else "", full[i][1]))
            mixed[at] = ry[drawn]
        rhos.append(np.corrcoef(rx, mixed)[0, 1])
    assert got["actual_rho"] == pytest.approx(rhos[0]) and got["n_perm"] == 50
    assert got["null_mean"] == pytest.approx(np.mean(rhos[1:])) and got["null_95"] == pytest.approx(np.quantile(rhos[1:], 0.95))
    assert got["p_value"] == pytest.approx((sum(r >= rhos[0] for r in rhos[1:]) + 1) / 51)


@pytest.mark.parametrize("split", [False, True])
def test_interval_of_the_quantile_spread(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 20)
    rows = study_rows()
    got = stats.bootstrap_quantile_spread(spark.createDataFrame(rows, FIELDS), "y", "x", n_boot=60).first()
    weeks = sorted({r[2] for r in rows})

    def spread(some):
        x, y = np.array([r[3] for r in some]), np.array([np.nan if r[4] is None else r[4] for r in some])
        edges = np.quantile(x, np.linspace(0, 1, 6))
        return np.nanmean(y[x > edges[4]]) - np.nanmean(y[x <= edges[1]]) if (np.diff(edges) > 0).all() else np.nan

    values = []
    for replicate in range(60):
        drawn = [weeks[int(md5(42, replicate, slot)[:8], 16) % len(weeks)] for slot in range(len(weeks))]
        values.append(spread([r for w in drawn for r in rows if r[2] == w]))
    known = [v for v in values if not np.isnan(v)]
    assert got["estimate"] == pytest.approx(spread(rows)) and got["n_replicates"] == len(known)
    assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.quantile(known, [0.025, 0.975])))


def test_market_study(spark):
    from sigspark.operators.tickerday import market_study

    rng = np.random.default_rng(6)
    rows = [(float(i % 7), float(a), float(b), abs(float(b))) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    df = spark.createDataFrame(rows, "max_impact_score double, mean_sentiment_score double, spy_ret double, abs_spy_ret double")
    got = {r["pair"]: r for r in market_study(df).collect()}
    for pair, i, j in (("impact_abs_return", 0, 3), ("sentiment_return", 1, 2)):
        assert got[pair]["rho"] == pytest.approx(np.corrcoef(rank([r[i] for r in rows]), rank([r[j] for r in rows]))[0, 1])
        assert got[pair]["n"] == 40 and got[pair]["few"] == 0 and 0 <= got[pair]["p_value"] <= 1
    few = {r["pair"]: r for r in market_study(df.limit(4)).collect()}
    assert all(r["rho"] is None and r["p_value"] is None and r["few"] == 1 for r in few.values())
    assert market_study(df.where(F.lit(False))).count() == 2
