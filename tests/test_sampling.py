"""Samples from one scan against sorting the whole table."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sigspark.operators import sampling

FIELDS = "text_id string, source string, event_type string, ts timestamp, tags array<string>"
RARE = ("War", "Default")


def rows_of(n):
    kinds = ["Other"] * 14 + ["Deal", "Deal", None, "War", "Default", "Law"]
    return [(f"id{i:04d}", ["a", "b", None][i % 7 % 3], kinds[i * 7919 % 20], None, [str(i)] if i % 2 else None) for i in range(n)]


def drawn(row):
    return hashlib.md5(f"42|{row[0]}".encode()).hexdigest(), row[0]


def proportional(rows, target, stratum, least=0):
    """The rows that their stratum's quota takes."""
    groups = {}
    for r in rows:
        if stratum(r) is not None:
            groups.setdefault(stratum(r), []).append(r)
    total = sum(map(len, groups.values()))
    return [r for g in groups.values() for r in sorted(g, key=drawn)[: max(least, round(len(g) / total * target))]]


def plain_stratified(rows, target):
    taken = proportional(rows, target, lambda r: r[2])
    left = sorted((r for r in rows if r not in taken), key=lambda r: r[0])
    return (sorted(taken, key=lambda r: r[0]) + left)[:target] if len(taken) <= target else sorted(taken, key=lambda r: r[0])[:target]


def plain_rare(rows, target):
    rare = sorted((r for r in rows if r[2] in RARE), key=drawn)[:target]
    rest, needed = [r for r in rows if r[2] not in RARE], target - len(rare)
    taken = sorted(proportional(rest, needed, lambda r: None if None in (r[1], r[2]) else (r[1], r[2]), 1), key=drawn) if needed else []
    left = sorted((r for r in rest if r not in taken), key=drawn)
    return rare + (taken + left)[:needed]


@pytest.mark.parametrize("held", [10, 50_000])
@pytest.mark.parametrize("n,target", [(700, 90), (700, 7), (700, 650), (30, 40), (0, 5), (700, 65)])
def test_samples_equal_sorting_everything(spark, monkeypatch, held, n, target):
    monkeypatch.setattr(sampling, "HELD_ROWS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    rows = rows_of(n)
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    told = lambda found: sorted(map(repr, (tuple(r) for r in found)))
    try:
        assert told(sampling.stratified_sample(df, target, "event_type").collect()) == told(plain_stratified(rows, target))
        assert told(sampling.rare_preserving_sample(df, target, RARE).collect()) == told(plain_rare(rows, target))
        assert told(sampling.uniform_sample(df, target).collect()) == told(sorted(rows, key=drawn)[:target])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_candidates_come_from_one_scan_and_stay_few(spark):
    df = spark.createDataFrame(rows_of(700), FIELDS).repartition(4)
    parts = sampling.lowest_rows(df, [F.col("event_type")], "text_id", 42, 5)
    assert parts.agg(F.sum("n")).first()[0] == 700
    assert parts.count() <= 4 * 6 * 5  # tasks, strata with null, rows of each
    assert set(parts.columns) == {"stratum", "drawn", "n", "by_key", "row"}
