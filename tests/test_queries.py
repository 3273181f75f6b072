"""Registered queries against their SQL, on the smallest driver tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = [
    "signal_emission", "entity_links", "event_classes", "url_merge", "two_stage_dedupe", "cross_label_merge", "publisher_suffix",
    "ticker_day_sentiment", "event_window_car", "spearman_impact", "partial_spearman", "impact_quintiles", "market_day",
    "volume_signal", "broadcast_impact", "capped_path", "driving_signal_ranks", "performance_metrics", "day_story",
    "month_quotas", "crosstab_cube", "metrics_by_source", "model_scores", "stream_trading_day", "stream_rebalance", "export_limit", "cached_scores", "lexicon_sentiment", "wide_to_long_prices",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(frame):
    out = []
    for record in frame[sorted(frame.columns)].itertuples(index=False):
        values = []
        for value in record:
            if value is None or value != value:
                values.append("null")
            elif isinstance(value, (float, np.floating)):
                values.append(f"{value:.6f}")
            else:
                values.append(str(value)[:10] if hasattr(value, "year") else str(value))
        out.append(tuple(values))
    return sorted(out)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_placebo_and_variants(spark):
    placebo = entry.queries()["placebo_rho"](spark, FOLDER).first()
    assert placebo["n_perm"] == 1000 and 0 < placebo["p_value"] <= 1
    variants = {r["scenario"]: r for r in entry.queries()["scenario_variants"](spark, FOLDER).collect()}
    assert set(variants) == {"baseline", "exclusion", "symmetric", "negative_only", "high_confidence"}
