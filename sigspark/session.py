"""Session settings and the shared scratch folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

BATCH_BYTES = str(4 << 20)

_fallback_dirs: dict[str, str] = {}


def build_session(app: str = "sigspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC; the session must agree or day boundaries move."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python workers in batches of a few megabytes: 10,000 rows, the usual bound, are as large as their texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder, ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in for it on a local master; on a cluster the
    machines would not see each other's files, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        app_id = spark.sparkContext.applicationId
        if app_id not in _fallback_dirs:
            _fallback_dirs[app_id] = tempfile.mkdtemp(prefix="sigspark-")
        base = _fallback_dirs[app_id]
    return f"{base.rstrip('/')}/sigspark-{name}-{uuid.uuid4().hex[:12]}"


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back (survives executor loss)."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], fields: list[tuple[str, str]]) -> DataFrame:
    """A small table from driver values, as one JSON literal: no Python workers, no extra job.

    Only for rows whose number was checked before; numbers keep their exact value.
    """
    names = [name for name, _ in fields]
    payload = json.dumps([dict(zip(names, row)) for row in rows], default=str)
    schema = f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in fields)}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(payload), schema)))


def fits(df: DataFrame, limit: int) -> bool:
    """Does the table have at most ``limit`` rows? Counts no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit
