"""Small helpers that the operators share."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.session import persist_table, shared_dir

__all__ = ["documents", "keyed_rows", "persist_table", "row_key", "shared_dir", "table", "worker_memory"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """16 bytes that stand for (id, text): null ids are a value, equal ids with other texts stay apart."""
    doc_id, text = (F.col(x) if isinstance(x, str) else x for x in (doc_id, text))
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(text, F.lit("")))))


def keyed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row): whole rows as one column, so that none of their names can clash with a helper's."""
    return df.select(row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def worker_memory(name: str) -> dict:
    """A dict that this worker process keeps between tasks, until another owner asks for one: a worker is used for one stage
    after the other, and what the stage before kept would only add up. The package's functions travel to workers by value, so
    its modules keep nothing there."""
    home = sys.modules.setdefault("sigspark_worker_memory", ModuleType("sigspark_worker_memory"))
    owned = home.__dict__.setdefault("owned", {})
    for other in [o for o in owned if o != name]:
        owned.pop(other).clear()
    return owned.setdefault(name, {})
