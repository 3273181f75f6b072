"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records by a seeded hash into buckets that fit in memory, bucket b into partition b (one exchange, which
Spark keeps on disk). Pass 2 takes one bucket at a time, orders it and permutes it with Spark's ``shuffle``, which is a seeded
Fisher-Yates shuffle. The buckets laid end to end are one random order of all records, which is cut into shards of as many
records each (counts differ by one at most). A bucket so belongs to one shard or to a few neighbours and is written where it
was permuted: records move once.

A retried task makes the same rows again: a bucket is ordered before it is permuted, every bucket has its fixed place
among the partitions and in its partition, and the seed of a permutation depends on nothing else.

Defined results: an empty table gives no rows; a null text has size 8; rows repeated in all their columns each get a
slot of their own (they share a bucket, so a record should have an identifying column); null ids are a value like any
other; columns of the input named ``shard`` or ``slot`` are replaced, all others stay as they are, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20_240_229
BUCKET_BYTES = 32 << 20
#: Beyond so many buckets they grow (100 MB each at 100 TB). It bounds the table of their starts, which every task gets.
MOST_BUCKETS = 1_000_000
MOST_PARTITIONS = 20_000
ADDED = ("shard", "slot")


def bucket_count(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return min(MOST_BUCKETS, max(1, math.ceil(total_bytes / bucket_bytes)))


def external_shuffle(
    records: DataFrame, shards: int, total_bytes: int, key: list[str | Column], seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The records with ``shard`` (0 to shards-1) and ``slot`` (0 to the shard's row count less one).

    ``key``: columns or expressions that identify a record. ``total_bytes``: what all records need in memory, about.
    """
    kept = [c for c in records.columns if c not in ADDED]
    keys = [F.col(f"`{k}`") if isinstance(k, str) else k for k in key]
    buckets = bucket_count(total_bytes, bucket_bytes)
    scattered = records.select(
        F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int").alias("bucket"),
        F.struct(F.xxhash64(*keys, F.lit(seed)).alias("order"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")).alias("item"),
    )
    gathered = (
        scattered.repartitionById(min(buckets, MOST_PARTITIONS), "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("items", seed).alias("items"))
    )
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row a bucket, at most MOST_BUCKETS
    starts = sizes.selectExpr("bucket", "sum(n) over (order by bucket rows unbounded preceding) - n as start", "sum(n) over () as total")
    placed = gathered.join(F.broadcast(starts), "bucket").select("start", "total", F.posexplode("items").alias("at", "item"))
    dealt = placed.selectExpr("item", "start + at as position", "total", f"((start + at) * {int(shards)}) div total as shard")
    first = f"(shard * total + {int(shards) - 1}) div {int(shards)}"
    return dealt.select("item.row.*", F.col("shard").cast("int").alias("shard"), F.expr(f"position - {first}").alias("slot"))


def sized_columns(text: str = "text") -> dict[str, Column]:
    """size (UTF-8 bytes of the text, null: none, plus 8) and the text's CRC-32 (text_crc32)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return {"size": (F.octet_length(body) + 8).cast("long"), "text_crc32": F.crc32(F.encode(body, "UTF-8")).cast("long")}


def sized_records(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size and text_crc32 of each document."""
    return documents.select(F.col(f"`{doc_id}`").alias("doc_id"), *(c.alias(name) for name, c in sized_columns(text).items()))


def shard_table(documents: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, shard, slot. Texts are read but not moved."""
    records = sized_records(documents)
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    return external_shuffle(records, shards, total, ["doc_id", "size", "text_crc32"], seed, bucket_bytes)


def write_shards(
    documents: DataFrame, path: str, shards: int, key: list[str | Column], size: str | Column, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> None:
    """Whole records into ``path/shard=N``, in files whose rows are in shuffled order (column ``slot``).

    ``size``: SQL or an expression for a record's bytes, for example ``octet_length(text) + 8``.
    """
    total = documents.agg(F.coalesce(F.sum(F.expr(size) if isinstance(size, str) else size), F.lit(0)).alias("s")).first()["s"]
    shuffled = external_shuffle(documents, shards, total, key, seed, bucket_bytes)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
