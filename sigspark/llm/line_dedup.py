"""Substring dedup by hashing lines.

Every text is cut at line feeds. A line is normalised (A-Z in lower case, runs of ASCII white space as one blank, ends
trimmed) and known by a 128-bit digest. Over the whole table the earliest occurrence of a digest stays: the one with
the smallest id, then the smallest row key, then the first in its text; all later ones go, in the same text too.

The search is turned round so that a frequent line is no hot spot: one partly aggregated minimum finds each digest's
winner, and it is the winners that go back to their texts, one row for each distinct line, however often it occurs.
Lines of fewer than ``min_words`` words (and blank ones) always stay; they take no part.

Offsets are code points of the original text, end not included; the kept text is the text's other lines, joined by
line feeds.

Defined results: a null text is an empty one, with one empty line that stays; rows repeated with equal id and text are
one document and get the same result; ids may be null (they rank last); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents, row_key

MIN_WORDS = 5
OUTPUT = "kept_text string, removed array<struct<start:int,end:int>>, n_lines int, n_removed_lines int, n_removed long"


def line_digests(text: str, min_words: int) -> Iterator[bytes | None]:
    """Digest of each line, None for one that takes no part."""
    for line in text.encode("utf-8").split(b"\n"):
        words = line.lower().split()
        yield md5(b" ".join(words)).digest() if len(words) >= max(1, min_words) else None


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, nth, digest) of the lines that take part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows, nth, digests = [], [], []
                part = batch.slice(at, 500)
                for row, text in enumerate(part.column("text").to_pylist()):
                    for i, digest in enumerate(line_digests(text, min_words)):
                        if digest:
                            rows.append(row)
                            nth.append(i)
                            digests.append(digest)
                take = pa.array(rows, pa.int32())
                columns = [part.column("doc_id").take(take), part.column("key").take(take), pa.array(nth, pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "nth", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "text").mapInArrow(cut, f"doc_id {kind}, key binary, nth int, digest binary")


def winners(units: DataFrame) -> DataFrame:
    """(key, firsts): for each row the places of its lines that are the earliest occurrence of their digest."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "nth")
    first = units.groupBy("digest").agg(F.min(rank).alias("first"))
    return first.groupBy(F.col("first.key").alias("key")).agg(F.collect_set("first.nth").alias("firsts"))


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, kept_text, removed (start, end of each removed line), n_lines, n_removed_lines, n_removed (code points) per row."""
    docs = documents(df, doc_id, text).withColumn("key", row_key())
    found = winners(line_table(docs, min_words)).withColumnRenamed("key", "win_key")
    joined = docs.join(found, docs["key"] == found["win_key"], "left").select("doc_id", "text", "firsts")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                for whole, firsts in zip(part.column("text").to_pylist(), part.column("firsts").to_pylist(), strict=True):
                    first, kept, removed, start = set(firsts or ()), [], [], 0
                    lines = whole.split("\n")
                    for i, (line, digest) in enumerate(zip(lines, line_digests(whole, min_words), strict=True)):
                        if digest is None or i in first:
                            kept.append(line)
                        else:
                            removed.append({"start": start, "end": start + len(line)})
                        start += len(line) + 1
                    gone = sum(x["end"] - x["start"] for x in removed)
                    for column, value in zip(out, ("\n".join(kept), removed, len(lines), len(removed), gone), strict=True):
                        column.append(value)
                arrays = [pa.array(values, kind) for values, kind in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "kept_text", "removed", "n_lines", "n_removed_lines", "n_removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {kind}, {OUTPUT}")
