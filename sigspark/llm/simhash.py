"""Near-duplicates by SimHash, searched with anchor points.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link when they
differ in at most three of 64 bits. The search chooses a covering code as anchors and sends every fingerprint to each
anchor within the code's covering radius plus the threshold; whatever lies close enough then meets at an anchor.

Three differing bits leave one half of the 64 with at most one, so each half is searched by itself with threshold one.
Its anchors are the words of the binary Hamming code of length 31, which is perfect with covering radius one: all 2^31
points are at distance one at most from exactly one word. Each fingerprint goes to the words within 1 + 1 bits of its
half (1 word, or 16), the bit left over is not looked at until fingerprints are compared. Any two fingerprints that
differ in one bit of the half meet at the nearest word of either.

At an anchor the components are found by visiting: a fingerprint takes along all that are within three bits of it and
not yet visited, so a dense group of near copies is left after a few rounds, and the links that go on form a forest:
fewer than the anchor's fingerprints, never all pairs. Equal fingerprints are one node from the start.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link like any other; equal
ids with different texts each get their fingerprint; a null id belongs to the component but never names it unless all
its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents, keyed_rows, row_key
from sigspark.llm.components import components
from sigspark.session import persist_table

SHINGLE = 3
SEED = 42
RADIUS = 3
HALF = 31
#: From this many fingerprints at one anchor on they are visited one by one, below that all are compared at once.
DENSE = 48


def shingle_hashes(text: str, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    hashes = [xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; a block at a time, so a very long text needs no more memory."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp) per row; key stands for the row, fp is the fingerprint's 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t)) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), fp], names=["doc_id", "key", "fp"])

    docs = documents(df, doc_id, text).withColumn("key", row_key())
    return docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, fp long")


def syndrome(half: np.ndarray) -> np.ndarray:
    """Of the Hamming code whose check column for bit i (0 to 30) is i + 1: zero for code words, else the one wrong bit's column."""
    out = np.zeros(len(half), np.uint32)
    for i in range(5):
        mask = sum(1 << b for b in range(HALF) if (b + 1) >> i & 1)
        out |= (np.bitwise_count(half & np.uint32(mask)) & 1).astype(np.uint32) << np.uint32(i)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into half, code word) for each word within two bits: the nearest, and if that is one bit off, 15 more."""
    half = half.astype(np.uint32)
    wrong = syndrome(half)
    one = np.uint32(1)
    off = np.flatnonzero(wrong)
    nearest = half.copy()
    nearest[off] ^= one << (wrong[off] - one)
    rows, words = [np.arange(len(half))], [nearest]
    for first in range(1, HALF + 1):  # two flips whose columns add up to the syndrome
        second = wrong[off] ^ np.uint32(first)
        pick = second > first
        rows.append(off[pick])
        words.append(half[off[pick]] ^ (one << np.uint32(first - 1)) ^ (one << (second[pick] - one)))
    return np.concatenate(rows), np.concatenate(words)


def at_anchors(nodes: DataFrame) -> DataFrame:
    """(anchor, fp): every fingerprint at all its anchors of both halves (the second half's anchors are numbered on)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                fp = batch.column("fp").slice(at, 10_000).to_numpy(zero_copy_only=False).view(np.uint64)
                for half in range(2):
                    rows, words = anchors((fp >> np.uint64(32 * half)) & np.uint64((1 << HALF) - 1))
                    anchor = words.astype(np.int64) + (half << HALF)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[rows].view(np.int64))], names=["anchor", "fp"])

    return nodes.mapInArrow(each, "anchor long, fp long")


def near_pairs(anchor: np.ndarray, fp: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Pairs within the radius among the small groups, all groups at once: each row against the next, the one after, ..."""
    found = []
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of < DENSE))
    place = small - np.repeat(starts, sizes)[small]
    left, size_left = fp[small], size_of[small]
    for step in range(1, int(size_left.max(initial=1))):
        ok = place + step < size_left
        a, b = left[ok], fp[small[ok] + step]
        near = np.bitwise_count(a ^ b) <= RADIUS
        found.append(np.stack([a[near], b[near]], 1))
    return found


def forest(fp: np.ndarray) -> np.ndarray:
    """Links that join each component of one anchor's fingerprints: visiting, from one to all near ones not yet visited."""
    left = np.unique(fp)
    links = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue:
            here = queue.pop()
            near = np.bitwise_count(left ^ here) <= RADIUS
            if near.any():
                new = left[near]
                links.append(np.stack([np.full(len(new), here), new], 1))
                queue.extend(new)
                left = left[~near]
    return np.concatenate(links) if links else np.empty((0, 2), np.uint64)


def links_at_anchors(placed: DataFrame) -> DataFrame:
    """(a, b) links that connect whatever is within the radius at some anchor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.uint64)]  # the last anchor may go on in the next batch
        held: list[list[np.ndarray]] = []
        end = pa.RecordBatch.from_pydict({"anchor": [-1], "fp": [0]}, schema=pa.schema([("anchor", pa.int64()), ("fp", pa.int64())]))
        for batch in chain_with(batches, end):
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(anchor):
                continue
            if len(kept[0]) and anchor[0] == kept[0][0] == anchor[-1]:
                held.append([anchor, fp])
                continue
            anchor = np.concatenate([kept[0], *(h[0] for h in held), anchor])
            fp = np.concatenate([kept[1], *(h[1] for h in held), fp])
            held = []
            last = int(np.searchsorted(anchor, anchor[-1])) if anchor[-1] >= 0 else len(anchor) - 1
            kept = [anchor[last:], fp[last:]]
            anchor, fp = anchor[:last], fp[:last]
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(anchor)]).astype(np.int64)
            found = near_pairs(anchor, fp, sizes, starts)
            found += [forest(fp[starts[i] : starts[i] + sizes[i]]) for i in np.flatnonzero(sizes >= DENSE)]
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
            if len(pairs):
                pairs = np.unique(np.sort(pairs.view(np.int64), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return placed.mapInArrow(compare, "a long, b long")


def chain_with(batches: Iterator[pa.RecordBatch], end: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from batches
    yield end


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) links that connect all that are within the radius."""
    placed = at_anchors(nodes)
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(partitions, "anchor").sortWithinPartitions("anchor")
    return links_at_anchors(placed)


def fingerprint_components(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (node, root) of those that have links and are not the root."""
    return components(fingerprint_links(nodes))


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, fp (long), root (the component's smallest fp), component_id (its smallest id) per row."""
    prints = persist_table(fingerprints(df, doc_id, text), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = fingerprint_components(nodes.select("fp"))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(names, "fp").select("doc_id", "key", "fp", "root", "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df less all but one of each component: the row with the smallest id stays (among equal ids one of them, by key)."""
    groups = persist_table(simhash_groups(df, doc_id, text), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
    kept = best.select(F.col("best.key").alias("key"))
    return keyed_rows(df, doc_id, text).join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
