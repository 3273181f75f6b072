"""Near copies by SimHash, and by the exact similarity of word shingles for what fingerprints cannot tell.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at least 0.8. The search is SimHash's,
as in ``simhash``: fingerprints of five-word shingles, anchors of a covering code, and an exact check of each link that an
anchor gives. SimHash does not reach down to 0.8: there fingerprints of 64 bits differ in about ten bits (standard
deviation 3), and no covering by anchors is a search any more at the radius of almost twenty that would take. So the
texts that it leaves apart go on to an exact search, which compares only what no chain of links joins yet.

1. A text's shingles are a set of 64-bit hashes; equal sets are one node (by a 128-bit digest). A node's fingerprint is the
   bitwise majority of its shingles' hashes. Equal fingerprints, and those that meet at an anchor within three bits, are
   candidates; the links that hold are the first components.
2. ``BANDS`` bands of ``ROWS`` min-hashes each stand for a node. A pair of similarity s shares none with probability
   (1 - s^ROWS)^BANDS: at 0.8 about 1.3 in 10 million, less above. Only bands with two nodes or more go on.
3. In a band every node is compared with one pivot, unless a chain of links joins them already or their set sizes forbid
   0.8. There are ``STARS`` such rounds, each with other pivots, so a large group of near copies becomes one component at the
   price of few comparisons for each node. The nodes of bands that still hold several components are then joined by the
   prefixes of their sets: with all shingles in one order, the rarest first, two sets of 0.8 share one of the first
   n - ceil(0.8 n) + 1 shingles of either, and what follows the first such one must be long enough for the overlap that 0.8
   takes. Both rules are exact, so no link is lost, and texts that only share what many others have are no candidates,
   however many there are. Only shingles of such nodes are counted and ordered. No band and no shingle is capped.
4. A comparison is the exact similarity of the two sets. Components of the links are the groups.

Defined results: a null text is an empty one; texts without words are alike; a text of fewer words than a shingle is one
shingle; equal ids with different texts are compared like any others; in a group the row with the smallest id stays (a
null id last, among equal ids one by key); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents, keyed_rows, row_key
from sigspark.llm.components import components
from sigspark.llm.simhash import fingerprint_links, majority, shingle_hashes
from sigspark.session import persist_table

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
STARS = 2
ROUNDING = 1e-6
SEED = 42


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def band_hashes(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """One hash for each band of min-hashes; none for an empty set. A block at a time, so a very long text needs no more memory."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    rng = np.random.default_rng(seed)
    factor, plus, weight, number = (rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(4))
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, (hashes[at : at + (1 << 11), None] * (factor | np.uint64(1)) + plus).min(0))
    least = (least ^ (least >> np.uint64(31))) * (weight | np.uint64(1))
    mixed = (least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + number[:BANDS]
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, key, node, n, fp, bands) per row: digest and size of its set of shingles, the fingerprint, and the bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
                sets = [np.unique(h) for h in hashes]
                arrays = [
                    pa.array([md5(s.astype("<u8").tobytes()).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)),
                    pa.array([band_hashes(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *arrays], names=["doc_id", "key", "node", "n", "fp", "bands"])

    return docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, node binary, n int, fp long, bands array<long>")


def set_table(docs: DataFrame, of: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, hashes) of the chosen rows; of: (key, node)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, width).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    chosen = docs.select("key", "text").join(of, "key").dropDuplicates(["key"]).select("node", "text")
    return chosen.mapInArrow(each, "node binary, hashes array<long>")


def pairs_by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: of (node, fp) the nodes of equal fingerprints, with one of them, and those that anchors bring together."""
    first = persist_table(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = nodes.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a != b")
    one, two = (first.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}")) for side in "ab")
    near = fingerprint_links(first.select("fp")).distinct().join(one, "a").join(two, "b")
    met = near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return equal.unionByName(met).distinct()


def with_roots(shared: DataFrame, linked: DataFrame | None) -> DataFrame:
    if linked is None:
        return shared.withColumn("root", F.col("node"))
    return shared.join(linked, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))


def several_roots() -> Column:
    return (F.min("root") != F.max("root")).alias("differ")


def pairs_with_pivots(shared: DataFrame, linked: DataFrame | None, similarity: float, seed: int) -> DataFrame:
    """(a, b), a < b: each node and the pivot of its band, if no chain of links joins them yet."""
    rooted = with_roots(shared, linked)
    pivot = F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), "node", "n", "root")).alias("p")
    met = rooted.join(rooted.groupBy("band").agg(pivot, several_roots()).where("differ").select("band", "p"), "band")
    likely = F.least("n", F.col("p.n")) / F.greatest("n", F.col("p.n")) >= similarity
    return met.where((F.col("root") != F.col("p.root")) & likely).select(F.least("node", F.col("p.node")).alias("a"), F.greatest("node", F.col("p.node")).alias("b")).distinct()


def prefixes(shared: DataFrame, linked: DataFrame | None, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, n, root, pos, h): of nodes in bands with several components, the shingles of the prefix that another such node has."""
    rooted = with_roots(shared, linked)
    several = rooted.groupBy("band").agg(several_roots()).where("differ").select("band")
    still = persist_table(rooted.join(several, "band", "left_semi").select("node", "n", "root").distinct(), "still")
    shingles = sets.join(still, "node").select("node", "n", "root", F.explode("hashes").alias("h"))
    times = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rarity = F.struct(F.coalesce("times", F.lit(1)).alias("times"), "h")
    ordered = shingles.join(times, "h", "left").groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(rarity)).alias("order"))
    length = F.col("n") - F.ceil(F.col("n") * similarity - ROUNDING).cast("int") + 1
    placed = ordered.select("node", "n", "root", F.posexplode_outer(F.slice("order", 1, length)).alias("pos", "s"))
    return persist_table(placed.where("s.times > 1").select("node", "n", "root", "pos", "s.h"), "prefixes")


def pairs_by_prefix(shared: DataFrame, linked: DataFrame | None, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: nodes that no chain of links joins yet and whose prefixes allow the similarity."""
    one = prefixes(shared, linked, sets, similarity)
    two = one.select("h", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "root", "pos")))
    needed = (F.col("n") + F.col("n2")) * (similarity / (1 + similarity)) - ROUNDING
    enough = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= needed
    met = one.join(two, "h").where((F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & enough)
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def jaccard(one: Column, two: Column) -> Column:
    both = F.size(F.array_intersect(one, two))
    return both / (F.size(one) + F.size(two) - both)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact similarity is high enough."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(two, "b").where(jaccard(F.col("x"), F.col("y")) >= similarity).select("a", "b")


def near_copy_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, stars: int = STARS
) -> DataFrame:
    """doc_id, key, root per row; rows of one root are near copies, directly or by a chain of links."""
    docs = documents(df, doc_id, text).withColumn("key", row_key())
    prints = persist_table(sketches(docs, width), "sketches")
    nodes = prints.groupBy("node").agg(F.min(F.struct("key", "n", "fp", "bands")).alias("one"))
    tested = persist_table(pairs_by_fingerprint(nodes.select("node", F.col("one.fp").alias("fp"))), "pairs")
    placed = nodes.select("node", F.col("one.n").alias("n"), F.explode("one.bands").alias("band"))
    several = placed.groupBy("band").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = persist_table(placed.join(several, "band", "left_semi").select("band", "node", "n"), "bands")
    keys = prints.groupBy("node").agg(F.min("key").alias("key"))
    compared = shared.select("node").unionByName(tested.select(F.col("a").alias("node"))).unionByName(tested.select(F.col("b").alias("node"))).distinct()
    sets = persist_table(set_table(docs, keys.join(compared, "node"), width), "sets")
    linked = components(persist_table(similar(tested, sets, similarity), "similar"))
    for turn in range(stars + 1):
        pairs = pairs_with_pivots(shared, linked, similarity, turn + 1) if turn < stars else pairs_by_prefix(shared, linked, sets, similarity)
        pairs = persist_table(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = persist_table(similar(pairs, sets, similarity), "similar")
        tested = tested.unionByName(pairs)
        if not found.isEmpty():  # what is joined already goes on as stars, which take few rounds
            linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    return prints.select("doc_id", "key", "node").join(linked, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df less all but one of each group: the row with the smallest id stays (among equal ids one of them, by key)."""
    groups = persist_table(near_copy_groups(df, doc_id, text, width, similarity), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
    kept = best.select(F.col("best.key").alias("key"))
    return keyed_rows(df, doc_id, text).join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
