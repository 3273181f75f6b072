"""Benchmark decontamination: SimHash of item-sized windows, searched by Hamming blocks, then verified exactly.

Texts and benchmark items become lower-cased words (letters and digits) and five-word shingles. For an item with m
shingles every run of m shingles of a document is a window. A window and an item match when their weighted similarity,
the sum of the smaller over the sum of the larger numbers of occurrences of each shingle, is at least 0.8.

The search has three steps, all of them DataFrame functions:

1. Anchors. A window without any of the items' shingles has similarity zero, so positions are looked up in the items'
   shingles, and of the windows only those that begin at a found position are kept: moving a window's begin up to the
   next found position loses none of the shingles that count. Of those, a window that holds fewer than 0.8 m found
   shingles cannot reach 0.8. Both rules lose no match.
2. Fingerprints. Window and items get 64-bit SimHashes over the found shingles, an occurrence a vote (a shingle no item
   has weighs nothing). Fingerprints are compared within ``RADIUS`` bits: cut into RADIUS + 1 blocks, two of them agree
   in one block at least, so an equi-join on (m, block, its bits) gives every pair within the radius; a pair counts in
   the first block that agrees. At similarity 0.8 fingerprints differ in seven bits on average, the radius is 15.
3. Verification. The exact similarity of each candidate.

Only the items' shingles are sent to all executors, in blocks of at most ``BLOCK`` rows, one pass for each block.

Defined results: a null text is an empty one and matches nothing, nor does an item without words; a text or an item of
fewer than five words is one shingle; a window at the end of a text may be shorter; rows repeated with equal id and text
give one match an item; null ids stay null; equal items each match; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents, keyed_rows, row_key
from sigspark.session import fits, persist_table

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 15
BLOCK = 1_000_000
BITS = 64


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_shingles(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the hashes of the shingles of ``text``, in order, in place of the text."""
    hashed = df.withColumn("_words", word_hashes(F.col(text))).drop(text)
    shingle = lambda i: F.xxhash64(*(F.get("_words", i + j) for j in range(WIDTH)))
    many = F.transform(F.sequence(F.lit(0), F.size("_words") - WIDTH), shingle)
    shingles = F.when(F.size("_words") >= WIDTH, many).when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<long>"))
    return hashed.withColumn(name, shingles).drop("_words")


def simhash(votes: Column) -> Column:
    """Bitwise majority of an array of hashes."""
    more = lambda b: F.size(F.filter(votes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(votes)
    bit = lambda acc, b: acc.bitwiseOR(F.when(more(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), bit)


def block_bits(fp: Column, block: int) -> Column:
    """The bits of one of the RADIUS + 1 blocks."""
    low, high = BITS * block // (RADIUS + 1), BITS * (block + 1) // (RADIUS + 1)
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def blocks(fp: Column) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), block_bits(fp, b).alias("bits")) for b in range(RADIUS + 1)))


def first_agreement(left: Column, right: Column) -> Column:
    return F.coalesce(*(F.when(block_bits(left, b) == block_bits(right, b), b) for b in range(RADIUS + 1)))


def common_weight(window: Column, item: Column) -> Column:
    """Sum over shingles of the smaller number of occurrences."""
    count = lambda values, h: F.size(F.filter(values, lambda x: x == h))
    shared = F.array_intersect(window, item)
    repeats = (F.size(F.array_distinct(window)) < F.size(window)) & (F.size(F.array_distinct(item)) < F.size(item))
    slow = F.aggregate(shared, F.lit(0), lambda acc, h: acc + F.least(count(window, h), count(item, h)))
    return F.when(repeats, slow).otherwise(F.size(shared))


def item_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, item: shingles, m, item_fp) of the items that have words, written down: later steps read it several times."""
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shingled = with_shingles(named, "text", "item").where(F.size("item") > 0)
    return persist_table(shingled.select("item_id", "item", F.size("item").alias("m"), simhash(F.col("item")).alias("item_fp")), "items")


def anchors(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, n, pos, h, sizes): positions of documents with a shingle of some item, and the sizes of such items."""
    vocabulary = persist_table(items.select(F.explode("item").alias("h"), "m").groupBy("h").agg(F.collect_set("m").alias("sizes")), "shingles")
    passes = max(1, math.ceil(vocabulary.count() / block))
    # outer: for a plain explode Spark infers a filter on the array and pushes it under the words, which would then be cut
    # again for each shingle
    placed = with_shingles(docs, "text", "s").select("doc_id", "key", F.size("s").alias("n"), F.posexplode_outer("s").alias("pos", "h"))
    found = None
    for at in range(passes):
        part = placed.join(F.broadcast(vocabulary.where(F.pmod("h", F.lit(passes)) == at)), "h")
        found = part if found is None else found.unionByName(part)
    return found


def windows(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, m, pos, total, win): windows of m shingles that begin at a found position and may reach the similarity."""
    sized = found.select("doc_id", "key", "n", F.struct("pos", "h").alias("at"), F.explode("sizes").alias("m"))
    gathered = sized.groupBy("doc_id", "key", "n", "m").agg(F.sort_array(F.collect_set("at")).alias("found"))

    def window(at: Column, i: Column) -> Column:
        inside = F.filter(F.slice("found", i + 1, F.col("m")), lambda x: x["pos"] < at["pos"] + F.col("m"))
        return F.struct(at["pos"].alias("pos"), F.transform(inside, lambda x: x["h"]).alias("win"))

    enough = lambda w: F.size(w["win"]) >= F.ceil(F.col("m") * similarity)
    each = gathered.select("doc_id", "key", "n", "m", F.explode_outer(F.filter(F.transform("found", window), enough)).alias("w")).where("w is not null")
    return each.select("doc_id", "key", "m", "w.pos", F.least("m", F.col("n") - F.col("w.pos")).alias("total"), "w.win")


def matches(
    df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """doc_id, key, item_id, similarity, first_shingle: the best window of each document for each item it matches."""
    docs = documents(df, doc_id, text).withColumn("key", row_key())
    known = item_table(items, item_id, item_text)
    printed = windows(anchors(docs, known), similarity).withColumn("fp", simhash(F.col("win")))
    searched = printed.withColumn("b", F.explode_outer(blocks(F.col("fp")))).select("*", "b.*").drop("b")
    index = known.withColumn("b", F.explode_outer(blocks(F.col("item_fp")))).select("*", "b.*").drop("b")
    near = searched.join(index, ["m", "block", "bits"]).where(
        (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (first_agreement(F.col("fp"), F.col("item_fp")) == F.col("block"))
    )
    shared = near.withColumn("shared", common_weight(F.col("win"), F.col("item")))
    alike = shared.withColumn("similarity", F.col("shared") / (F.col("total") + F.col("m") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("pos")).alias("minus")))
    return alike.groupBy("doc_id", "key", "item_id").agg(best.alias("best")).select(
        "doc_id", "key", "item_id", "best.similarity", (-F.col("best.minus")).alias("first_shingle")
    )


def drop_contaminated(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", most_sent: int = BLOCK) -> DataFrame:
    """The rows of df that match no item. The matched rows' keys go to all executors if there are at most ``most_sent`` of them."""
    gone = persist_table(matches(df, items, doc_id, text).select("key").distinct(), "contaminated")
    return keyed_rows(df, doc_id, text).join(F.broadcast(gone) if fits(gone, most_sent) else gone, "key", "left_anti").select("row.*")
