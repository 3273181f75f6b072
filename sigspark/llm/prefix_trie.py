"""Prefix trie of conversations, by collapse of whole sequences.

Texts do not travel. A turn becomes a digest of role and text and a count of code points, and a sequence of turns is known
by a polynomial of its digests modulo the prime 2^127 - 1. That hash composes: from those of two runs of turns follows that
of the one after the other, and a prefix can be taken out of it again. So the turns of all conversations are put in order by
ranges, whatever conversation they belong to, every range is folded in its own task, and one row a range carries the fold
over its edges: a conversation may have any number of turns. For the same reason a rebuilt conversation (turns of another
one, then its own) gets its prefixes without being put together.

1. Identical rebuilt conversations collapse into one weighted sequence with the list of its conversations' ids.
2. Prefixes are made for one conversation of each sequence. Sequences that are among the proper prefixes of others are
   dropped by an anti-join; the rest are the leaves.
3. A node is a distinct (depth, hash). Weights added up give its members. Sums over subtrees need no walk: a sequence that
   passes through a node has all its later turns in the subtree, so they are sums over sequences. To count a shared turn
   once, each node belongs to the sequence of its smallest member, whose nodes are then the lower end of its path.

An end list is hashed as a stream: ids are put in order by ranges, joined to strings of some thousand in their ranges, and
the task that hashes a list reads those strings one after the other.

Defined results: turns are in order of turn (null first), then role and digest of the text; null role or text is empty; rows
with a null conversation id belong to no conversation; rows repeated in all columns are turns of their own; an empty table
gives no rows, not even a root; further columns are ignored, whatever they are called. Hashes of 127 bits stand for equal
sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import persist_table

PRIME = (1 << 127) - 1
FACTOR = int.from_bytes(hashlib.md5(b"prefix trie").digest(), "big") % PRIME
NOTHING = bytes(16)
SHARED_SPAN, SHARED_AT_MOST = 100, 6
#: Ids of an end list that are joined to one string.
IDS_A_STRING = 4096
EARLY = "struct<at:long,before:binary,hash:binary,chars:long,turn_chars:long>"


def number(hash_: bytes) -> int:
    return int.from_bytes(hash_, "big")


def joined(first: int, second: int, length: int) -> int:
    """Hash of one run of turns followed by another, which has ``length`` turns."""
    return (first * power(length) + second) % PRIME


POWERS = 4096


def power(n: int, _kept: list[int] = []) -> int:  # noqa: B006  one list for the process
    if n >= POWERS:
        return pow(FACTOR, n, PRIME)
    while len(_kept) <= n:
        _kept.append(_kept[-1] * FACTOR % PRIME if _kept else 1)
    return _kept[n]


def turn_rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, digest, chars)"""
    role_, text_ = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)))
    return df.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), role_.alias("role"), F.md5(text_).alias("text_md5"),
        digest.alias("digest"), F.char_length(text_).cast("long").alias("chars"),
    )


def fold_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running number, hash and code points of each conversation's turns in this range of the order."""
    piece = TaskContext.get().partitionId()
    conv, at, hash_, chars = None, 0, 0, 0
    for batch in batches:
        rows: list[tuple] = []
        for c, digest, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "digest", "chars"))):
            if c != conv:
                conv, at, hash_, chars = c, 0, 0, 0
            before = hash_
            at, hash_, chars = at + 1, (hash_ * FACTOR + number(digest)) % PRIME, chars + n
            rows.append((c, at, before.to_bytes(16, "big"), hash_.to_bytes(16, "big"), chars, n))
        if rows:
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([piece] * len(rows), pa.int32()), *columns], names=["piece", *PREFIX_NAMES])


PREFIX_NAMES = ["conv_id", "at", "before", "hash", "chars", "turn_chars"]
PREFIXES = "conv_id long, at long, before binary, hash binary, chars long, turn_chars long"


def own_prefixes(turns: DataFrame) -> DataFrame:
    """Every conversation's prefixes: number of turns, hash without and with the last, code points in all and in the last."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_md5")]
    folded = persist_table(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(fold_ranges, f"piece int, {PREFIXES}"), "turn-prefixes")
    tail = F.max_by(F.struct("at", "hash", "chars"), F.struct("conv_id", "at"))
    edges = folded.groupBy("piece").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), tail.alias("tail")).orderBy("piece").collect()  # one row a range
    carried: dict[int, tuple[int, int, int, int]] = {}
    for left, right in zip(edges, edges[1:]):
        if left["last"] == right["first"]:
            at, hash_, chars = left["tail"]["at"], number(left["tail"]["hash"]), left["tail"]["chars"]
            if left["first"] == left["last"] and left["piece"] in carried:
                _, at0, hash0, chars0 = carried[left["piece"]]
                at, hash_, chars = at0 + at, joined(hash0, hash_, at), chars0 + chars
            carried[right["piece"]] = (right["first"], at, hash_, chars)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece, c, at, before, hash_, chars, n in zip(*(batch.column(x).to_pylist() for x in ("piece", *PREFIX_NAMES))):
                conv, at0, hash0, chars0 = carried[piece]
                if c == conv:
                    before = joined(hash0, number(before), at - 1).to_bytes(16, "big")
                    hash_ = joined(hash0, number(hash_), at).to_bytes(16, "big")
                    at, chars = at + at0, chars + chars0
                rows.append((c, at, before, hash_, chars, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=PREFIX_NAMES)

    if not carried:
        return folded.select(PREFIX_NAMES)
    cut = F.col("piece").isin(list(carried))
    return folded.where(~cut).select(PREFIX_NAMES).unionByName(folded.where(cut).mapInArrow(carry, PREFIXES))


def shared_turns(conv_id: Column) -> Column:
    """How many of the first turns a conversation takes from another one."""
    return (F.crc32(F.encode(conv_id.cast("string"), "UTF-8")) % SHARED_AT_MOST).cast("long")


def rebuilt(prefixes: DataFrame) -> DataFrame:
    """(conv_id, h, taken, end, head, cut) of each conversation.

    ``taken``: the prefixes that come from conversation c - c % 100, at most h; ``end``: all own turns; ``head``: the longest of ``taken``; ``cut``: the own prefix that it replaces.
    """
    mark = F.struct("at", "hash", "chars")
    early = F.when(F.col("at") < SHARED_AT_MOST, F.struct("at", "before", "hash", "chars", "turn_chars"))
    convs = prefixes.groupBy("conv_id").agg(F.sort_array(F.collect_list(early)).alias("early"), F.max_by(mark, F.col("at")).alias("end"))  # at most five early ones
    heads = convs.select(F.col("conv_id").alias("base"), F.col("early").alias("theirs"))
    h = shared_turns(F.col("conv_id"))
    met = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % SHARED_SPAN}).join(heads, "base", "left")
    taken = F.slice(F.coalesce("theirs", F.array().cast(f"array<{EARLY}>")), F.lit(1), F.col("h").cast("int"))
    last = lambda items: F.get(items, F.size(items) - 1)  # noqa: E731  null for no items
    return met.select("conv_id", "h", taken.alias("taken"), "early", "end").select(
        "conv_id", "h", "taken", "end",
        _mark(last(F.col("taken"))).alias("head"),
        _mark(last(F.expr("slice(early, 1, cast(h as int))"))).alias("cut"),
    )


def _mark(item: Column) -> Column:
    return F.struct(
        F.coalesce(item["at"], F.lit(0)).cast("long").alias("at"), F.coalesce(item["hash"], F.lit(NOTHING)).alias("hash"), F.coalesce(item["chars"], F.lit(0)).cast("long").alias("chars")
    )


def moved(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Own prefixes (at, before, hash, chars) with the own first turns (``cut``) replaced by others (``head``)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [c for c in rows.columns if c not in ("head", "cut")]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in kept}
            new: dict[str, list] = {c: [] for c in fields}
            for head, cut, *values in zip(*(batch.column(c).to_pylist() for c in ("head", "cut", *fields))):
                row = dict(zip(fields, values))
                apart = (number(head["hash"]) - number(cut["hash"])) % PRIME
                steps = row["at"] - cut["at"]
                if "before" in row:
                    row["before"] = joined(apart, number(row["before"]), steps - 1).to_bytes(16, "big")
                row["hash"] = joined(apart, number(row["hash"]), steps).to_bytes(16, "big")
                row["at"], row["chars"] = row["at"] - cut["at"] + head["at"], row["chars"] - cut["chars"] + head["chars"]
                for c in fields:
                    new[c].append(row[c])
            for c in fields:
                columns[c] = pa.array(new[c], batch.column(c).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(move, ", ".join(f"{c} {kinds[c]}" for c in kept))


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, hash, conv_id) -> (depth, hash, ends_sha256): hash of the ascending decimal ids, comma-joined."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for depth, hash_, conv in zip(*(batch.column(x).to_pylist() for x in ("depth", "hash", "conv_id"))):
                if (depth, hash_) != key or len(ids) == IDS_A_STRING:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (depth, hash_), []
                ids.append(conv)
            yield _batch(out, END_STRINGS)
            out = []
        yield _batch([(*key, ids[0], ",".join(map(str, ids)))] if ids else [], END_STRINGS)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for depth, hash_, part in zip(*(batch.column(x).to_pylist() for x in ("depth", "hash", "ids"))):
                if (depth, hash_) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (depth, hash_), hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
            yield _batch(out, END_HASHES)
            out = []
        yield _batch([(*key, sha.hexdigest())] if key else [], END_HASHES)

    order = ["depth", "hash", "conv_id"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(strings, "depth long, hash binary, first long, ids string")
    return parts.repartition("depth", "hash").sortWithinPartitions("depth", "hash", "first").mapInArrow(hashes, "depth long, hash binary, ends_sha256 string")


END_STRINGS = pa.schema([("depth", pa.int64()), ("hash", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
END_HASHES = pa.schema([("depth", pa.int64()), ("hash", pa.binary()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    prefixes = own_prefixes(turn_rows(df, conv_id, turn, role, text))
    made = rebuilt(prefixes)

    # 1. whole sequences; a conversation's end moves as its prefixes do, unless all its turns are replaced
    longer = F.col("end.at") > F.col("h")
    ends = moved(made.where(longer).select("conv_id", "h", "taken", "head", "cut", "end.at", "end.hash", "end.chars", F.struct("head", "cut").alias("shift")), ["at", "hash", "chars"])
    short = made.where(~longer).select("conv_id", "h", "taken", "head.at", "head.hash", "head.chars", F.struct("head", "cut").alias("shift"))
    whole = persist_table(ends.unionByName(short), "whole-sequences")
    sequences = persist_table(
        whole.groupBy(F.col("at").alias("depth"), "hash").agg(
            F.count(F.lit(1)).alias("weight"), F.min(F.struct("conv_id", "h", "taken", "chars", "shift")).alias("least")
        ), "weighted-sequences",
    )

    # 2. prefixes of one conversation a sequence: the root, the taken turns, the own ones
    one = sequences.select(F.col("least.conv_id").alias("seq"), F.col("least.h").alias("h"), "weight", F.col("depth").alias("end"), F.col("least.chars").alias("all_chars"), "least.taken", "least.shift")
    fixed = ["seq", "weight", "end", "all_chars"]
    root = one.select(*fixed, F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(NOTHING).alias("hash"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("turn_chars"))
    first = one.select(*fixed, F.inline("taken")).select(*fixed, F.col("at").alias("depth"), F.col("before").alias("parent"), "hash", "chars", "turn_chars")
    own = prefixes.join(one.drop("taken"), prefixes["conv_id"] == one["seq"]).where("at > h")
    own = moved(own.select(*fixed, "at", "before", "hash", "chars", "turn_chars", "shift.head", "shift.cut"), ["at", "before", "hash", "chars"])
    own = own.select(*fixed, F.col("at").alias("depth"), F.col("before").alias("parent"), "hash", "chars", "turn_chars")
    paths = persist_table(root.unionByName(first).unionByName(own), "sequence-prefixes")
    proper = paths.where("depth < end").select("depth", "hash").distinct()
    leaves = sequences.join(proper, ["depth", "hash"], "left_anti").select(F.col("least.conv_id").alias("seq"), F.lit(1).cast("long").alias("leaf"))

    # 3. nodes; each belongs to its smallest member, whose own nodes begin at some depth of its path
    nodes = persist_table(
        paths.groupBy("depth", "hash").agg(
            F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("parent").alias("parent"), F.max(F.col("chars") - F.col("turn_chars")).alias("chars_before")
        ), "trie-nodes",
    )
    begins = nodes.groupBy(F.col("conv_id").alias("seq")).agg(F.min("chars_before").alias("own_from"))
    about = one.select("seq").join(begins, "seq", "left").join(leaves, "seq", "left")
    below = (
        paths.join(about, "seq")
        .withColumn("chars_before", F.col("chars") - F.col("turn_chars"))
        .groupBy("depth", "hash")
        .agg(
            F.sum(F.col("weight") * (F.col("all_chars") - F.col("chars_before"))).alias("with_copies"),
            F.sum(F.col("all_chars") - F.greatest(F.coalesce("own_from", "all_chars"), "chars_before")).alias("once"),
            F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        )
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("hash")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hash").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    lists = end_lists(whole.select(F.col("at").alias("depth"), "hash", "conv_id"))
    return (
        nodes.join(parents, ["depth", "parent"], "left")
        .join(below, ["depth", "hash"])
        .join(children, ["depth", "hash"], "left")
        .join(lists, ["depth", "hash"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
            (F.col("with_copies") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
