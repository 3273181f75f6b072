"""Suffix-array dedup: remove each byte that a string of LENGTH bytes covers which also starts elsewhere.

A suffix array of all positions would be many times the corpus, so it is kept sparse. Every window of LENGTH bytes has
one anchor: the place of its GRAM-byte gram with the smallest hash (the leftmost of equals). The anchor depends on the
window's bytes alone, so equal windows have equal grams at equal distances, and only suffixes at anchors need sorting.
A run of windows with one anchor is a stretch; the bytes it spans are its surroundings.

1. Stretches are found where the texts are read. Two partly aggregated numbers for each gram hash say whether its
   stretches occur at least twice and whether they differ in their surroundings (128 bits in all). Grams that occur once
   are done: none of their windows repeats. Grams whose stretches are all alike are done too: all their windows repeat.
2. Of the others, one stretch of each kind is sent with its bytes to the place of its leading bytes: Spark samples
   splitters and range-partitions the suffixes by their gram. A gram's suffixes meet in one bucket, so nothing has to be
   compared across a boundary, unless there are more than ``CROWD`` of them (see 4).
3. In a bucket the suffixes that start at a window are sorted by a multikey quicksort whose characters are hashes of
   100-byte tokens: each round orders those still together by the next token and leaves out what has become single.
   What is still together after the last token repeats.
4. For a crowded gram the windows become rows that are counted by a 128-bit digest over all machines. The result is the
   same; ``CROWD`` bounds what a task holds.
5. Spans go back to their texts, are merged, and the texts are cut.

With ``words`` the bytes of each run of that many words that also occurs elsewhere go too, however few bytes it has. The
same search then also runs over texts in which each word (what white space of ASCII parts) is a code of CODE bytes, the
end of its hash; white space between words does not count, and that before and after the run stays.

Defined results: a null text is an empty one; texts shorter than LENGTH bytes stay whole; rows repeated with equal id
and text are two texts and both lose what repeats; matches never cross texts; overlapping matches count; what repeats is
judged on the input. Very long texts are read in overlapping pieces. An empty table gives no rows. If a cut falls into
a character, ``kept_text`` lacks its other bytes, ``kept_sha256`` is over the remaining bytes as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents, keyed_rows, row_key
from sigspark.session import persist_table

LENGTH, GRAM, TOKEN = 400, 64, 100
PLACE_BITS = 31
PIECE = 1 << 18
CROWD = 10_000
#: Windows that are sorted at once.
AT_ONCE = 100_000
#: Bytes that stand for a word, and words that make a gram, where runs of words are searched.
CODE, GRAM_WORDS = 6, 10
#: Bytes of surroundings that are hashed at once.
HASHED = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(1 << 16, n), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


class Hashes:
    """Polynomial hashes of any range of a byte string, each in constant time."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        self.undo = powers(pow(base, -1, 1 << 64), len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.undo[start])


class RowHashes:
    """The same hashes of ranges that stay within one of many rows lying one after the other.

    Powers count from a row's start, so their tables are no longer than the longest row, and the prefix is built some rows at a time.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, base: int) -> None:
        self.base = np.cumsum(sizes) - sizes
        longest = int(sizes.max(initial=0)) + 1
        self.undo = powers(pow(base, -1, 1 << 64), longest)
        power = powers(base, longest)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(self.base, self.base[at] + HASHED)))
            low, high = self.base[at], self.base[to - 1] + sizes[to - 1]
            place = np.arange(low, high) - np.repeat(self.base[at:to], sizes[at:to])
            part = self.prefix[low + 1 : high + 1]
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[place], out=part)
            part += self.prefix[low]
            at = to

    def of(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of bytes start to end of each row."""
        return mix((self.prefix[self.base[row] + end] - self.prefix[self.base[row] + start]) * self.undo[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` values, by running minima of blocks from either side."""
    count = len(values) - width + 1
    padded = np.r_[values, np.full(-len(values) % width, np.uint64(2**64 - 1))].reshape(-1, width)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """Of a byte string: gram hash, anchor, first and last window start and digest of the surroundings, for each stretch."""
    if len(data) < length:
        return None
    one, two = (Hashes(data, b) for b in BASES)
    start = np.arange(len(data) - gram + 1)
    grams = one.of(start, start + gram)
    keyed = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | start.astype(np.uint64)
    place = (sliding_min(keyed, length - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return grams[place[first]], place[first], first, last, two.of(first, last + length)


STRETCH = pa.schema([("h", pa.int64()), ("anchor", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("digest", pa.int64())])


Form = Callable[[bytes], bytes]


def plain(text: bytes) -> bytes:
    """A text is searched as it is; ``word_codes`` is the other form."""
    return text


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_codes(text: bytes, piece: int = PIECE) -> bytes:
    """CODE bytes for each word; a very long text is hashed in pieces."""
    data = np.frombuffer(text, np.uint8)
    start, end = word_places(data)
    out, at = [], 0
    while at < len(start):
        to = int(np.searchsorted(start, start[at] + piece))
        hashes = Hashes(data[start[at] : end[to - 1]], BASES[0]).of(start[at:to] - start[at], end[at:to] - start[at])
        out.append(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes())
        at = to
    return b"".join(out)


def spans_of_words(data: bytes, found: list[dict], words: int) -> list[dict]:
    """Spans of codes as spans of the text's bytes: whole words only, at least ``words`` of them."""
    if not found:
        return []
    start, end = word_places(np.frombuffer(data, np.uint8))
    inner = [(-(-s["start"] // CODE), s["end"] // CODE) for s in found]
    return [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in inner if b - a >= words]


def all_stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE, form: Form = plain) -> DataFrame:
    """(key, h, anchor, first, last, digest) of every text in the given form."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, held = [], [], 0
            for row in range(batch.num_rows):
                data = np.frombuffer(form(batch.column("text")[row].as_py().encode("utf-8")), np.uint8)
                for at in range(0, max(1, len(data) - length + 1), piece):
                    part = stretches(data[at : at + piece + length - 1], length, gram)
                    if part is not None:
                        h, anchor, first, last, digest = part
                        found.append((h, anchor + at, first + at, last + at, digest))
                        rows.append(np.full(len(h), row))
                        held += len(h)
                if held > 50_000 or (row == batch.num_rows - 1 and held):
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32)) for c in columns]
                    keys = batch.column("key").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([keys, *arrays], names=["key", *STRETCH.names])
                    rows, found, held = [], [], 0

    return docs.select("key", "text").mapInArrow(find, "key binary, h long, anchor int, first int, last int, digest long")


def surroundings(docs: DataFrame, kinds: DataFrame, length: int = LENGTH, gram: int = GRAM, form: Form = plain) -> DataFrame:
    """(lead, key, first, anchor, n, bytes) of the chosen stretches (key, first, anchor, last, n)."""
    chosen = kinds.groupBy("key").agg(F.collect_list(F.struct("first", "anchor", "last", "n", "crowded")).alias("chosen")).withColumnRenamed("key", "of")
    joined = docs.join(chosen, docs["key"] == chosen["of"]).select("key", "text", "chosen").dropDuplicates(["key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = form(batch.column("text")[row].as_py().encode("utf-8"))
                chosen = batch.column("chosen")[row].as_py()
                lists = [[c[name] for c in chosen] for name in ("first", "anchor", "n", "crowded")]
                lead = [data[c["anchor"] : c["anchor"] + gram] for c in chosen]
                content = [data[c["first"] : c["last"] + length] for c in chosen]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lead, pa.binary()),
                        pa.array([batch.column("key")[row].as_py()] * len(chosen), pa.binary()),
                        *(pa.array(x, kind) for x, kind in zip(lists, (pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)),
                        pa.array(content, pa.binary()),
                    ],
                    names=["lead", "key", "first", "anchor", "n", "crowded", "bytes"],
                )

    return joined.mapInArrow(cut, "lead binary, key binary, first int, anchor int, n long, crowded boolean, bytes binary")


def repeated_windows(group: np.ndarray, content: list[bytes], distance: np.ndarray, often: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of the windows of rows with equal ``group`` that repeat.

    ``distance``: of the first window to the anchor. ``often``: rows whose windows occur elsewhere anyway; they are
    compared with but not reported. Rows come by group; as many whole groups as make up AT_ONCE windows go together, and
    of a larger group windows at some distances at a time (others cannot be equal).
    """
    counts = np.array([len(c) - length + 1 for c in content])
    data = np.frombuffer(b"".join(content), np.uint8)
    hashes = RowHashes(data, counts + length - 1, BASES[1])
    steps = [*range(0, length, TOKEN), length]
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    out_rows, out_windows = [], []
    bounds, at = [0], 0
    for end in new[1:]:
        if counts[at:end].sum() > AT_ONCE and bounds[-1] != at:
            bounds.append(at)
        if counts[bounds[-1] : end].sum() > AT_ONCE:
            bounds.append(end)
        at = end
    bounds = sorted({*bounds, len(group)})
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        size = counts[low:high]
        widest = int(distance[low:high].max()) + 1
        slices = max(1, -(-int(size.sum()) // AT_ONCE)) if group[low] == group[high - 1] else 1
        for part in range(slices):
            far, near = widest * (part + 1) // slices, widest * part // slices  # distances near <= d < far
            begin = np.clip(distance[low:high] - far + 1, 0, size)
            stop = np.clip(distance[low:high] - near + 1, 0, size)
            n = stop - begin
            row = np.repeat(np.arange(low, high), n)
            window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            together = (group[row].astype(np.int64) << 32) | (distance[row] - window)
            for step, after in zip(steps[:-1], steps[1:], strict=True):
                token = hashes.of(row, window + step, window + after)
                order = np.lexsort((token, together))
                row, window, together, token = row[order], window[order], together[order], token[order]
                fresh = np.r_[True, (together[1:] != together[:-1]) | (token[1:] != token[:-1])] if len(row) else np.empty(0, bool)
                number = np.cumsum(fresh) - 1
                shared = np.bincount(number)[number] > 1 if len(row) else fresh
                row, window, together = row[shared], window[shared], number[shared]
            told = ~often[row]
            out_rows.append(row[told])
            out_windows.append(window[told])
    return np.concatenate(out_rows), np.concatenate(out_windows)


def as_spans(row: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that windows cover, one for each run of overlapping or touching windows."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    fresh = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)]) if len(row) else np.empty(0, int)
    last = np.r_[fresh[1:], len(row)] - 1 if len(row) else fresh
    return row[fresh], start[fresh], start[last] + length


SPANS = "key binary, start int, end int"


def spans_in_buckets(suffixes: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, start, end) from suffixes that are range-partitioned and sorted by their leading bytes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            # all groups but the last are whole once the leading bytes have moved on
            if size >= 2000 and held[0].column("lead")[0] != batch.column("lead")[batch.num_rows - 1]:
                table = pa.Table.from_batches(held)
                lead = table.column("lead").to_pylist()
                cut = next(i for i in range(len(lead) - 1, -1, -1) if lead[i] != lead[-1]) + 1
                yield from resolve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.num_rows for b in held)
        if held:
            yield from resolve(pa.Table.from_batches(held))

    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lead = table.column("lead").to_pylist()
        group = np.cumsum([0, *(a != b for a, b in zip(lead[1:], lead[:-1], strict=True))])
        sizes = np.bincount(group)[group]
        keep = np.flatnonzero(sizes > 1)
        if not len(keep):
            return
        table, group = table.take(pa.array(keep)), group[keep]
        first = table.column("first").to_numpy().astype(np.int64)
        distance = table.column("anchor").to_numpy().astype(np.int64) - first
        often = table.column("n").to_numpy() > 1
        row, window = repeated_windows(group, table.column("bytes").to_pylist(), distance, often, length)
        row, start, end = as_spans(row, first[row] + window, length)
        if len(row):
            keys = table.column("key").combine_chunks().take(pa.array(row))
            yield pa.RecordBatch.from_arrays([keys, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["key", "start", "end"])

    return suffixes.mapInArrow(compare, SPANS)


def spans_of_crowds(suffixes: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for grams with very many suffixes: windows as rows, counted by digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[row].as_py(), np.uint8)
                start = np.arange(len(data) - length + 1)
                d = [pa.array(Hashes(data, b).of(start, start + length).view(np.int64)) for b in BASES]
                key, first, n = (batch.column(c)[row].as_py() for c in ("key", "first", "n"))
                yield pa.RecordBatch.from_arrays(
                    [*d, pa.array([key] * len(start), pa.binary()), pa.array((start + first).astype(np.int32)), pa.array(np.full(len(start), n))], names=["d1", "d2", "key", "start", "n"]
                )

    rows = suffixes.mapInArrow(digests, "d1 long, d2 long, key binary, start int, n long")
    repeated = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return rows.where("n = 1").join(repeated, ["d1", "d2"]).select("key", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, piece: int = PIECE, form: Form = plain) -> DataFrame:
    """(key, start, end) of bytes to remove from texts in the given form; docs: (key, text). Spans may overlap.

    Texts take their form in the worker that searches them: a step of its own would keep a second worker busy for each task.
    """
    found = all_stretches(docs, length, gram, piece, form)
    facts = found.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("digest").alias("d1"), F.max("digest").alias("d2"))
    # written down: so both sides of the join are plain exchanges, and Spark can split the stretches of a frequent gram
    repeated = persist_table(facts.where("times > 1").select(F.col("h").alias("g"), (F.col("d1") != F.col("d2")).alias("mixed")), "grams")
    kept = persist_table(found.join(repeated, found["h"] == repeated["g"]).drop("g"), "stretches")
    mixed = kept.where("mixed")
    choice = F.min(F.struct("key", "first", "anchor", "last")).alias("one")
    kinds = persist_table(mixed.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("n"), choice).select("h", "digest", "n", "one.*"), "kinds")
    crowded = kinds.groupBy("h").agg((F.count(F.lit(1)) > crowd).alias("crowded")).withColumnRenamed("h", "g")
    chosen = kinds.join(crowded, kinds["h"] == crowded["g"]).drop("g")
    suffixes = persist_table(surroundings(docs, chosen, length, gram, form), "suffixes")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = suffixes.where("not crowded").repartitionByRange(buckets, "lead").sortWithinPartitions("lead")
    whole = kept.where("not mixed").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    several = kinds.where("n > 1").select(F.col("h").alias("g"), F.col("digest").alias("d"))
    copies = mixed.join(several, (mixed["h"] == several["g"]) & (mixed["digest"] == several["d"]))
    copied = copies.select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    return whole.unionByName(copied).unionByName(spans_in_buckets(placed, length)).unionByName(spans_of_crowds(suffixes.where("crowded"), length))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def suffix_dedup(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, piece: int = PIECE, words: int | None = None
) -> DataFrame:
    """row (the whole row of df as one column), kept_text, kept_sha256, n_bytes, n_removed, spans (start, end in bytes) for each row.

    ``words``: runs of that many words that repeat are removed as well, whatever their length in bytes.
    """
    docs = documents(df, doc_id, text).select(row_key().alias("key"), "text")
    spans = repeated_spans(docs, length, gram, crowd, piece).withColumn("coded", F.lit(False))
    if words:
        runs = repeated_spans(docs, words * CODE, min(words, GRAM_WORDS) * CODE, crowd, piece, word_codes)
        spans = spans.unionByName(runs.withColumn("coded", F.lit(True)))
    gathered = persist_table(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end", "coded")).alias("found")), "spans")
    joined = keyed_rows(df, doc_id, text).join(gathered, "key", "left").select("row", "found")
    added = "kept_text string, kept_sha256 string, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        names = ["row", *(x.split()[0] for x in added.split(", "))]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = part.column("row")
                texts = rows.flatten()[rows.type.get_field_index(text)].to_pylist()
                out: list[list] = [[] for _ in kinds]
                for whole, found in zip(texts, part.column("found").to_pylist(), strict=True):
                    data, found = (whole or "").encode("utf-8"), found or []
                    in_words = spans_of_words(data, [s for s in found if s["coded"]], words or 0)
                    runs = merged([s for s in found if not s["coded"]] + in_words)
                    edges = [0, *(x for s in runs for x in s), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    values = (kept.decode("utf-8", "ignore"), sha256(kept).hexdigest(), len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in runs])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([rows, *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=names)

    return joined.mapInArrow(cut, f"row {joined.schema['row'].dataType.simpleString()}, {added}")


def without_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, length: int = LENGTH, words: int | None = None
) -> DataFrame:
    """The rows of df with what is kept of their texts; a null text stays null. ``n_chars``: a column to hold the new length."""
    cut = suffix_dedup(df, doc_id, text, length, words=words)
    new = {text: F.when(F.col("row")[text].isNotNull(), F.col("kept_text"))}
    if n_chars:
        new[n_chars] = F.length(new[text]).cast(df.schema[n_chars].dataType)
    return cut.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns))
