"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces of a vocabulary file and their stored scores are used as a unigram model: of all ways to cut a text into
pieces the one with the largest sum of scores is taken; between equal sums, seen from the end, the longer last piece. A
character that no piece holds costs the smallest score less ten and becomes byte pieces. As the library does it, a blank
is written as U+2581 and one is put before the text; an empty text has no pieces. (The library itself cuts by merges if
the file says so; with the same file read as a unigram model it gives these very ids, which the tests check, as long as
its sums in single precision are exact. Here sums are doubles.)

Where U+2581 follows another character no piece can cross (this is looked up in the vocabulary), so between such cuts
words are solved one by one and a repeated word is looked up. A giant text is split into chunks, at a cut if there is
one in the chunk's later half and anywhere otherwise:

1. Each chunk gives a transfer matrix: the best sum from each state at its left boundary (how many characters the piece
   across the boundary has before it) to each state at its right one. Sums add and alternatives compete, so matrices
   combine associatively: blocks of neighbours are combined side by side, the same way again over the blocks until one
   is left, and the best sums at each boundary are handed down through the blocks.
2. With these, each chunk tells for each state at its right boundary the state at its left one that leads there; these
   maps are combined from the right, in blocks as well.
3. Each chunk is traced back by itself from its own right state, and the ids are put together.

Only a block of matrices or maps meets in one place, whatever the length of a text.

Decoding puts pieces and bytes together, writes U+2581 as a blank and takes off the one in front; bytes that are no UTF-8
become U+FFFD, and so does a null or an id that the vocabulary does not have; null ids give an empty text. Defined results: a null
text is an empty one; U+2581 in a text comes back as a blank, as with the library; repeated rows are encoded alike; null
ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents, row_key, worker_memory
from sigspark.llm.token_cache import vocabulary_path
from sigspark.session import persist_table

BLANK = "▁"
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
CHUNK = 32_768
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
#: Values that a step of the scan combines in one task.
SCAN_BLOCK = 64
#: Words that a worker remembers at most, and the longest of them; others are solved each time.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64


@dataclass
class Vocabulary:
    """Pieces with scores. ``known``: the id of a piece. ``trie``: by character the branch and the score of the piece that ends there, or None."""

    spelled: list[bytes]
    known: dict[str, int]
    trie: dict[str, tuple[dict, float | None]]
    unknown: float
    byte_ids: list[int]
    longest: int
    cuts: bool
    memory: dict[str, tuple[float, bytes]] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """The vocabulary of a file; a worker reads it once and keeps it, with the words it has solved."""
        kept = worker_memory("vocabularies")
        if path not in kept:
            kept[path] = Vocabulary.read(path)
        return kept[path]

    @staticmethod
    def read(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known: dict[str, int] = {}
        spelled, bytes_at, scores, trie = [], {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_at[int(piece[1:-1], 16)] = i
                spelled.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(BLANK, " ").encode("utf-8"))
                scores.append(model.get_score(i))
                known[piece] = i
                branch = trie
                for at, character in enumerate(piece):
                    below, score = branch.get(character, ({}, None))
                    branch[character] = below, scores[-1] if at == len(piece) - 1 else score
                    branch = below
        cuts = not any(BLANK in p.lstrip(BLANK) for p in known)
        byte_ids = [bytes_at.get(b, model.unk_id()) for b in range(256)]
        return Vocabulary(spelled, known, trie, min(scores) - UNKNOWN_PENALTY, byte_ids, max(map(len, known)), cuts)

    def forward(self, text: str, entry: list[float]) -> tuple[list[float], list[int]]:
        """Best sums and last begins at all places of a text. ``entry``: sums at its first places; the text goes on behind them."""
        head, n, trie = len(entry) - 1, len(text), self.trie
        best, back = entry + [NEVER] * (n - head), [-1] * (n + 1)
        for i in range(n):
            here = best[i]
            if here == NEVER:
                continue
            branch, alone = trie, False
            for j in range(i, n):
                found = branch.get(text[j])
                if found is None:
                    break
                branch, score = found
                if score is not None:
                    alone = alone or j == i
                    if j >= head and here + score > best[j + 1]:
                        best[j + 1] = here + score
                        back[j + 1] = i
            if not alone and i >= head and here + self.unknown > best[i + 1]:
                best[i + 1] = here + self.unknown
                back[i + 1] = i
        return best, back

    def trace(self, text: str, back: list[int], end: int, head: int = 0) -> tuple[list[int], int]:
        """Ids of the pieces that end behind ``head``, and the place where the first of them begins."""
        parts = []
        while end > head:
            piece = text[back[end] : end]
            found = self.known.get(piece)
            parts.append([found] if found is not None else [self.byte_ids[b] for b in piece.encode("utf-8")])
            end = back[end]
        return [i for part in reversed(parts) for i in part], end

    def word(self, word: str) -> tuple[float, bytes]:
        """Best sum and packed ids of a whole word."""
        found = self.memory.get(word)
        if found is None:
            found = self.solve(word)
            if len(self.memory) < REMEMBERED and len(word) <= LONGEST_REMEMBERED:
                self.memory[word] = found
        return found

    def solved(self, words: list[str]) -> list[tuple[float, bytes]]:
        """``word`` of each; what is remembered costs a look-up only."""
        get, word = self.memory.get, self.word
        return [get(w) or word(w) for w in words]

    def solve(self, word: str) -> tuple[float, bytes]:
        """``forward`` and ``trace`` of a text that begins at a boundary: every place is reached, and none lies in a context."""
        n, trie, known, unknown = len(word), self.trie, self.known, self.unknown
        best, back = [0.0, *[NEVER] * n], [0] * (n + 1)
        for i in range(n):
            here, branch, j = best[i], trie, i
            for character in word[i:]:
                found = branch.get(character)
                if found is None:
                    break
                branch, score = found
                j += 1
                if score is not None and here + score > best[j]:
                    best[j], back[j] = here + score, i
            if word[i] not in known and here + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + unknown, i
        ids, end = [], n
        while end:
            start = back[end]
            found = known.get(word[start:end])
            if found is not None:
                ids.append(found)
            else:
                ids += [self.byte_ids[b] for b in reversed(word[start:end].encode("utf-8"))]
            end = start
        ids.reverse()
        return best[n], array("i", ids).tobytes()

    def words(self, text: str) -> list[str]:
        return WORDS.findall(text) if self.cuts else [text] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids that the vocabulary has."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def written(text: str) -> str:
    return (BLANK + text.replace(" ", BLANK)) if text else ""


def chunks(text: str, size: int, cuts: bool) -> list[tuple[int, int, bool]]:
    """(start, end, open at the end) of a written text's chunks."""
    out, at = [], 0
    while len(text) - at > size:
        end, is_open = at + size, True
        if cuts:
            for i in range(end, at + size // 2, -1):
                if text[i] == BLANK and text[i - 1] != BLANK:
                    end, is_open = i, False
                    break
        out.append((at, end, is_open))
        at = end
    return [*out, (at, len(text), False)]


@dataclass
class Chunk:
    """A chunk cut at its words: an open head, whole words, an open tail (either may be missing)."""

    v: Vocabulary
    context: str
    text: str
    open_left: bool
    open_right: bool

    def __post_init__(self) -> None:
        words = self.v.words(self.text)
        starts_with_cut = self.text[:1] == BLANK and self.context[-1:] != BLANK
        self.head = self.context + words.pop(0) if self.open_left and not (starts_with_cut and self.v.cuts) else None
        self.tail = words.pop() if self.open_right and words else None
        self.middle = words
        self.through = self.head is not None and self.open_right and self.tail is None and not words  # no cut inside
        self.states = self.v.longest

    def entry(self, sums: list[float]) -> list[float]:
        """Sums by state -> sums at the places of the context, the boundary last."""
        return [sums[len(self.context) - p] for p in range(len(self.context) + 1)]

    def exits(self, best: list[float], text: str, low: int) -> list[float]:
        """Sums at the right boundary's states; only places from ``low`` on belong to this chunk's own end."""
        n = len(text)
        return [best[n - x] if n - x >= low else NEVER for x in range(self.states)]

    def transfer(self) -> np.ndarray:
        """The matrix of best sums, left states x right states."""
        out = np.full((self.states, self.states), NEVER)
        middle = sum([best for best, _ in self.v.solved(self.middle)])
        tail = [0.0, *[NEVER] * (self.states - 1)]
        if self.tail is not None:
            tail = self.exits(self.v.forward(self.tail, [0.0])[0], self.tail, 0)
        for state in range(self.states):
            if self.head is None:
                into = 0.0 if state == 0 else NEVER
            elif state > len(self.context):
                into = NEVER
            else:
                unit = [NEVER] * self.states
                unit[state] = 0.0
                best = self.v.forward(self.head, self.entry(unit))[0]
                if self.through:
                    # a place of the context that is still within reach behind a short chunk stays a state
                    out[state] = self.exits(best, self.head, 0)
                    continue
                into = best[-1]
            out[state] = into + middle + np.array(tail)
        return out

    def left_states(self, sums: list[float]) -> list[int]:
        """For each right state the left state that the best way there comes from."""
        if self.head is None:
            return [0] * self.states
        c = len(self.context)
        back = self.v.forward(self.head, self.entry(sums))[1]
        n = len(self.head)
        if not self.through:
            return [c - self.v.trace(self.head, back, n, c)[1]] * self.states
        return [c - (self.v.trace(self.head, back, n - x, c)[1] if n - x > c else n - x) if n - x >= 0 else 0 for x in range(self.states)]

    def ids(self, sums: list[float], right: int) -> list[int]:
        """Ids of the pieces that end in this chunk, up to its right state."""
        out: list[int] = []
        if self.head is not None:
            c = len(self.context)
            back = self.v.forward(self.head, self.entry(sums))[1]
            out += self.v.trace(self.head, back, len(self.head) - (right if self.through else 0), c)[0]
        out += np.frombuffer(b"".join([ids for _, ids in self.v.solved(self.middle)]), "i4").tolist()
        if self.tail is not None:
            back = self.v.forward(self.tail, [0.0])[1]
            out += self.v.trace(self.tail, back, len(self.tail) - right)[0]
        return out


CHUNK_FIELDS = "key binary, nth int, context string, body string, open_left boolean, open_right boolean"


def chunk_of(v: Vocabulary, row: dict) -> Chunk:
    return Chunk(v, row["context"], row["body"], row["open_left"], row["open_right"])


def chunk_table(giants: DataFrame, name: str, size: int) -> DataFrame:
    """The chunks of the texts (key, text) as rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(vocabulary_path(name))
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole, was_open = written(text), False
                for nth, (start, end, is_open) in enumerate(chunks(whole, size, v.cuts)):
                    context = whole[max(0, start - v.longest + 1) : start]
                    row = {"key": key, "nth": nth, "context": context, "body": whole[start:end], "open_left": was_open, "open_right": is_open}
                    was_open = is_open
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("key", pa.binary()), ("nth", pa.int32()), ("context", pa.string()), ("body", pa.string()), ("open_left", pa.bool_()), ("open_right", pa.bool_())]))

    return giants.mapInArrow(split, CHUNK_FIELDS)


def per_chunk(table: DataFrame, name: str, result: str, kind: str, work) -> DataFrame:
    """(key, nth, result) with work(chunk, row) for each chunk."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(vocabulary_path(name))
        types = {"double": pa.list_(pa.float64()), "int": pa.list_(pa.int32())}
        for batch in batches:
            for row in batch.to_pylist():
                value = work(chunk_of(v, row), row)
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]], pa.binary()), pa.array([row["nth"]], pa.int32()), pa.array([value], types[kind])], names=["key", "nth", result])

    return table.mapInArrow(each, f"key binary, nth int, {result} array<{kind}>")


@dataclass(frozen=True)
class Scan:
    """What a scan combines and carries on; both are arrays of ``element``. ``compose`` takes two neighbours, the left one first."""

    element: str
    backward: bool
    start: Callable[[np.ndarray], np.ndarray]
    carry: Callable[[np.ndarray, np.ndarray], np.ndarray]
    compose: Callable[[np.ndarray, np.ndarray], np.ndarray]


def square(flat: np.ndarray) -> np.ndarray:
    states = int(np.sqrt(len(flat)))
    return flat.reshape(states, states)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product of two flat matrices, a middle state at a time."""
    one, two = square(left), square(right)
    best = np.full(one.shape, NEVER)
    for middle in range(len(one)):
        np.maximum(best, one[:, middle, None] + two[middle], out=best)
    return best.ravel()


def first_sums(matrix: np.ndarray) -> np.ndarray:
    return np.where(np.arange(len(square(matrix))) == 0, 0.0, NEVER)


#: The best sums at each chunk's left boundary, and each chunk's right state (an array of one), from the last chunk to the first.
SUMS = Scan("double", False, first_sums, lambda sums, matrix: (sums[:, None] + square(matrix)).max(0), product)
STATES = Scan("int", True, lambda mapping: np.zeros(1, np.int32), lambda state, mapping: mapping[state], lambda left, right: left[right])


def scan(values: DataFrame, how: Scan, block: int | None = None) -> DataFrame:
    """(key, nth, value) -> (key, nth, carried): what comes to each value from those before it (``backward``: behind it).

    The values of ``block`` neighbours are combined into one, blocks side by side; the same scan over these tells what
    comes to each block, and from there each block is walked by itself. No task holds more than a block of values.
    """
    block = block or SCAN_BLOCK

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values("nth", ascending=not how.backward)

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for value in map(np.asarray, in_order(rows)["value"]):
            total = value if total is None else how.compose(value, total) if how.backward else how.compose(total, value)
        return pd.DataFrame({"key": [key[0]], "nth": [key[1]], "value": [total.tolist()]})

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = in_order(rows), []
        carried = rows["entry"].iloc[0]
        for value in map(np.asarray, rows["value"]):
            carried = how.start(value) if carried is None else np.asarray(carried)
            out.append(carried.tolist())
            carried = how.carry(carried, value)
        return pd.DataFrame({"key": rows["key"].to_numpy(), "nth": rows["nth"].to_numpy(), "carried": out})

    last = values.agg(F.max("nth").alias("last")).first()["last"] or 0
    placed = values.withColumn("block", (F.col("nth") / block).cast("int"))
    if last < block:
        placed = placed.withColumn("entry", F.lit(None).cast(f"array<{how.element}>"))
    else:
        combined = placed.groupBy("key", "block").applyInPandas(combine, f"key binary, nth int, value array<{how.element}>")
        entries = scan(persist_table(combined, "combined"), how, block)
        placed = placed.join(entries.select("key", F.col("nth").alias("block"), F.col("carried").alias("entry")), ["key", "block"])
    return persist_table(placed.groupBy("key", "block").applyInPandas(walk, f"key binary, nth int, carried array<{how.element}>"), "carried")


def giant_ids(giants: DataFrame, name: str, size: int) -> DataFrame:
    """(key, ids) of giant texts, by the scan."""
    table = persist_table(chunk_table(giants, name, size), "chunks")
    matrices = per_chunk(table, name, "value", "double", lambda c, row: c.transfer().ravel().tolist())
    sums = scan(persist_table(matrices, "matrices"), SUMS).withColumnRenamed("carried", "sums")
    with_sums = table.join(sums, ["key", "nth"])
    maps = per_chunk(with_sums, name, "value", "int", lambda c, row: c.left_states(row["sums"]))
    states = scan(persist_table(maps, "maps"), STATES).select("key", "nth", F.col("carried")[0].alias("right"))
    parts = per_chunk(with_sums.join(states, ["key", "nth"]), name, "part", "int", lambda c, row: c.ids(row["sums"], row["right"]))
    return parts.groupBy("key").agg(F.expr("flatten(transform(array_sort(collect_list(struct(nth, part))), x -> x.part))").alias("ids"))


ENCODED = "ids array<int>, n_tokens int, exact boolean"


def encode(df: DataFrame, name: str, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_tokens, exact (do the ids decode to the text) per row. ``name``: a vocabulary file's name."""
    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    giant = F.length("text") > size
    giants = docs.where(giant).select(row_key().alias("key"), "doc_id", "text")

    def finish(v: Vocabulary, doc_ids: pa.Array, texts: list[str], packed: list[np.ndarray]) -> pa.RecordBatch:
        exact = [v.decode(ids.tolist()) == t.replace(BLANK, " ") for ids, t in zip(packed, texts, strict=True)]
        offsets = np.cumsum([0, *map(len, packed)]).astype(np.int32)
        values = pa.array(np.concatenate([np.empty(0, np.int32), *packed]).astype(np.int32))
        arrays = [doc_ids, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(np.diff(offsets).astype(np.int32)), pa.array(exact, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_tokens", "exact"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(vocabulary_path(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column("text").to_pylist()
                packed = [np.frombuffer(b"".join([ids for _, ids in v.solved(v.words(written(t)))]), "i4") for t in texts]
                yield finish(v, part.column("doc_id"), texts, packed)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(vocabulary_path(name))
        for batch in batches:
            packed = [np.array(x, np.int32) for x in batch.column("ids").to_pylist()]
            yield finish(v, batch.column("doc_id"), batch.column("text").to_pylist(), packed)

    small = docs.where(~giant).mapInArrow(solve, f"doc_id {kind}, {ENCODED}")
    by_scan = giant_ids(giants.select("key", "text").dropDuplicates(["key"]), name, size)
    large = giants.join(by_scan, "key").select("doc_id", "text", "ids").mapInArrow(check, f"doc_id {kind}, {ENCODED}")
    return small.unionByName(large)


def decode(df: DataFrame, name: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text per row: the text that the row's ids stand for."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(vocabulary_path(name))
        extended = replace(v, spelled=[*v.spelled, "\ufffd".encode()])
        other = len(v.spelled)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                listed = ([i if i is not None and 0 <= i < other else other for i in x] for x in part.column("ids").to_pylist())
                texts = pa.array([extended.decode(x) for x in listed], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], names=["doc_id", "text"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
