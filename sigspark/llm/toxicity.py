"""Toxicity by a support vector machine with a string subsequence kernel and Nystroem landmarks.

The kernel of two words (with a mark at either end) sums over all character subsequences of length three, each occurrence weighted by DECAY to the
power of the span it covers, and is normalised and cubed; so ``idiot``, ``idi0t``, ``id-iot`` and ``i d i o t`` are alike
(three or more single characters in a row are read as one word; a long word is read in overlapping pieces). The kernel
of two sentences is the sum over their pairs of words. Nystroem: words are represented by their kernel with a few
landmark words, multiplied by the inverse root of the landmarks' own kernel matrix.

Fitting uses a bounded sample (``SAMPLE`` documents at most, half of each label as far as there are as many, chosen by a
hash of the id) of the labelled rows that may be learned from. Sentences take their document's label; from a toxic
document only the sentences that the last round found most toxic count in the next round. A logistic function then turns a
document's sentence margins into its score; it is fitted on documents of the sample that the machine has not seen.

Scoring maps over whole texts without any shuffle. A worker keeps the values of at most ``SLOTS`` words between tasks
(16 bytes each, by a 64-bit hash); others are worked out each time. Scores do not depend on it.

Defined results: a null or empty text has no sentences and gets the score of margin "none"; repeated rows get equal
scores; rows without a label or with a null label are not learned from; without labels of both kinds every score is the
share of toxic labels among those that may be learned from (0 without any); an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from itertools import chain, combinations
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents, row_key, worker_memory

SAMPLE, LANDMARKS = 4000, 32
#: From this many words of one length on, the dynamic programme is quicker than sorting triples; both are exact.
MANY = 128
#: Code points under this are looked up in a table, others searched for.
LOW = 1024
LENGTH, DECAY, WIDEST, POWER = 3, 0.6, 16, 3
SLOTS = 1 << 20
#: Texts that are scored at once.
AT_ONCE = 500
THRESHOLD = 0.7
SENTENCE = re.compile(r"[.!?\n]+")
SINGLES = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")
BEGIN, FINISH = "\u0002", "\u0003"
#: What of ASCII can be at the edge of a token; stripping it first spares most tokens the pattern.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
EDGES = re.compile(r"^\W+|\W+$")


def sentences(text: str) -> list[list[str]]:
    joined = SINGLES.sub(lambda m: "".join(m.group().split()), text.lower())
    return [words for part in SENTENCE.split(joined) if (words := part.split())]


def pieces(token: str) -> list[str]:
    """A token without outer punctuation, between marks for its ends; one longer than WIDEST in pieces that overlap by half."""
    word = token.strip(MARKS)
    if not word.isalnum():
        word = EDGES.sub("", word)
    if len(word) < LENGTH:
        return []
    word = f"{BEGIN}{word}{FINISH}"
    if len(word) <= WIDEST:
        return [word]
    return [word[i : i + WIDEST] for i in range(0, len(word) - WIDEST // 2, WIDEST // 2)]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row a word, padded, and the lengths."""
    lengths = np.array([len(w) for w in words])
    out = np.zeros((len(words), max(1, lengths.max(initial=1))), np.uint32)
    for i, word in enumerate(words):
        out[i, : len(word)] = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def same_length(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def self_kernel(words: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of each word of one length with itself: equal triples add up before they are squared."""
    places, weight = spans(words.shape[1])
    if not len(places):
        return np.zeros(len(words))
    ordered = np.sort(words, 1)
    again = (ordered[:, 1:] == ordered[:, :-1]).any(1)
    if not again.all():  # no character twice: no triple twice
        out = np.full(len(words), np.sum(weight.astype(np.float64) ** 2))
        if again.any():
            out[again] = self_kernel(words[again])
        return out
    if len(words) >= MANY:
        return raw_kernel(words[:, :, None], words[:, :, None], paired=True)[:, 0].astype(np.float64)
    wide = words.astype(np.int64)
    code = (wide[:, places[:, 0]] << 42) | (wide[:, places[:, 1]] << 21) | wide[:, places[:, 2]]
    order = np.argsort(code, 1)
    code, mass = np.take_along_axis(code, order, 1), weight[order]
    new = np.ones(code.shape, bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    sums = np.add.reduceat(mass.ravel().astype(np.float64), np.flatnonzero(new)) ** 2
    return np.bincount(np.nonzero(new)[0], sums, len(words))


def raw_kernel(left: np.ndarray, right: np.ndarray, paired: bool = False) -> np.ndarray:
    """Subsequence kernel of words (rows, place, 1) with words (1 or rows, place, columns): rows x columns.

    The usual dynamic programme, one place of either word at a time, over all pairs at once. Padding (0) matches nothing.
    """
    rows, columns = left.shape[0], 1 if paired else right.shape[2]
    m, n = left.shape[1], right.shape[1]
    square = np.float32(DECAY * DECAY)
    decay = np.float32(DECAY)
    equal = [[(left[:, i] == right[:, j]) & (left[:, i] != 0) for j in range(n)] for i in range(m)]
    prefix = None  # weights of subsequences of the length before, for each pair of prefixes
    total = np.zeros((rows, columns), np.float32)
    for level in range(1, LENGTH + 1):
        grown = [[None] * (n + 1) for _ in range(m + 1)]
        zero = np.zeros((rows, columns), np.float32)
        for i in range(m + 1):
            grown[i][0] = zero
        for j in range(n + 1):
            grown[0][j] = zero
        for i in range(1, m + 1):
            run = zero
            for j in range(1, n + 1):
                before = np.float32(1) if prefix is None else prefix[i - 1][j - 1]
                gain = np.where(equal[i - 1][j - 1], square * before, np.float32(0))
                if level == LENGTH:
                    total += gain
                else:
                    run = run * decay + gain
                    grown[i][j] = grown[i - 1][j] * decay + run
        prefix = grown
    return total


def spans(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All ascending triples of places in a word, and the weight of each."""
    places = np.array(list(combinations(range(length), LENGTH)), int).reshape(-1, LENGTH)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)


@dataclass
class Kernel:
    """Landmark words and what turns kernels with them into features.

    The kernel is a product of explicit vectors: the weights of a word's triples of characters. Only triples that some
    landmark has can add to it, so those are numbered in a table over the landmarks' own alphabet.
    """

    landmarks: list[str]
    alphabet: np.ndarray = field(init=False)
    number: np.ndarray = field(init=False)
    triples: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)
    letters: np.ndarray = field(init=False)
    root: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.alphabet = np.unique(np.array([ord(c) for w in self.landmarks for c in w], np.uint32))
        low = self.alphabet < LOW
        self.letters = np.full(LOW, len(self.alphabet), np.int32)
        self.letters[self.alphabet[low]] = np.flatnonzero(low)
        found: dict[int, np.ndarray] = {}
        for column, word in enumerate(self.landmarks):
            places, weight = spans(len(word))
            for code, w in zip(self.codes_of(codes([word])[0], places)[0].tolist(), weight, strict=True):
                found.setdefault(code, np.zeros(len(self.landmarks), np.float32))[column] += w
        self.number = np.zeros((len(self.alphabet) + 1) ** LENGTH, np.int32)
        self.number[list(found)] = np.arange(1, len(found) + 1)
        self.triples = np.stack([np.zeros(len(self.landmarks), np.float32), *found.values()])
        self.norms = np.array([self_kernel(codes([w])[0])[0] for w in self.landmarks])
        values, vectors = np.linalg.eigh(self.against(self.landmarks).astype(np.float64))
        kept = values > 1e-6
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def codes_of(self, table: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Number of each triple over the alphabet (a character outside it counts as the extra last one)."""
        letter = np.take(self.letters, table, mode="clip")
        high = np.flatnonzero(table.ravel() >= LOW)
        if len(high):
            odd = table.ravel()[high]
            at = np.searchsorted(self.alphabet, odd)
            known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == odd
            letter.ravel()[high] = np.where(known, at, len(self.alphabet))
        code = np.zeros((len(table), len(places)), np.int32)
        for k in range(LENGTH):
            code *= np.int32(len(self.alphabet) + 1)
            code += np.take(letter, places[:, k], axis=1)
        return code

    def against(self, words: list[str], block: int = 1024) -> np.ndarray:
        """Normalised, cubed kernel of each word with each landmark; words of one length go together."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, members in by_length.items():
            places, weight = spans(length)
            for at in range(0, len(members), block):
                some = np.array(members[at : at + block])
                table = same_length([words[i] for i in members[at : at + block]])
                rows = self.number[self.codes_of(table, places)]
                known = rows != 0
                with_any = known.any(1)
                hit = np.flatnonzero(with_any)
                if not len(hit):
                    continue
                n = len(self.triples)
                flat = np.flatnonzero(known)
                word, place = np.divmod(flat, len(places))
                nth = np.cumsum(with_any) - 1
                at_triple = np.bincount(nth[word] * n + rows.ravel()[flat], weight[place], len(hit) * n)
                raw = at_triple.reshape(-1, n).astype(np.float32) @ self.triples
                norm = self_kernel(table[hit])
                out[some[hit]] = (raw / np.sqrt(np.maximum(norm, 1e-12)[:, None] * self.norms)) ** POWER
        return out


def choose_landmarks(texts: list[str], labels: np.ndarray, count: int) -> list[str]:
    """Words that tell the labels apart, without near repetitions, and frequent words as the rest."""
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        (toxic if label else clean).update({p for s in sentences(text) for w in s for p in pieces(w)})
    n_toxic, n_clean = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = lambda w: (toxic[w] + 0.5) / (n_toxic + 1) / ((clean[w] + 0.5) / (n_clean + 1))
    telling = sorted((w for w in toxic if toxic[w] >= 3 and odds(w) > 2), key=lambda w: (-toxic[w] * np.log(odds(w)), w))[: 20 * count]
    chosen: list[str] = []
    if telling:
        table, _ = codes(telling)
        norm = np.array([self_kernel(codes([w])[0])[0] for w in telling])
        free = np.ones(len(telling), bool)
        for i, word in enumerate(telling):
            if free[i] and len(chosen) < count * 3 // 4:
                chosen.append(word)
                near = raw_kernel(table[:, :, None], table[i : i + 1].T[None])[:, 0] / np.sqrt(norm * norm[i])
                free &= near < 0.5
    total = toxic + clean
    frequent = sorted((w for w in total if w not in set(chosen)), key=lambda w: (-total[w], w))
    return chosen + frequent[: count - len(chosen)]


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, hinge: bool, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared hinge (a support vector machine) or logistic loss; gradient steps with momentum on scaled features."""
    scale = x.std(0) + np.float32(1e-9)
    z = np.ones((len(x), x.shape[1] + 1), x.dtype)
    np.divide(x, scale, out=z[:, :-1])
    sign = np.where(y > 0, 1.0, -1.0).astype(x.dtype)
    weight = (weight / weight.sum()).astype(x.dtype)
    top = np.linalg.eigvalsh(((z * weight[:, None]).T @ z).astype(np.float64))[-1]
    step = 1 / ((2.0 if hinge else 0.25) * top + l2)
    w = np.zeros(z.shape[1])
    look, t = w.copy(), 1.0
    for _ in range(rounds):
        margin = sign * (z @ look.astype(x.dtype))
        slope = -2 * np.maximum(0, 1 - margin) if hinge else -1 / (1 + np.exp(np.minimum(margin, 50)))
        gradient = z.T @ (weight * sign * slope) + l2 * np.r_[look[:-1], 0]
        new, t_new = look - step * gradient, (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1] / scale, float(w[-1])


def summary(document: list[tuple[float, list[float]]]) -> list[float]:
    """What of a document's sentences (margin, values of the words) the score looks at."""
    margins = sorted((m for m, _ in document), reverse=True)[:5] or [-2.0]
    values = sorted([v for _, vs in document for v in vs if v > 0], reverse=True)
    top = (values + [0.0] * 5)[:5]
    high, higher = (bisect_left(values, -least, key=neg) for least in (0.5, 1))
    n_words = sum(len(vs) for _, vs in document)
    return [margins[0], sum(margins) / len(margins), top[0], sum(top[:3]), sum(top), float(np.log1p(high)), float(np.log1p(higher)), higher / (n_words + 20), float(np.log1p(n_words))]


class KnownWords:
    """Values of words met before, in SLOTS places of 16 bytes; a word's 64-bit hash stands for it and tells its place, which the first to come keeps."""

    def __init__(self, slots: int = SLOTS) -> None:
        self.hashes, self.values = np.zeros(slots, np.int64), np.zeros(slots)

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        return hashes, hashes & (len(self.hashes) - 1)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each is known."""
        hashes, place = self.places(words)
        return self.values[place], self.hashes[place] == hashes

    def keep(self, words: list[str], values: np.ndarray) -> None:
        hashes, place = self.places(words)
        place, first = np.unique(place, return_index=True)
        free = self.hashes[place] == 0
        self.hashes[place[free]], self.values[place[free]] = hashes[first[free]], values[first[free]]


@dataclass
class Model:
    """Everything that scoring needs; small, sent to the workers with the function."""

    prior: float
    kernel: Kernel | None = None
    word_weights: np.ndarray | None = None
    bias: float = 0.0
    weights: np.ndarray | None = None
    offset: float = 0.0

    @property
    def identity(self) -> tuple:
        return self.prior, self.bias, self.offset, *(self.kernel.landmarks if self.kernel else ()), *(self.word_weights if self.kernel else ())

    def word_values(self, tokens: list[str]) -> list[float]:
        """The part of a sentence's margin that each token adds: the largest among its pieces."""
        parts = [pieces(t) for t in tokens]
        flat = list({p for ps in parts for p in ps})
        values = dict(zip(flat, (self.kernel.against(flat) @ self.word_weights).tolist(), strict=True)) if flat else {}
        return [max((values[p] for p in ps), default=0.0) for ps in parts]

    def sentence_values(self, texts: list[str], cache: dict[str, KnownWords]) -> list[list[tuple[float, list[float]]]]:
        """Of each text's sentences the margin and the words' values; ``cache`` keeps what is known of words."""
        if "words" not in cache:
            cache["words"] = KnownWords()
        known = cache["words"]
        cut = [sentences(t) for t in texts]
        words = list(set().union(*chain.from_iterable(cut)))
        at_hand, found = known.look_up(words)
        new = np.flatnonzero(~found)
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            at_hand[some] = self.word_values([words[i] for i in some])
        known.keep([words[i] for i in new], at_hand[new])
        values = dict(zip(words, at_hand.tolist(), strict=True))
        return [[(self.bias + sum(v := list(map(values.__getitem__, s))), v) for s in doc] for doc in cut]

    def scores(self, texts: list[str], cache: dict[str, KnownWords]) -> np.ndarray:
        if self.kernel is None or not texts:
            return np.full(len(texts), self.prior)
        x = np.array([summary(m) for m in self.sentence_values(texts, cache)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset, -50, 50)))


def batched(values: list, size: int) -> Iterator[list]:
    return (values[i : i + size] for i in range(0, len(values), size))


def fit(texts: list[str], labels: np.ndarray, prior: float, landmarks: int = LANDMARKS) -> Model:
    """A model from labelled texts; ``prior`` is the share of toxic rows among all that may be learned from."""
    labels = np.asarray(labels, int)
    if labels.min(initial=1) == labels.max(initial=0) or not len(labels):
        return Model(prior)
    kernel = Kernel(choose_landmarks(texts, labels, landmarks))
    parts = np.arange(len(texts)) % 3  # two thirds for the machine, one third for the logistic function
    owners, starts, places = array("q"), array("q"), array("q")
    words: dict[str, int] = {}  # a sentence is numbers of words: as strings, each occurrence would be an object of its own
    for i in np.flatnonzero(parts > 0):
        for s in sentences(texts[i]):
            begin = len(places)
            places.extend(words.setdefault(p, len(words)) for w in s for p in pieces(w))
            if len(places) > begin:
                owners.append(i)
                starts.append(begin)
    features = np.concatenate([kernel.against(part) for part in batched(list(words), 20_000)]) @ kernel.root.astype(np.float32)
    del words
    starts.append(len(places))
    rows = []
    for at in range(0, len(owners), 2000):
        some = np.array(starts[at : at + 2001])
        rows.append(np.add.reduceat(features[places[some[0] : some[-1]]], some[:-1] - some[0]))
    del features, places
    x, owner = np.concatenate(rows), np.array(owners)
    del rows
    doc_label = labels[owner]
    use = np.ones(len(x), bool)
    for _ in range(3):
        y = doc_label[use]
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        w, b = fit_linear(x[use], y, weight, 1e-4, hinge=True)
        margin = x @ w + b
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, margin)
        use = (doc_label == 0) | (margin >= np.minimum(0.5, best[owner] - 1e-9))
    model = Model(prior, kernel, kernel.root @ w, b)
    held = [i for i in range(len(texts)) if parts[i] == 0]
    cache: dict[str, KnownWords] = {}
    seen = np.array([summary(m) for part in batched(held, AT_ONCE) for m in model.sentence_values([texts[i] for i in part], cache)])
    y = labels[held]
    share = max(1e-6, min(1 - 1e-6, prior))
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))  # as frequent as among all rows
    model.weights, model.offset = fit_linear(seen, y, weight, 1e-4, hinge=False, rounds=2000)
    return model


def learnable(doc_id: Column) -> Column:
    """False for the rows held out: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1, F.lit(False))


def fit_on(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label"))
    known = known.where(F.col("label").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Model(0.0)
    picked = None
    for value in counts:
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        picked = some if picked is None else picked.unionByName(some)
    # at most SAMPLE ids and labels
    rows = documents(df, doc_id, text).join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"]).limit(sample).collect()
    rows.sort(key=lambda r: (hash_order(r["doc_id"]), str(r["doc_id"])))
    model = fit([r["text"] for r in rows], np.array([r["label"] for r in rows]), counts.get(1, 0) / total)
    del rows
    give_back_memory()
    return model


def give_back_memory() -> None:
    """What the fit has freed goes back to the system, for the driver lives on: glibc keeps holes in its heap. Elsewhere nothing happens."""
    with suppress(OSError, TypeError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hash_order(value: object) -> int:
    from zlib import crc32

    return crc32(f"order {value}".encode())


def value_cache(model: Model) -> dict[str, KnownWords]:
    """What this worker keeps of the model's word values; another model starts anew."""
    kept = worker_memory("word values")
    if kept.get("model") != model.identity:
        kept.clear()
        kept.update(model=model.identity, values={})
    return kept["values"]


def toxicity_scores(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, score per row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = value_cache(model)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                scores = model.scores(part.column("text").to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(scores, pa.float64())], names=["doc_id", "key", "score"])

    docs = documents(df, doc_id, text).withColumn("key", row_key())
    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, score double")


def drop_toxic(df: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose score is below the threshold; only their texts go to a worker, and only scores come back."""

    def score(texts: pa.Array) -> pa.Array:
        cache = value_cache(model)
        parts = [model.scores(texts.slice(at, AT_ONCE).to_pylist(), cache) for at in range(0, len(texts), AT_ONCE)]
        return pa.array(np.concatenate([np.empty(0), *parts]), pa.float64())

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.where(F.arrow_udf(score, "double")(F.coalesce(F.col(f"`{text}`"), F.lit(""))) < threshold)
