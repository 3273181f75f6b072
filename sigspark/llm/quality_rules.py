"""Quality rules: a decision list learned from labelled statistics.

Each text gives a few counts (words, their code points, symbols, repeated lines, words in repeated windows and so on). What
the rules look at are ratios of these counts, so that a threshold means the same for a short and a long text. Rules are
learned by sequential covering: of the labelled rows two thirds grow a rule, one threshold at a time, by the gain of
information per rejected row; the other third prunes its last thresholds as long as that raises precision less error. A rule
that is not precise enough there ends the search. Rows that a rule covers are taken out before the next one is grown, so the
list is ordered. It is emitted as one Spark conditional expression, ``CASE WHEN ... THEN 1 WHEN ... THEN 2 ... END``: the
number of the rule that rejects a row, null for a row that is kept.

The list is learned from a bounded sample of labelled rows (``SAMPLE``, half of each label as far as there are as many,
taken by the order of a hash of their ids); rows whose id's CRC-32 leaves 1 when divided by 3 are held out. Statistics are
those of whole texts, for all rows.

Defined results: a null text has no words and all its counts are zero; ratios over nothing are zero; rows repeated with
equal id and text get equal results; a label that is null is no label, and a row with several labels counts as of bad
quality if one of them says so; ids may be null (such rows are judged, not learned from); without labels of both kinds there
are no rules; an empty table gives no rows; further columns are ignored, whatever they are called. Very long texts take
memory for one integer a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents
from sigspark.llm.toxicity import learnable

SAMPLE = 8_000
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
CAPITALS, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b"!?"
WINDOW = 3
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_digits", "n_marks"]
#: What rules look at, as SQL over the counts.
RATIOS = {
    "words": "n_words",
    "chars_a_word": "word_chars / n_words",
    "symbols_a_word": "n_symbols / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
    "capitals_a_char": "n_capitals / word_chars",
    "digits_a_char": "n_digits / word_chars",
    "marks_a_word": "n_marks / n_words",
}
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
MOST_CONDITIONS, MOST_RULES = 4, 24
#: A rule must be this precise on the pruning rows, and cover so many of them.
PRECISION, LEAST_COVER = 0.9, 3
THRESHOLDS = 128


def repeated_window_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, overlaps counted once."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
    _, window, times = np.unique(pairs[:n] * base + ids[2:], return_inverse=True, return_counts=True)
    often = times[window] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(WINDOW):
        covered[shift : shift + n] |= often
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    raw = text.encode("utf-8")
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    words = raw.split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    return (
        len(words), len(text) - less(BLANKS), less(SYMBOLS), len(lines) - len(set(lines)), repeated_window_words(ids), len(lines),
        len(index), less(CAPITALS), less(DIGITS), less(MARKS),
    )


def text_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = zip(*map(text_counts, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])

    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratio_sql(name: str) -> str:
    """A ratio as SQL; zero over nothing."""
    over = RATIOS[name].split(" / ")
    return f"CAST({over[0]} AS DOUBLE)" if len(over) == 1 else f"CASE WHEN {over[1]} > 0 THEN CAST({over[0]} AS DOUBLE) / {over[1]} ELSE 0D END"


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.ratio]
        return x > self.threshold if self.above else x <= self.threshold

    @property
    def sql(self) -> str:
        return f"{ratio_sql(self.ratio)} {'>' if self.above else '<='} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        held = np.ones(len(next(iter(values.values()))), dtype=bool)
        for condition in self.conditions:
            held &= condition.holds(values)
        return held

    @property
    def sql(self) -> str:
        return " AND ".join(c.sql for c in self.conditions)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def thresholds(x: np.ndarray) -> np.ndarray:
    """Middles between neighbouring values, at most ``THRESHOLDS`` of them, evenly spread over the rows."""
    values = np.unique(x)
    if len(values) > THRESHOLDS:
        values = np.unique(np.quantile(x, np.linspace(0, 1, THRESHOLDS), method="nearest"))
    return (values[:-1] + values[1:]) / 2


def grown(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Threshold after threshold, each the one that tells most about the rows still covered."""
    covered, conditions = np.ones(len(bad), dtype=bool), []
    while len(conditions) < MOST_CONDITIONS and not bad[covered].all():
        p0, n0 = int(bad[covered].sum()), int((~bad[covered]).sum())
        best, chosen = 0.0, None
        for name, x in values.items():
            cuts = thresholds(x[covered])
            order = np.sort(x[covered & bad]), np.sort(x[covered & ~bad])
            low_p, low_n = (np.searchsorted(o, cuts, side="right") for o in order)
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - log2(p0 / (p0 + n0))), 0.0)
                if len(gain) and gain.max() > best + 1e-9:
                    best, chosen = float(gain.max()), Condition(name, above, float(cuts[int(gain.argmax())]))
        if chosen is None:
            break
        conditions.append(chosen)
        covered &= chosen.holds(values)
    return Rule(tuple(conditions))


def pruned(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Without the last conditions that the pruning rows do not bear out."""

    def worth(short: Rule) -> float:
        held = short.holds(values)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)), key=worth)


def learned(values: dict[str, np.ndarray], bad: np.ndarray, prunes: np.ndarray) -> list[Rule]:
    """The ordered rules that reject. ``prunes``: the rows kept apart for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MOST_RULES:
        grow, prune = left & ~prunes, left & prunes
        if not bad[grow].any() or bad[grow].all():
            break
        rule = grown({k: v[grow] for k, v in values.items()}, bad[grow])
        if not rule.conditions:
            break
        rule = pruned(rule, {k: v[prune] for k, v in values.items()}, bad[prune])
        held = rule.holds(values)
        p, n = int((held & prune & bad).sum()), int((held & prune & ~bad).sum())
        if p + n < LEAST_COVER or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit_rules(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learn from a bounded sample of the labelled rows that are not held out and pass the base rule."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label"))
    known = known.where(F.col("label").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    picked = [known.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for kind in (F.col("label") == 0, F.col("label") != 0)]
    some = picked[0].unionByName(picked[1])  # at most SAMPLE ids and labels
    texts = documents(df, doc_id, text).join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    counts = text_statistics(texts).join(F.broadcast(some), "doc_id").where(~base_failed())
    rows = counts.select("doc_id", "label", F.xxhash64("doc_id").alias("at"), *(F.expr(ratio_sql(r)).alias(r) for r in RATIOS)).collect()
    rows.sort(key=lambda r: (r["at"], r["doc_id"]))
    if not rows:
        return []
    values = {r: np.array([row[r] for row in rows], dtype=float) for r in RATIOS}
    return learned(values, np.array([row["label"] == 0 for row in rows]), np.arange(len(rows)) % 3 == 2)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row of counts, from 1; null for none."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {rule.sql} THEN {at}" for at, rule in enumerate(rules, 1)) + " END")


def judged(df: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, all counts, base_failed, rule (the first that rejects the row), kept."""
    counts = text_statistics(df, doc_id, text)
    return counts.withColumns({"base_failed": base_failed(), "rule": first_rule(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
