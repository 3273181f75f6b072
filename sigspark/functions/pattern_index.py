"""Many patterns over one text: only those run of which a word occurs in it.

An inverted index leads from words to patterns. The text is cut into tokens once, and a pattern is tried only where one of
the words that each of its matches must hold is among them. What a text costs then depends on its length and on the words
it shares with the patterns, not on how many patterns there are; and a query plan holds one call, however long the table of
patterns is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa

from sigspark.functions.text import FOLDED, FOLDED_TO

#: Texts and results that a worker holds as Python objects at a time.
ROWS = 200
TOKEN = re.compile("[a-z0-9]+")
FOLDING = str.maketrans(FOLDED, FOLDED_TO)
TO_FOLD = re.compile(f"[{FOLDED}]")


def by_parts(each: Callable[..., object], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``each`` of the values of a row, for every row of a batch; few rows are Python objects at once."""
    parts = [
        pa.array([each(*row) for row in zip(*(c.slice(at, ROWS).to_pylist() for c in columns), strict=True)], kind)
        for at in range(0, len(columns[0]), ROWS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def folded(text: str) -> str:
    """Lower case, such that any case-insensitive ASCII match is a literal match here."""
    return (text.translate(FOLDING) if not text.isascii() and TO_FOLD.search(text) else text).lower()


@dataclass(frozen=True)
class Pattern:
    """``words``: one of them is a token of every match; None: tried on every text that holds ``piece`` (folded)."""

    body: str
    words: tuple[str, ...] | None = None
    ignore_case: bool = True
    piece: str = ""

    def search(self, text: str) -> re.Match | None:
        return re.compile(self.body, re.IGNORECASE if self.ignore_case else 0).search(text)  # kept by the re module


class PatternIndex:
    def __init__(self, patterns: list[Pattern]):
        self.patterns = patterns
        self.always = [n for n, p in enumerate(patterns) if p.words is None]
        by_word: dict[str, list[int]] = {}
        for n, p in enumerate(patterns):
            for word in p.words or ():
                by_word.setdefault(word, []).append(n)
        self.by_word = by_word
        self.vocabulary = frozenset(by_word)

    def candidates(self, text: str) -> list[int]:
        """Numbers of the patterns that may match, ascending."""
        plain = folded(text)
        words = self.vocabulary.intersection(TOKEN.findall(plain))
        unguarded = (n for n in self.always if self.patterns[n].piece in plain)
        return sorted({*unguarded, *(n for word in words for n in self.by_word[word])})

    def matches(self, text: str) -> Iterator[tuple[int, re.Match]]:
        """Number and leftmost match of each pattern that has one."""
        for n in self.candidates(text):
            found = self.patterns[n].search(text)
            if found:
                yield n, found
