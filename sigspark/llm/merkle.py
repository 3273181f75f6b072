"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

A paragraph is a line; its leaves are its sentences (a sentence ends at ``.``, ``!`` or ``?`` before a blank, and one of
over 100 code points is cut after each 100). A section
ends after a paragraph whose digest begins with 0, 1, 2 or 3, a rule of the content alone, so an edit does not move the
sections behind it. Digests are MD5: a paragraph's over its leaves' and its own text's, a section's over its paragraphs',
the root over the sections' and the number of code points. The paragraph's own text is in its digest since leaves alone do
not tell where it was cut (U+0001, the mark of a cut, may also stand in a text). Equal texts have equal roots, and where roots differ the branches that differ
lead to the edit (``changed_paragraphs``).

A fingerprint is a string: the root, then for each paragraph the first eight digits of its digest and of its leaves',
``root paragraph:leaf,leaf;paragraph:leaf|...``, with ``|`` at the end of a section. The likeness of two fingerprints is
the Dice coefficient of their sets of leaves, 1 for equal roots.

Only DataFrame functions run here. ``with_next`` finds each row's successor in the order of ids without sorting the
table in one place: quantiles of the ids cut it into ranges, a range is a window, and the first row of a range is also
sent to the range before it (that of the first range to the last).

Defined results: a null text is an empty one (one paragraph, one empty leaf); null ids come first; rows with equal ids
go by their texts; a single row is its own successor; an empty table gives no rows; ids are integers.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import documents

CUT = "\u0001"
SHOWN, LEAF_CHARS = 8, 100
ROWS_PER_RANGE, MOST_RANGES = 512, 100_000
LEAST_ID = -(2**63)


def leaves(text: Column) -> Column:
    """Digests of the sentences of each paragraph: array of arrays."""

    def sentences(line: Column) -> Column:
        ended = F.regexp_replace(line, "([.!?]) ", f"$1{CUT} ")
        return F.split(F.regexp_replace(ended, f"([^{CUT}]{{{LEAF_CHARS}}})", f"$1{CUT}"), CUT, -1)

    return F.transform(F.split(text, "\n", -1), lambda line: F.transform(sentences(line), F.md5))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column as ``name``."""
    ends = lambda digest: F.substr(digest, F.lit(1), F.lit(1)) <= "3"
    short = lambda digest: F.substr(digest, F.lit(1), F.lit(SHOWN))
    grown = df.withColumn("_leaves", leaves(F.col(text)))
    whole = lambda line, cut: F.md5(F.concat(F.array_join(cut, ""), F.md5(line)))
    grown = grown.withColumn("_paragraphs", F.zip_with(F.split(F.col(text), "\n", -1), "_leaves", whole))
    marked = F.transform("_paragraphs", lambda p: F.concat(p, F.when(ends(p), "|").otherwise("")))
    sections = F.filter(F.split(F.array_join(marked, ""), r"\|", -1), lambda s: s != "")
    root = F.md5(F.concat(F.array_join(F.transform(sections, F.md5), ""), F.length(text).cast("string")))
    branch = F.transform(
        F.arrays_zip("_paragraphs", "_leaves"),
        lambda x: F.concat(
            short(x["_paragraphs"]), F.lit(":"), F.array_join(F.transform(x["_leaves"], short), ","), F.when(ends(x["_paragraphs"]), "|").otherwise(";")
        ),
    )
    return grown.withColumn(name, F.concat(root, F.lit(" "), F.array_join(branch, ""))).drop("_leaves", "_paragraphs")


def root_of(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, " ", 1)


def leaf_set(fingerprint: Column) -> Column:
    listed = F.regexp_replace(F.substring_index(fingerprint, " ", -1), "[0-9a-f]+:", "")
    return F.array_distinct(F.split(F.rtrim(listed, F.lit("|;")), "[,;|]", -1))


def likeness(left: Column, right: Column) -> Column:
    """0 to 1 from two fingerprints."""
    a, b = leaf_set(left), leaf_set(right)
    return F.when(root_of(left) == root_of(right), 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def changed_paragraphs(old: Column, new: Column) -> Column:
    """Places (from 0) of the paragraphs of ``new`` that ``old`` does not have; empty for equal roots."""
    digests = lambda fp: F.transform(F.split(F.rtrim(F.substring_index(fp, " ", -1), F.lit("|;")), "[;|]", -1), lambda p: F.substring_index(p, ":", 1))
    places = F.transform(digests(new), lambda p, i: F.when(~F.array_contains(digests(old), p), i))
    return F.when(root_of(old) == root_of(new), F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: i.isNotNull()))


def constant(values: list, kind: str) -> Column:
    """Driver values as one literal, however many they are; the optimizer evaluates it once."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value: a search in two steps over constant arrays."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    blocks = constant([bounds[i : i + step] for i in range(0, len(bounds), step)], "array<array<bigint>>")
    below = lambda values: F.size(F.filter(values, lambda b: b <= value))
    block = F.greatest(below(constant(bounds[::step], "array<bigint>")), F.lit(1)) - 1
    return block * step + below(F.element_at(blocks, block + 1))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with ``next_<column>`` of the row that follows in the order of ids."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    n_rows = docs.count()
    ranges = min(MOST_RANGES, n_rows // ROWS_PER_RANGE + 1)
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(order, shares, max(10_000, 10 * ranges))).first()[0] if shares and n_rows else []
    bounds = sorted(set(found))
    placed = docs.withColumn("_order", order).withColumn("_range", range_of(F.col("_order"), bounds))
    # one number for each range, at most MOST_RANGES of them
    firsts = sorted(placed.select("_order", "_range").groupBy("_range").agg(F.min("_order").alias("first")).collect())
    previous = {first: firsts[i - 1]["_range"] for i, (_, first) in enumerate(firsts)}
    starts = [first for _, first in firsts]
    nth = range_of(F.col("_order"), starts)
    if starts:
        arrays = (constant(starts, "array<bigint>"), constant([previous[v] for v in starts], "array<int>"))
        is_first = F.element_at(arrays[0], nth) == F.col("_order")
        before = F.when(is_first, F.element_at(arrays[1], nth))
    else:
        before = F.lit(None).cast("int")
    both = placed.withColumn("_guest", F.array(F.struct(F.lit(False).alias("guest"), F.col("_range").alias("at")), F.struct(F.lit(True).alias("guest"), before.alias("at"))))
    spread = both.select("*", F.explode(F.filter("_guest", lambda g: g["at"].isNotNull())).alias("_g")).drop("_guest")
    window = "over (partition by _g.at order by _g.guest, _order, text)"
    leads = [f"lead({c}) {window} as next_{c}" for c in carried]
    return spread.selectExpr("*", *leads).where("not _g.guest").drop("_g", "_order", "_range")


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint and that of its edited text (the later half taken from the next row), with likenesses."""
    docs = with_tree(documents(df, doc_id, text), "text", "fingerprint")
    paired = with_next(docs, ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    )
    grown = with_tree(edited.drop("text", "next_text"), "edited", "edited_fingerprint")
    return grown.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
