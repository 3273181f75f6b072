"""A corpus pipeline: each stage calls one operator, works on all that the stage before kept, and is written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigspark.llm import decontam, near_copies, pieces, suffixes, toxicity
from sigspark.llm.common import persist_table, table
from sigspark.session import bound_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = "piece_bpe_32k.model"
PASSAGE_WORDS = 51


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the toxicity machine, fitted on the labels' learnable rows, scores at its threshold or above."""
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, table(spark, folder, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints that meet at anchors, each link held to a similarity of 0.8
    or more of five-word shingles, and an exact search for links of that similarity that fingerprints are too far apart for."""
    return near_copies.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the runs of over 50 words and the 400-byte strings that also occur elsewhere; a document stays, even if nothing is left of it."""
    return suffixes.without_repeats(docs, n_chars="n_chars", words=PASSAGE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, folder, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids of what is left."""
    return pieces.encode(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The stages fit a machine, link near copies, sort suffixes and search pieces; the tests hold each to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(bound_batches(spark), folder, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if at < len(STAGES) - 1:
            docs = persist_table(docs, f"stage-{name}")
    return docs
