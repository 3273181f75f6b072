"""Sentiment scoring: pluggable batch scorer, content-hash cache, lexicon scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions import text as tx
from sigspark.functions.barrier import attach
from sigspark.session import fits, local_table

LABELS = ["negative", "neutral", "positive"]
PROBABILITY_SCHEMA = "cache_key string, p_pos double, p_neg double, p_neu double"
SCORE_COLUMNS = ["sentiment_score", "sentiment_label", "sentiment_confidence", "p_pos", "p_neg", "p_neu"]


class Scorer(Protocol):
    """A model: label names in output order, and logits for a batch of cleaned texts."""

    labels: list[str]

    def logits(self, texts: list[str]) -> np.ndarray: ...


def score_batches(texts: DataFrame, make_scorer: Callable[[], Scorer], batch_size: int = 32) -> DataFrame:
    """(cache_key, clean_text) -> class probabilities; the model is made once per Python worker task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        names = [label.lower() for label in scorer.labels]
        missing = {"positive", "negative", "neutral"} - set(names)
        if missing:
            raise ValueError(f"the model lacks labels: {sorted(missing)}")
        order = [names.index(name) for name in ("positive", "negative", "neutral")]
        for frame in frames:
            parts = []
            for start in range(0, len(frame), batch_size):
                batch = frame["clean_text"].iloc[start : start + batch_size].tolist()
                logits = np.asarray(scorer.logits(batch), dtype=float)
                exponent = np.exp(logits - logits.max(axis=1, keepdims=True))
                parts.append((exponent / exponent.sum(axis=1, keepdims=True))[:, order])
            values = np.vstack(parts) if parts else np.empty((0, 3))
            yield pd.DataFrame(
                {"cache_key": frame["cache_key"], "p_pos": values[:, 0], "p_neg": values[:, 1], "p_neu": values[:, 2]}
            )

    return texts.select("cache_key", "clean_text").mapInPandas(run, PROBABILITY_SCHEMA)


def label_columns() -> dict[str, Column]:
    """Probabilities -> score, label (argmax, first label wins ties) and confidence."""
    pos, neg, neu = F.col("p_pos"), F.col("p_neg"), F.col("p_neu")
    best = F.greatest(pos, neg, neu)
    return {
        "sentiment_score": pos - neg,
        "sentiment_label": F.when(pos == best, "positive").when(neg == best, "negative").when(neu == best, "neutral"),
        "sentiment_confidence": best,
    }


def cache_key(clean_text: Column) -> Column:
    return F.sha1(clean_text.cast("binary"))


def with_clean_text(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """df and ``clean_text``, the model's input. Cleaning is by far the dearest step of a row and happens once, whatever reads the column."""
    src = F.col(source) if source in df.columns else None
    return attach(df, df.columns, {"clean_text": tx.clean_for_model(F.col(text), src)})


def cleaned(df: DataFrame, text: str, source: str, clean: str | None) -> DataFrame:
    """df and ``_clean``: the given column of texts cleaned before, or the cleaned text."""
    if clean:
        return df.withColumn("_clean", F.coalesce(F.col(clean), F.lit("")))
    src = F.col(source) if source in df.columns else None
    return attach(df, df.columns, {"_clean": tx.clean_for_model(F.col(text), src)})


def cache_misses(df: DataFrame, cache: DataFrame | None, text: str = "text", source: str = "source", clean: str | None = None) -> DataFrame:
    """Distinct cleaned texts that are not cached: the only ones a model has to see. ``clean``: a column of ``with_clean_text``."""
    wanted = (
        cleaned(df, text, source, clean).select(F.col("_clean").alias("clean_text"))
        .filter("clean_text != ''")
        .groupBy(cache_key(F.col("clean_text")).alias("cache_key"))
        .agg(F.first("clean_text").alias("clean_text"))  # equal keys are equal texts
    )
    return wanted if cache is None else wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def attach_scores(df: DataFrame, scored: DataFrame, text: str = "text", source: str = "source", clean: str | None = None) -> DataFrame:
    """Join probabilities by content hash; blank texts are neutral with full confidence."""
    # blank rows look nothing up; their keys match nothing and spread over all partitions
    key = F.when(~F.col("_blank"), cache_key(F.col("_clean"))).otherwise(F.concat(F.lit("blank-"), F.spark_partition_id().cast("string")))
    keyed = cleaned(df, text, source, clean).withColumn("_blank", F.col("_clean") == "").withColumn("cache_key", key).drop("_clean")
    joined = keyed.join(scored.select("cache_key", "p_pos", "p_neg", "p_neu"), "cache_key", "left")
    filled = joined.withColumns(
        {
            name: F.when(F.col("_blank"), F.lit(value)).otherwise(F.col(name))
            for name, value in (("p_pos", 0.0), ("p_neg", 0.0), ("p_neu", 1.0))
        }
    )
    return filled.withColumns(label_columns()).select(*df.columns, *SCORE_COLUMNS)


def score_texts(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    cache: DataFrame | None = None,
    cache_path: str | None = None,
    text: str = "text",
    source: str = "source",
    batch_size: int = 32,
    clean: str | None = None,
) -> DataFrame:
    """Score each distinct text once, append new scores to the cache folder, attach to all rows.

    ``clean`` names a column of ``with_clean_text``, for rows that are scored more than once.
    """
    spark, given = df.sparkSession, cache
    if cache_path:
        stored = read_cache(spark, cache_path)
        cache = stored if given is None else one_per_key(given.select(*stored.columns).unionByName(stored))
    fresh = score_batches(cache_misses(df, cache, text, source, clean), make_scorer, batch_size)
    if cache_path:
        fresh.write.mode("append").parquet(cache_path)
        # the folder is read anew, and its earlier listing must not be in one plan with it: Spark would take both for the same scan
        stored = read_cache(spark, cache_path)
        return attach_scores(df, stored if given is None else one_per_key(given.select(*stored.columns).unionByName(stored)), text, source, clean)
    scored = fresh if cache is None else one_per_key(fresh.unionByName(cache.select(*fresh.columns)))
    return attach_scores(df, scored, text, source, clean)


def one_per_key(scores: DataFrame) -> DataFrame:
    """One row per cache key, whatever number of runs wrote it; a fixed choice among differing scores."""
    values = F.min(F.struct("p_pos", "p_neg", "p_neu")).alias("p")
    return scores.groupBy("cache_key").agg(values).select("cache_key", "p.*")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored scores; none where the folder does not exist yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return one_per_key(spark.read.schema(PROBABILITY_SCHEMA).parquet(path))
    return spark.range(0).selectExpr(*(f"cast(null as {kind}) as {name}" for name, kind in map(str.split, PROBABILITY_SCHEMA.split(", "))))


def lexicon_table(spark: SparkSession, lexicon: dict[str, float]) -> DataFrame:
    """(word, valence) with exact decimals."""
    return local_table(spark, [(word, str(valence)) for word, valence in lexicon.items()], [("word", "string"), ("valence", "decimal(18,9)")])


def lexicon_scores(
    df: DataFrame, lexicon: dict[str, float] | DataFrame, key: str, text: str = "text", alpha: float = 15.0, cutoff: float = 0.05, most_sent: int = 1_000_000
) -> DataFrame:
    """Lexicon baseline: sum of word valences, ``x / sqrt(x^2 + 15)``, cut-offs at +-0.05. One row per row of df with a key of its own.

    The tokens of a row are counted first, then joined to the lexicon by hash: the cost of a token does not grow with the
    lexicon. A lexicon of at most ``most_sent`` words goes to all executors. Valences are decimals, so their sum is exact
    and no order of words can change it.
    """
    spark = df.sparkSession
    words = lexicon_table(spark, lexicon) if isinstance(lexicon, dict) else lexicon.select("word", F.col("valence").cast("decimal(18,9)").alias("valence"))
    small = len(lexicon) <= most_sent if isinstance(lexicon, dict) else fits(words, most_sent)
    tokens = df.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z']+")).alias("word"))
    found = tokens.join(F.broadcast(words) if small else words, "word", "left")
    total = F.coalesce(F.sum("valence"), F.lit(0)).cast("double")
    summed = found.groupBy(key).agg(total.alias("_total"))
    compound = F.col("_total") / F.sqrt(F.col("_total") * F.col("_total") + alpha)
    scored = summed.select(key, compound.alias("compound"))
    return scored.withColumn(
        "lexicon_label",
        F.when(F.col("compound") >= cutoff, "positive").when(F.col("compound") <= -cutoff, "negative").otherwise("neutral"),
    )


def majority_baseline(df: DataFrame, label: str = "neutral") -> DataFrame:
    return df.withColumns({"predicted": F.lit(label), "predicted_score": F.lit(0.0)})


def sanity_report(scored: DataFrame, group: str = "source", text: str = "text", max_words: int = 128) -> DataFrame:
    """Per group: rows, texts over the word cap, score mean/std and label counts."""
    return scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(tx.word_count(F.col(text)) > max_words).alias("n_truncated"),
        F.avg("sentiment_score").alias("mean_score"),
        F.stddev_samp("sentiment_score").alias("std_score"),
        *[F.count_if(F.col("sentiment_label") == label).alias(f"n_{label}") for label in LABELS],
    )


def extremes(scored: DataFrame, n: int = 4, score: str = "sentiment_score", key: str = "text_id") -> DataFrame:
    """The n most positive and n most negative rows (two top-k selections, no full sort)."""
    top = scored.orderBy(F.desc(score), key).limit(n).withColumn("side", F.lit("positive"))
    bottom = scored.orderBy(F.asc(score), key).limit(n).withColumn("side", F.lit("negative"))
    return top.unionByName(bottom)
