"""Raw source tables -> the unified text table. Each plan returns (texts, audit)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import Dictionary
from sigspark.functions import text as tx
from sigspark.operators.dedupe import keep_first, merge_by_url, merge_labels, step_counts
from sigspark.operators.linking import link_entities
from sigspark.operators.stats import side_by_side
from sigspark.schemas import TEXT_COLUMNS


def _texts(df: DataFrame, **values) -> DataFrame:
    missing = {name: F.lit(None).cast("string") for name in TEXT_COLUMNS if name not in df.columns}
    return df.withColumns({**missing, **values}).select(*TEXT_COLUMNS)


def with_duplicates(audit: DataFrame, kept: DataFrame, labels: str | None = None) -> DataFrame:
    """The audit with the rows that deduplication took out and the final count.

    ``labels``: the column with the labels of a merged row; each stands for one row that was kept under that label, which
    tells duplicates under one label from those under several.
    """
    counts = kept.agg(F.count(F.lit(1)).alias("final_count"), F.sum(F.size(labels) if labels else F.lit(1)).alias("_labelled"))
    both = side_by_side(audit, counts)
    firsts = F.coalesce("_labelled", F.lit(0))
    if labels:
        both = both.withColumns({"dropped_per_hint_dups": F.col("kept_count") - firsts, "dropped_cross_hint_dups": firsts - F.col("final_count")})
    else:
        both = both.withColumn("dropped_dups", F.col("kept_count") - F.col("final_count"))
    return both.drop("_labelled")


def clean_tweets(raw: DataFrame, universe: list[str] | None = None) -> DataFrame:
    """Tweets with hint, cleaned text and first URL; filters are left to the caller."""
    hint = F.upper("`Stock Name`")
    hint = F.when(hint == "GOOG", "GOOGL").otherwise(hint)
    body = tx.strip_retweet(tx.html_unescape(F.coalesce("Tweet", F.lit(""))))
    staged = raw.select(hint.alias("ticker_hint"), body.alias("_body"), "Date")
    return staged.select(
        "ticker_hint", tx.strip_urls(F.col("_body")).alias("text"), tx.first_url(F.col("_body")).alias("url"),
        tx.utc_timestamp(F.col("Date")).alias("ts"),
        F.coalesce(F.col("ticker_hint").isin(*(universe or fv.INDEX_UNIVERSE)), F.lit(False)).alias("in_universe"),
    )


def normalize_tweets(raw: DataFrame, universe: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    cleaned = clean_tweets(raw, universe)
    short = tx.word_count(F.col("text")) < 3
    # a date that cannot be read is counted, and such a copy never beats a dated one
    audit = step_counts(cleaned, {"non_universe": ~F.col("in_universe"), "short": short}, {"undated": F.col("ts").isNull()})
    valid = cleaned.filter(F.col("in_universe") & ~short).drop("in_universe").withColumn("undated", F.col("ts").isNull())
    first = keep_first(valid, ["text", "ticker_hint"], ["undated", "ts", "url"], "dup_count", null_keys_pass=False).drop("undated")
    merged = merge_labels(first, ["text", "ts"], "ticker_hint", ["ticker_hint", "url"])
    audit = with_duplicates(audit, merged, "ticker_hints")
    source = F.lit("twitter_kaggle")
    texts = _texts(
        merged, source=source, author_or_domain=F.lit("twitter.com"),
        text_id=tx.text_id(source, F.col("ts"), F.col("ticker_hint"), F.col("text")),
    )
    return texts, audit


def normalize_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``read_articles``: drop removed and empty ones, one row per URL."""
    title = tx.fix_spacing(F.coalesce("title", F.lit("")))
    text = tx.title_and_description(F.col("title"), F.col("description"))
    staged = articles.select(
        "file", "position", F.col("file_ticker").alias("ticker_hint"), title.alias("title"), text.alias("text"), "url",
        tx.utc_timestamp(F.col("publishedAt")).alias("ts"),
        tx.author_or_domain(F.col("source.name"), F.col("url")).alias("author_or_domain"),
    )
    removed = (F.lower(tx.trim(F.col("title"))) == "[removed]") | (tx.trim(F.col("text")) == "")
    audit = step_counts(staged, {"removed_or_empty": removed})
    first = keep_first(staged.filter(~removed), ["url"], ["file", "position"], "dup_count", F.col("title"))
    source = F.lit("newsapi")
    texts = _texts(
        first, source=source, ticker_hints=F.array("ticker_hint"),
        text_id=tx.text_id(source, F.col("ts"), F.col("ticker_hint"), F.col("text")),
    )
    return texts, with_duplicates(audit, first)


def normalize_headlines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``read_headlines``: per file, one row per URL and then per normalized title."""
    title = tx.trim(tx.fix_spacing(F.coalesce("title", F.lit(""))))
    staged = raw.select(
        "file", "position", F.col("file_ticker").alias("ticker_hint"), title.alias("title"), "url",
        F.coalesce("domain", F.lit("")).alias("author_or_domain"), tx.headline_timestamp(F.col("seendate")).alias("ts"),
    )
    short = tx.word_count(F.col("title")) < 3
    audit = step_counts(staged, {"short": short})
    by_url = keep_first(staged.filter(~short), ["file", "url"], ["position"], "dup_count")
    keyed = by_url.withColumn("_norm", tx.normalized_title(F.col("title")))
    first = keep_first(keyed, ["file", "_norm"], ["position"], null_keys_pass=False)
    source = F.lit("gdelt")
    texts = _texts(
        first, source=source, text=F.col("title"), ticker_hints=F.array("ticker_hint"),
        text_id=tx.text_id(source, F.col("ts"), F.col("ticker_hint"), F.col("title")),
    )
    return texts, with_duplicates(audit, first)


def normalize_labelled(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Benchmark headlines: one row per text, the first by file position."""
    staged = raw.select(
        F.lower(tx.trim(F.col("raw_label"))).alias("raw_label"),
        tx.trim(tx.fix_spacing(F.coalesce("text", F.lit("")))).alias("text"),
        F.monotonically_increasing_id().alias("_position"),
    )
    audit = step_counts(staged, {})
    first = keep_first(staged, ["text"], ["_position"], "dup_count", F.col("raw_label"))
    source = F.lit(fv.LABELLED_SOURCE)
    texts = _texts(
        first, source=source, author_or_domain=source, ts=F.lit(None).cast("timestamp"),
        ticker_hints=F.array().cast("array<string>"), text_id=tx.text_id(source, None, None, F.col("text")),
    )
    return texts, with_duplicates(audit, first)


def link_tweets(texts: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Link, then recompute the id with the resolved hint."""
    linked = link_entities(texts, dictionary)
    return linked.withColumn("text_id", tx.text_id(F.col("source"), F.col("ts"), F.col("ticker_hint"), F.col("text")))


def linked_corpus(
    tweets: DataFrame, articles: DataFrame, headlines: DataFrame, labelled: DataFrame | None = None,
    dictionary: Dictionary | None = None,
) -> DataFrame:
    """All normalized sources, linked, news merged across files by URL."""
    parts = [
        link_tweets(tweets, dictionary),
        merge_by_url(link_entities(articles, dictionary)),
        merge_by_url(link_entities(headlines, dictionary)),
    ]
    if labelled is not None:
        parts.append(link_entities(labelled, dictionary))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
