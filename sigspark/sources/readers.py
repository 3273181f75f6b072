"""Readers of raw text files, with explicit schemas and a total row order per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import Dictionary
from sigspark.schemas import LABEL_SHEET, RAW_ARTICLES, RAW_HEADLINES, RAW_LABELLED, RAW_TWEETS

#: Bytes on disk of a part that costly row-wise work takes at a time.
PART_BYTES = 32 << 20


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, multi-line CSV: Date, Tweet, Stock Name, Company Name."""
    return spark.read.csv(path, schema=RAW_TWEETS, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_labelled_news(spark: SparkSession, path: str) -> DataFrame:
    """Headerless latin-1 CSV: label, text."""
    return spark.read.csv(path, schema=RAW_LABELLED, header=False, multiLine=True, quote='"', escape='"', encoding="ISO-8859-1")


def read_label_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=LABEL_SHEET, header=True, multiLine=True, quote='"', escape='"')


def read_articles(spark: SparkSession, path: str, dictionary: Dictionary | None = None) -> DataFrame:
    """One JSON object per file holding ``articles``; the ticker comes from the file name.

    Each article becomes a row with its file and position. An unknown file name is an error.
    """
    names = (dictionary or Dictionary.default()).query_names()
    files = spark.read.schema(RAW_ARTICLES).json(path, multiLine=True).select(
        F.col("_metadata.file_name").alias("file"), "articles"
    )
    query = F.regexp_extract("file", fv.ARTICLE_FILE_PATTERN, 1)
    mapping = spark.createDataFrame(list(names.items()), "query string, file_ticker string")
    keyed = files.withColumn("query", query)
    unknown = keyed.join(mapping, "query", "left_anti").select("file").limit(5).collect()
    if unknown:
        raise ValueError(f"cannot map article files to tickers: {sorted(row['file'] for row in unknown)}")
    return keyed.join(mapping, "query").select(
        "file", "file_ticker", F.posexplode("articles").alias("position", "article")
    ).select("file", "file_ticker", "position", "article.*")


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file; the ticker is the file-name prefix (the index fund reads MARKET)."""
    rows = spark.read.schema(RAW_HEADLINES).json(path, multiLine=True).select(
        F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("position"),
        "url", "title", "seendate", "domain",
    )
    stamped = F.regexp_extract("file", fv.HEADLINE_FILE_PATTERN, 1)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    prefix = F.upper(F.when(stamped != "", stamped).otherwise(F.get(F.split(stem, "_"), 0)))
    return rows.withColumn("file_ticker", F.when(prefix == fv.BENCHMARK, fv.MARKET).otherwise(prefix))


def read_theme_files(spark: SparkSession, path: str, columns: int = 27) -> DataFrame:
    """Headerless tab-separated theme files; a missing folder gives an empty table."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    try:
        return spark.read.csv([f"{path}/*.csv", f"{path}/*.tsv"], schema=schema, sep="\t", mode="PERMISSIVE", quote="")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    found = []
    for suffix in ("csv", "tsv"):
        try:
            found.append(spark.read.csv(f"{path}/*.{suffix}", schema=schema, sep="\t", mode="PERMISSIVE", quote=""))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if not found:
        return spark.createDataFrame([], schema)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def standardize_headlines(raw: DataFrame, ticker: str) -> DataFrame:
    """Fetched article records: missing fields become empty, language defaults to English."""
    blank = F.lit("")
    return raw.select(
        *[F.coalesce(name, blank).alias(name) for name in ("url", "title", "seendate", "domain")],
        F.coalesce("language", F.lit("English")).alias("language"),
        F.upper(F.lit(ticker)).alias("ticker"),
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core work when a table comes in fewer files than there are cores.

    Costly row-wise work over one big file would otherwise run in one task. A table of many
    files is left alone: no shuffle. Rows go by key, so a retried task gets the same rows. A large
    table is cut into more parts than there are cores, so that a part does not grow with it.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    return df if len(files) >= cores else df.repartition(max(cores, file_bytes(df.sparkSession, files) // PART_BYTES), key)


def file_bytes(spark: SparkSession, files: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through the cluster's file system, so remote paths work too."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_first(spark: SparkSession, *paths: str | None, explicit: str | None = None) -> DataFrame:
    """Parquet table at the explicit path, else at the first candidate that exists."""
    if explicit is not None:
        if not path_exists(spark, explicit):
            raise FileNotFoundError(explicit)
        return spark.read.parquet(explicit)
    for path in paths:
        if path and path_exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of these tables exists: {[path for path in paths if path]}")
