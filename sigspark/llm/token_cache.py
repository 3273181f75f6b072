"""Token counts through a cache of digests.

The cache is a Parquet folder of (tokenizer, digest, n_tokens). The digest of a text is SHA-256 of its normalised
content: a null text is an empty one, and nothing else is changed, since a count must be the library's for the very
text. A tokenizer is known by the digest of its file, its library's version and its options. Texts are joined to the
cache by both digests; of the texts that it lacks one row for each digest is encoded, and the counts are appended.

Only ids and digests take part in the search for misses; a text moves once, to the place of its row key, so copies do
not meet in one task. Defined results: empty and null texts have the count that the library gives "", repeated rows
have equal counts, an empty table gives no rows and appends nothing, and a cache folder that does not exist is empty.
A digest that two runs append at once is read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import documents, row_key

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
FIXED_OPTIONS = "no added tokens, special strings as the library's default, whole texts"


def vocabulary_digest(path: str) -> str:
    """Tokenizer version: the file's bytes, the library and its version, and the options."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{content} {library} {version(library)} {FIXED_OPTIONS}".encode()).hexdigest()


_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Texts -> token counts by the library of the file's kind; loaded once in a worker process."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary is on this machine (asked on the machine that reads it)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, one row per digest."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.range(0).selectExpr("cast(null as binary) as digest", "id as n_tokens")
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, cache: str, name: str, tokenizer: str, batch_chars: int = 2_000_000) -> None:
    """Encode one text of each digest that the cache lacks, and append the counts."""
    spark = docs.sparkSession
    ids = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), row_key().alias("key"))
    first = ids.groupBy("digest").agg(F.min("key").alias("key"))
    missing = first.join(read_cache(spark, cache, tokenizer), "digest", "left_anti").select("key")
    texts = docs.select(row_key().alias("key"), "text").join(missing, "key", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = counter(vocabulary_path(name))
        for batch in batches:
            pending: list[str] = []
            counts: list[int] = []
            size = 0
            for text in batch["text"]:
                pending.append(text)
                size += len(text)
                if size >= batch_chars:
                    counts += encode(pending)
                    pending, size = [], 0
            counts += encode(pending) if pending else []
            digests = [hashlib.sha256(t.encode("utf-8")).digest() for t in batch["text"]]
            yield pd.DataFrame({"digest": digests, "n_tokens": counts}).drop_duplicates("digest")

    counted = texts.select("text").mapInPandas(count, "digest binary, n_tokens long")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # rows repeated with id and text
    counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)


def token_counts(df: DataFrame, cache: str, name: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens per row. ``name``: a vocabulary file's name; ``cache``: a folder that all machines share."""
    docs = documents(df, doc_id, text)
    tokenizer = vocabulary_digest(vocabulary_path(name))
    encode_misses(docs, cache, name, tokenizer)
    known = read_cache(df.sparkSession, cache, tokenizer)
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return rows.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
