"""The registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sigspark.llm import chat, decontam, line_dedup, merkle, pieces, prefix_trie, quality_rules, sharding, simhash, suffixes, token_cache, toxicity, whitening
from sigspark.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"
TOKENIZER, TOKEN_LIMIT = "piece_bpe_32k.model", 4096
SHARDS = 24


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))
    + {len(chat.TURN + chat.TEXT + chat.END)}) AS BIGINT) AS formatted_chars,
  0 AS n_attachments
FROM turns GROUP BY conv_id"""


@query("op1_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted with typed parts, then read back from the formatted text."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    typed = turns.unionByName(probe).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    formatted = chat.format_conversations(typed).withColumn("turns", chat.read_back(F.col("formatted")))
    text_of = lambda t: F.array_join(F.transform(t["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), text_of(t), F.lit("\n"))), "")
    learned = chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").alias("n_attachments"),
    )


LINE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM docs),
plain AS (SELECT doc_id, nth, line, trim(regexp_replace(translate(line, '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '[ \\t\\r\\f\\v]+', ' ', 'g')) AS p,
  sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth) - length(line) - 1 AS start FROM cut),
ranked AS (SELECT *, p <> '' AND length(p) - length(replace(p, ' ', '')) + 1 >= {line_dedup.MIN_WORDS}
  AND row_number() OVER (PARTITION BY p ORDER BY doc_id, nth) > 1 AS gone FROM plain)
SELECT doc_id, CAST(sum(length(line) + 1) - 1 AS BIGINT) AS n_chars, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed_lines,
  CAST(coalesce(sum(length(line)) FILTER (gone), 0) AS BIGINT) AS n_removed,
  coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(line) AS BIGINT), ',' ORDER BY nth) FILTER (gone), '') AS removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id"""


@query("op2_line_dedup", LINE_SQL)
def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without the lines that an earlier document, or the same one before, has already."""
    out = line_dedup.line_dedup(table(spark, folder, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    lost_feeds = F.when(F.col("n_removed_lines") == F.col("n_lines"), F.col("n_lines") - 1).otherwise(F.col("n_removed_lines"))
    return out.select(
        "doc_id",
        (F.length("kept_text") + F.col("n_removed") + lost_feeds).cast("long").alias("n_chars"),
        "n_lines",
        "n_removed_lines",
        "n_removed",
        spans.alias("removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@query("op3_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the best window's similarity."""
    found = decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("first_shingle").cast("long").alias("first_shingle"))


MERKLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
  coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT doc_id, next_id, text, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, next_id, 0 AS side, text FROM e UNION ALL SELECT doc_id, next_id, 1, edited FROM e),
l AS (SELECT *, list_transform(string_split(text, chr(10)), lambda line: list_transform(string_split(
  regexp_replace(regexp_replace(line, '([.!?]) ', '\\1' || chr(1) || ' ', 'g'), '([^' || chr(1) || ']{{{merkle.LEAF_CHARS}}})', '\\1' || chr(1), 'g'),
  chr(1)), lambda x: md5(x))) AS leaves FROM t),
p AS (SELECT *, list_transform(list_zip(leaves, string_split(text, chr(10))), lambda z: md5(array_to_string(z[1], '') || md5(z[2]))) AS paragraphs FROM l),
s AS (SELECT *, list_filter(string_split(array_to_string(list_transform(paragraphs, lambda p: p || CASE WHEN substr(p, 1, 1) <= '3' THEN '|' ELSE '' END), ''), '|'),
  lambda x: x <> '') AS sections FROM p),
r AS (SELECT *, md5(array_to_string(list_transform(sections, lambda x: md5(x)), '') || length(text)) AS root FROM s),
f AS (SELECT doc_id, next_id, side, text, root, root || ' ' || array_to_string(list_transform(list_zip(paragraphs, leaves), lambda z: substr(z[1], 1, 8) || ':'
  || array_to_string(list_transform(z[2], lambda x: substr(x, 1, 8)), ',') || CASE WHEN substr(z[1], 1, 1) <= '3' THEN '|' ELSE ';' END), '') AS fp,
  list_distinct(list_transform(flatten(leaves), lambda x: substr(x, 1, 8))) AS leaf FROM r)
SELECT a.doc_id, CAST(length(a.text) AS BIGINT) AS n_chars, sha256(b.text) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0 ELSE CAST(2 * len(list_intersect(a.leaf, b.leaf)) AS DOUBLE) / (len(a.leaf) + len(b.leaf)) END AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0 ELSE CAST(2 * len(list_intersect(a.leaf, c.leaf)) AS DOUBLE) / (len(a.leaf) + len(c.leaf)) END AS near_next
FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.side = 1 JOIN f c ON a.next_id = c.doc_id AND c.side = 0 WHERE a.side = 0"""


@query("op4_document_fingerprints", MERKLE_SQL)
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle fingerprints of each document and of its edited text, with likenesses."""
    return merkle.edited_fingerprints(table(spark, folder, "documents"))


@query("op5_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a machine fitted on the labelled documents that are not held out."""
    documents = table(spark, folder, "documents")
    model = toxicity.fit_on(documents, table(spark, folder, "labels"))
    scores = toxicity.toxicity_scores(documents, model)
    return scores.select(
        "doc_id", (~toxicity.learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query("op6_simhash_dedup")
def simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's fingerprint and the smallest id that links within three bits lead to."""
    groups = simhash.simhash_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_sentencepiece")
def sentencepiece_query(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's best pieces, and whether they decode to its text."""
    return pieces.encode(table(spark, folder, "documents"), TOKENIZER)


@query("op8_suffix_dedup")
def suffix_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without the bytes that a 400-byte string covers which also starts elsewhere."""
    cut = suffixes.suffix_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    kept = (F.col("n_bytes") - F.col("n_removed")).alias("n_kept")
    return cut.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", kept)


@query("op9_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents through a digest cache that starts empty."""
    counts = token_cache.token_counts(table(spark, folder, "documents"), shared_dir(spark, "token-counts"), TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


SHARD_SQL = None  # the order is random; tests hold it to its law


@query("op10_sharding", SHARD_SQL)
def shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written in one random order, cut into shards of equal counts, and read back from the shards."""
    documents = table(spark, folder, "documents")
    sized = sharding.sized_columns()
    path = shared_dir(spark, "shards")
    sharding.write_shards(documents, path, SHARDS, ["doc_id", *sized.values()], sized["size"])
    written = spark.read.schema(StructType([*documents.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])).parquet(path).withColumns(sized)
    return written.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding's whitened components, from exact integer scatter sums. A deviation too large for a long is null."""
    out = whitening.whitened_table(table(spark, folder, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


TRIE_SQL = f"""
WITH own AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS j FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, c - c % {prefix_trie.SHARED_SPAN} AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
  string_split(CAST(c AS VARCHAR), ''), lambda x: list_transform(range(8), lambda b: (CAST(ascii(x) AS BIGINT) >> CAST(b AS BIGINT)) & 1)))),
  lambda a, d: xor(a >> 1, 3988292384 * (xor(a, d) & 1))), 4294967295) % {prefix_trie.SHARED_AT_MOST} AS h FROM own),
parts AS (SELECT convs.c, 0 AS part, j, role, text FROM convs JOIN own ON own.c = convs.base AND own.j <= convs.h
  UNION ALL SELECT convs.c, 1, j, role, text FROM convs JOIN own ON own.c = convs.c AND own.j > convs.h),
built AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, j) AS d, length(text) AS chars,
  string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY part, j) AS k FROM parts),
paths AS (SELECT c, d, k, chars FROM built UNION ALL SELECT c, 0, '', 0 FROM convs),
ends AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
nodes AS (SELECT p.d, k, min(p.c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
  sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (ends.d = p.d), '')) AS ends_sha256 FROM paths p JOIN ends USING (c) GROUP BY p.d, k),
above AS (SELECT d, k, conv_id FROM nodes),
children AS (SELECT d - 1 AS d, left(k, 32 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
sub AS (SELECT DISTINCT u.d, u.k, v.d AS vd, v.k AS vk FROM paths u JOIN paths v ON u.c = v.c AND v.d >= u.d),
sums AS (SELECT sub.d, sub.k, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (children.n IS NULL) AS leaves
  FROM sub JOIN nodes ON nodes.d = vd AND nodes.k = vk LEFT JOIN children ON children.d = vd AND children.k = vk GROUP BY sub.d, sub.k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(children.n, 0) AS BIGINT) AS n_children,
  CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON sums.d = n.d AND sums.k = n.k LEFT JOIN children ON children.d = n.d AND children.k = n.k
LEFT JOIN above ON n.d > 0 AND above.d = n.d - 1 AND above.k = left(n.k, 32 * (n.d - 1))"""


@query("op12_conversation_prefix_trie", TRIE_SQL)
def conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@query("op13_quality_rules")
def quality_rules_query(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all documents, the base rule, and the verdict of rules learned from the labelled documents that are not held out."""
    documents = table(spark, folder, "documents")
    out = quality_rules.judged(documents, quality_rules.fit_rules(documents, table(spark, folder, "labels")))
    return out.select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "rule")
