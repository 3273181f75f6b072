"""Ingestion: driver rows written in the raw formats and read back through the readers and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.checks.registry import query, wrap
from sigspark.checks.text_sql import spacing_sql
from sigspark.checks.views import sql_with, table, texts
from sigspark.functions import text as tx
from sigspark.plans import ingest
from sigspark.session import shared_dir
from sigspark.sources import readers, writers

SPACED = "concat('Report ', doc_id, ' , 1 , 2 , 3 . 5 fell - off : well - known 7 - 8 ; ', text, ' !')"


@query("token_spacing", f"SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {spacing_sql(SPACED)} AS t FROM documents)")
def token_spacing(spark, folder):
    """Spacing repair of whole texts, with a lead that has something to repair."""
    lead = F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(" , 1 , 2 , 3 . 5 fell - off : well - known 7 - 8 ; "))
    spaced = tx.fix_spacing(F.concat(lead, "text", F.lit(" !")))
    return table(spark, folder, "documents").select("doc_id", spaced.alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("tweets_csv", "SELECT CAST(doc_id AS VARCHAR) AS company, strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS date, md5('say \"hi\", ' || text) AS text_md5, source AS stock FROM documents")
def tweets_csv(spark, folder):
    """Quoted CSV with line feeds, quotes and commas inside fields."""
    path = shared_dir(spark, "tweets-csv")
    when = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("doc_id").cast("int")), "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, folder, "documents").select(
        when.alias("Date"), F.concat(F.lit('say "hi", '), "text").alias("Tweet"), F.col("source").alias("Stock Name"), F.col("doc_id").cast("string").alias("Company Name")
    )
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = readers.read_tweets(spark, path)
    return read.select(F.col("Company Name").alias("company"), F.col("Date").alias("date"), F.md5(F.col("Tweet").cast("binary")).alias("text_md5"), F.col("Stock Name").alias("stock"))


@query("latin1_csv", r"SELECT CAST(doc_id AS VARCHAR) AS raw_label, md5(regexp_replace('é ' || text, '[^\x{0}-\x{ff}]', '?', 'g')) AS text_md5 FROM documents")
def latin1_csv(spark, folder):
    """Headerless latin-1 CSV; letters outside of it are replaced before writing."""
    path = shared_dir(spark, "latin1-csv")
    plain = F.regexp_replace(F.concat(F.lit("é "), "text"), r"[^\x{0}-\x{ff}]", "?")
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("raw_label"), plain.alias("text"))
    rows.write.csv(path, quoteAll=True, escape='"', encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_labelled_news(spark, path).select("raw_label", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("theme_files", """SELECT CAST(o_orderkey AS VARCHAR) AS c0, o_orderpriority AS c1, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS c2, NULL::VARCHAR AS c3 FROM orders""")
def theme_files(spark, folder):
    """Tab-separated files without header, with rows that are too short."""
    path = shared_dir(spark, "themes")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")))
    table(spark, folder, "orders").select(line.alias("line")).write.csv(path, sep="|", quote="")
    return readers.read_theme_files(spark, path, 4)


@query("fetched_headlines", """SELECT page_id, coalesce(url, '') AS url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Title ' || page_id END AS title, '' AS seendate,
  CASE WHEN page_id % 2 = 0 THEN 'd.test' ELSE '' END AS domain, CASE WHEN page_id % 4 = 0 THEN 'English' ELSE 'French' END AS language, 'KO' AS ticker FROM pages""")
def fetched_headlines(spark, folder):
    """Fetched records with missing fields."""
    page = F.col("page_id")
    raw = table(spark, folder, "pages").select(
        "page_id", "url", F.when(page % 3 != 0, F.concat(F.lit("Title "), page.cast("string"))).alias("title"), F.lit(None).cast("string").alias("seendate"),
        F.when(page % 2 == 0, "d.test").alias("domain"), F.when(page % 4 != 0, "French").alias("language"),
    )
    named = readers.standardize_headlines(raw.withColumn("url", F.concat(page.cast("string"), F.lit(" "), F.coalesce("url", F.lit("")))), "ko")
    split = F.split("url", " ", 2)
    return named.select(F.get(split, 0).cast("bigint").alias("page_id"), F.get(split, 1).alias("url"), "title", "seendate", "domain", "language", "ticker")


@query("parquet_round_trip", "SELECT o_orderkey, o_orderpriority, o_custkey FROM orders")
def parquet_round_trip(spark, folder):
    """Partitioned Parquet under a size guard, read back."""
    path = shared_dir(spark, "parquet-out")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    writers.write_parquet(orders, path, max_bytes=1 << 50, partition_by=["o_orderpriority"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderpriority", "o_custkey")


@query("linked_text_ids", sql_with("linked", """SELECT text_id AS number,
  substr(sha1(concat_ws('|', source, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00', coalesce(ticker_hint, ''), text)), 1, 16) AS text_id FROM linked"""))
def linked_text_ids(spark, folder):
    """Ids made anew from the hint that linking resolved."""
    rows = texts(spark, folder).withColumn("number", F.col("text_id"))
    return ingest.link_tweets(rows).select("number", "text_id")


LABELLED = """SELECT CASE quality WHEN 1 THEN 'Positive ' ELSE ' neutral' END AS raw_label, 'Profit of firm ' || doc_id % 97 AS text, doc_id FROM labels"""


@query("labelled_news", wrap(f"""SELECT text, count(*) AS dup_count, substr(sha1(concat_ws('|', 'financial_phrasebank', '', '', text)), 1, 16) AS text_id,
  max(one) AS raw_label FROM (SELECT text, lower(trim(first_value(raw_label) OVER (PARTITION BY text ORDER BY doc_id))) AS one FROM ({LABELLED})) GROUP BY text""", "", "dup_count"))
def labelled_news(spark, folder):
    """Labels trimmed and in lower case, one row a text with its count."""
    labels = table(spark, folder, "labels").orderBy("doc_id")
    label = F.when(F.col("quality") == 1, "Positive ").otherwise(" neutral")
    raw = labels.select(label.alias("raw_label"), F.concat(F.lit("Profit of firm "), (F.col("doc_id") % 97).cast("string")).alias("text"))
    found, _ = ingest.normalize_labelled(raw)
    return found.select("text", "dup_count", "text_id", "raw_label")


RAW_TWEETS = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'TSLA' WHEN 1 THEN 'goog' WHEN 2 THEN 'AAPL' WHEN 3 THEN 'ZZZZ' ELSE 'MSFT' END AS hint,
  CASE WHEN doc_id % 11 = 0 THEN 'two words' ELSE 'Tweet number ' || (doc_id * 7) % 41 || ' of many' END AS text FROM documents"""


@query("tweet_audit", f"""WITH r AS (SELECT doc_id, CASE upper(hint) WHEN 'GOOG' THEN 'GOOGL' ELSE upper(hint) END AS hint, text FROM ({RAW_TWEETS})),
k AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(doc_id % 3) AS ts FROM r WHERE hint <> 'ZZZZ' AND text <> 'two words'),
f AS (SELECT text, hint, min(ts) AS ts FROM k GROUP BY text, hint), m AS (SELECT text, ts FROM f GROUP BY text, ts)
SELECT (SELECT count(*) FROM r) AS raw_count, (SELECT count(*) FROM r WHERE hint = 'ZZZZ') AS dropped_non_universe, (SELECT count(*) FROM r WHERE hint <> 'ZZZZ' AND text = 'two words') AS dropped_short,
  (SELECT count(*) FROM k) AS kept_count, 0 AS kept_undated, (SELECT count(*) FROM k) - (SELECT count(*) FROM f) AS dropped_per_hint_dups,
  (SELECT count(*) FROM f) - (SELECT count(*) FROM m) AS dropped_cross_hint_dups, (SELECT count(*) FROM m) AS final_count""")
def tweet_audit(spark, folder):
    """The whole ledger of tweets: raw, dropped per reason, duplicates under one and under several labels, final."""
    number = F.col("doc_id")
    hint = F.when(number % 5 == 0, "TSLA").when(number % 5 == 1, "goog").when(number % 5 == 2, "AAPL").when(number % 5 == 3, "ZZZZ").otherwise("MSFT")
    text = F.when(number % 11 == 0, "two words").otherwise(F.concat(F.lit("Tweet number "), ((number * 7) % 41).cast("string"), F.lit(" of many")))
    when = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(number % 3).cast("int")), "yyyy-MM-dd HH:mm:ss")
    raw = table(spark, folder, "documents").select(when.alias("Date"), text.alias("Tweet"), hint.alias("Stock Name"), F.lit("x").alias("Company Name"))
    _, audit = ingest.normalize_tweets(raw)
    return audit
