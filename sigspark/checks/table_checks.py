"""Signal queries, summaries, profiles, samples, price tables, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.checks import text_sql  # noqa: F401  (defines the linking SQL)
from sigspark.checks.registry import query, wrap
from sigspark.checks.views import UNIVERSE, define, events, prices, signals, sql_with, table, texts
from sigspark.operators import profile, sampling
from sigspark.operators import query as q
from sigspark.operators.linking import link_entities
from sigspark.session import persist_table, shared_dir
from sigspark.sources import prices as price_tables
from sigspark.sources.readers import read_first
from sigspark.sources.writers import export_signals, long_metrics, write_signals


# ------------------------------------------------------------------ signal queries

@query("filtered_signals", sql_with("signals_v", """
SELECT text_id, ticker FROM signals_v WHERE ticker = 'TK03' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
  AND impact_score BETWEEN 2 AND 9.5 AND lower(event_type) = 'earnings' AND lower(source) = 'gdelt'"""))
def filtered_signals(spark, folder):
    where = q.SignalFilter("tk03 ", "2024-01-05", "2024-01-20T12:00:00", 2, 9.5, "EARNINGS", "GDELT")
    return q.select_signals(signals(spark, folder), where).select("text_id", "ticker")


@query("signal_page", wrap(sql_with("signals_v", """
SELECT text_id, ticker, impact_score FROM signals_v WHERE impact_score >= 5 ORDER BY ts, text_id, ticker LIMIT 50 OFFSET 25"""), "impact_score"))
def signal_page(spark, folder):
    return q.page(signals(spark, folder), q.SignalFilter(min_impact=5), 50, 25).select("text_id", "ticker", "impact_score")


@query("latest_signals", sql_with("signals_v", "SELECT text_id, ticker FROM signals_v ORDER BY ts DESC, text_id DESC, ticker DESC LIMIT 10"))
def latest_signals(spark, folder):
    return q.latest(signals(spark, folder), 10).select("text_id", "ticker")


@query("signal_by_id", sql_with("signals_v", "SELECT text_id, ticker, source FROM signals_v WHERE text_id = 42"))
def signal_by_id(spark, folder):
    return q.by_text_id(signals(spark, folder), 42).select("text_id", "ticker", "source")


ROSTER_TICKERS = [*UNIVERSE, "NONE1", "NONE2"]


@query("ticker_roster", wrap(sql_with("signals_v", f"""
SELECT ticker, coalesce(n, 0) AS n, ticker IN ('TK00', 'TK01', 'TK02') AS is_index_universe,
  coalesce(c, false) AND ticker NOT IN ('TK00', 'TK01', 'TK02') AS is_watchlist
FROM (SELECT unnest({ROSTER_TICKERS}) AS ticker, true AS c) FULL JOIN (SELECT ticker, count(*) AS n FROM signals_v GROUP BY ticker) USING (ticker)"""), "", "n"))
def ticker_roster(spark, folder):
    return q.roster(signals(spark, folder), ROSTER_TICKERS, ["TK00", "TK01", "TK02"])


@query("event_value_counts", wrap(sql_with("signals_v", "SELECT event_type, count(*) AS n FROM signals_v GROUP BY event_type"), "", "n"))
def event_value_counts(spark, folder):
    return q.value_counts(signals(spark, folder), "event_type")


BINS = " UNION ALL ".join(f"SELECT {low} AS low, '{label}' AS bin" for low, label in zip(range(1, 11), q.HISTOGRAM_LABELS))
HISTOGRAM = f"SELECT bin, count(text_id) AS n FROM ({BINS}) LEFT JOIN signals_v ON floor(impact_score) = low GROUP BY bin"


@query("impact_histogram", wrap(sql_with("signals_v", HISTOGRAM), "", "n"))
def impact_histogram(spark, folder):
    return q.impact_histogram(signals(spark, folder))


@query("signal_statistics", wrap(sql_with("signals_v", f"""
SELECT 'total' AS metric, 'all' AS key, count(*) AS value FROM signals_v
UNION ALL SELECT 'by_event_type', event_type, count(*) FROM signals_v GROUP BY event_type
UNION ALL SELECT 'by_source', source, count(*) FROM signals_v GROUP BY source
UNION ALL SELECT 'impact_histogram', bin, n FROM ({HISTOGRAM})"""), "", "value"))
def signal_statistics(spark, folder):
    return q.statistics(signals(spark, folder))


@query("coverage", wrap(sql_with("signals_v", """
SELECT count(*) AS n_signals, epoch_us(min(ts)) AS min_us, epoch_us(max(ts)) AS max_us FROM signals_v"""), "", "n_signals min_us max_us"))
def coverage(spark, folder):
    return q.coverage(signals(spark, folder)).select("n_signals", F.unix_micros("min_ts").alias("min_us"), F.unix_micros("max_ts").alias("max_us"))


@query("replay_from_start", sql_with("signals_v", "SELECT text_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ts FROM signals_v WHERE ts >= TIMESTAMP '2024-01-15' AND ticker = 'TK07'"))
def replay_from_start(spark, folder):
    return q.sanitized(q.replay(signals(spark, folder), "2024-01-15", "tk07")).select("text_id", "ts")


@query("price_range", wrap(sql_with("prices_v", "SELECT date, ticker, adj_close FROM prices_v WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-19' AND ticker = 'TK05'"), "adj_close"))
def price_range(spark, folder):
    return q.between_dates(prices(spark, folder), "date", "2024-01-08", "2024-01-19", "tk05").select("date", "ticker", "adj_close")


@query("crosstab_cube", wrap(sql_with("signals_v", """
SELECT CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS source, CASE WHEN grouping(event_type) = 1 THEN 'All' ELSE event_type END AS event_type,
  count(*) AS n FROM signals_v GROUP BY CUBE (source, event_type)"""), "", "n"))
def crosstab_cube(spark, folder):
    return q.crosstab(signals(spark, folder))


def _strongest(direction: str) -> str:
    return sql_with("signals_v", f"""SELECT text_id, ticker, impact_score FROM (SELECT *, 0.5 * sentiment_confidence + 0.5 * event_confidence AS confidence
FROM signals_v) ORDER BY impact_score {direction}, confidence {direction}, text_id, ticker LIMIT 10""")


def _with_confidence(spark, folder):
    return signals(spark, folder).withColumn("confidence", 0.5 * F.col("sentiment_confidence") + 0.5 * F.col("event_confidence"))


@query("top_impact", wrap(_strongest("DESC"), "impact_score"))
def top_impact(spark, folder):
    return q.strongest(_with_confidence(spark, folder)).select("text_id", "ticker", "impact_score")


@query("bottom_impact", wrap(_strongest("ASC"), "impact_score"))
def bottom_impact(spark, folder):
    return q.strongest(_with_confidence(spark, folder), ascending=True).select("text_id", "ticker", "impact_score")


@query("other_share", wrap(sql_with("signals_v", """
SELECT source, count(*) AS total, count_if(event_type = 'Other') AS other_count, 100.0 * avg((event_type = 'Other')::INT) AS other_pct
FROM signals_v GROUP BY source"""), "other_pct", "total other_count"))
def other_share(spark, folder):
    return q.other_share(signals(spark, folder))


@query("union_sources", wrap(sql_with("signals_v", "SELECT source, count(*) AS n, count(extra) AS n_extra FROM (SELECT source, NULL AS extra FROM signals_v WHERE source <> 'gdelt' UNION ALL SELECT source, 1 FROM signals_v WHERE source = 'gdelt') GROUP BY source"), "", "n n_extra"))
def union_sources(spark, folder):
    rows = signals(spark, folder)
    both = q.union_all(rows.filter("source != 'gdelt'"), rows.filter("source = 'gdelt'").withColumn("extra", F.lit(1)))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


@query("key_set", sql_with("signals_v prices_v", "SELECT ticker FROM signals_v UNION SELECT ticker FROM prices_v"))
def key_set(spark, folder):
    return q.union_key_set(signals(spark, folder), prices(spark, folder))


# ------------------------------------------------------------------ profiles

@query("null_counts", wrap(sql_with("texts_v", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS nulls FROM texts_v" for c in ("text_id", "ticker_hint", "title", "text"))), "", "nulls"))
def null_counts(spark, folder):
    return profile.null_counts(texts(spark, folder).select("text_id", "ticker_hint", "title", "text"))


@query("duplicate_profile", wrap("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents", "", "n_rows n_distinct n_duplicates"))
def duplicate_profile(spark, folder):
    return profile.duplicate_counts(table(spark, folder, "documents"), "text")


@query("length_profile", wrap(r"""
SELECT measure, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS p25,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max FROM (
  SELECT 'chars' AS measure, length(text) AS value FROM documents
  UNION ALL SELECT 'words', len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) FROM documents) GROUP BY measure""",
    "mean std p25 p50 p75", "n min max"))
def length_profile(spark, folder):
    return profile.length_profile(table(spark, folder, "documents"))


@query("monthly_counts", wrap("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1", "", "n"))
def monthly_counts(spark, folder):
    return profile.monthly_counts(table(spark, folder, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")))


@query("pattern_shares", wrap(r"""
SELECT pattern, count_if(hit) AS n, 100.0 * avg(hit::INT) AS pct FROM (
  SELECT 'url' AS pattern, regexp_matches(html, 'https?://\S+|www\.\S+', 'i') AS hit FROM pages
  UNION ALL SELECT 'mention', regexp_matches(html, '@\w+') FROM pages
  UNION ALL SELECT 'html_entity', regexp_matches(html, '&\w+;|&#\d+;') FROM pages) GROUP BY pattern""", "pct", "n"))
def pattern_shares(spark, folder):
    return profile.pattern_shares(table(spark, folder, "pages"), "html")


# ------------------------------------------------------------------ samples

def _sample_rows(spark, folder):
    return signals(spark, folder).withColumn("text_id", F.col("text_id").cast("string"))


@query("month_quotas", wrap("""
WITH RECURSIVE c AS (SELECT o_orderpriority AS g, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL),
levels AS (SELECT g, max(l) AS level FROM (SELECT g, l, sum(least(n, l)) AS used FROM c, (SELECT range AS l FROM range(0, 400)) GROUP BY g, l) WHERE used <= 500 GROUP BY g),
base AS (SELECT c.*, least(n, level) AS q, 500 - sum(least(n, level)) OVER (PARTITION BY c.g) AS spare, n > level AS large FROM c JOIN levels USING (g))
SELECT g AS priority, month, n AS available, q + CASE WHEN large AND sum(large::INT) OVER (PARTITION BY g ORDER BY month) <= spare THEN 1 ELSE 0 END AS quota FROM base""",
    "", "available quota"))
def month_quotas(spark, folder):
    """Quotas of a 500-row sample per order priority, level over months."""
    orders = table(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    counts = orders.groupBy(F.col("o_orderpriority").alias("priority"), "month").agg(F.count(F.lit(1)).alias("n"))
    return sampling.month_quotas(counts, "priority", "month", "n", 500)


@query("month_quota_sample", wrap("""
WITH RECURSIVE c AS (SELECT o_orderpriority AS g, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL),
levels AS (SELECT g, max(l) AS level FROM (SELECT g, l, sum(least(n, l)) AS used FROM c, (SELECT range AS l FROM range(0, 400)) GROUP BY g, l) WHERE used <= 500 GROUP BY g),
base AS (SELECT c.*, least(n, level) AS q, 500 - sum(least(n, level)) OVER (PARTITION BY c.g) AS spare, n > level AS large FROM c JOIN levels USING (g))
SELECT g AS priority, month, q + CASE WHEN large AND sum(large::INT) OVER (PARTITION BY g ORDER BY month) <= spare THEN 1 ELSE 0 END AS n FROM base""", "", "n"))
def month_quota_sample(spark, folder):
    """The sample itself, counted per month: every quota is met exactly."""
    orders = table(spark, folder, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS text_id", "o_orderpriority AS ticker_hint", "CAST(o_orderdate AS TIMESTAMP) AS ts"
    )
    sample = sampling.monthly_sample(orders, 500)
    return sample.groupBy(F.col("ticker_hint").alias("priority"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


DRAWN = "md5(concat_ws('|', 42, text_id))"
define("sample_rows", "SELECT *, CAST(text_id AS VARCHAR) AS id FROM signals_v", "signals_v")


@query("stratified_sample", wrap(sql_with("sample_rows", f"""
SELECT id AS text_id, event_type FROM (
  SELECT r.id, r.event_type, r.rank <= q.quota AS taken FROM (
    SELECT id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {DRAWN}, id) AS rank FROM sample_rows) r
  LEFT JOIN (SELECT event_type, round_even(count(*) / sum(count(*)) OVER () * 500, 0) AS quota FROM sample_rows WHERE event_type IS NOT NULL GROUP BY event_type) q USING (event_type))
ORDER BY NOT coalesce(taken, false), id LIMIT 500""")))
def stratified_sample(spark, folder):
    return sampling.stratified_sample(_sample_rows(spark, folder), 500, "event_type").select("text_id", "event_type")


@query("rare_class_sample", wrap(sql_with("sample_rows", f"""
SELECT * FROM (WITH rare AS (SELECT id, source, event_type FROM sample_rows WHERE event_type = 'Credit Event' ORDER BY {DRAWN}, id LIMIT 3000),
need AS (SELECT 3000 - count(*) AS n FROM rare),
rest AS (SELECT *, row_number() OVER (PARTITION BY source, event_type ORDER BY {DRAWN}, id) AS rank, greatest(1, round_even(count(*) OVER (PARTITION BY source, event_type) / count(*) OVER ()
  * (SELECT n FROM need), 0)) AS quota FROM sample_rows WHERE event_type <> 'Credit Event')
SELECT id AS text_id, source, event_type FROM rare
UNION ALL SELECT id, source, event_type FROM (SELECT *, row_number() OVER (ORDER BY rank > quota, {DRAWN}, id) AS place FROM rest) WHERE place <= (SELECT n FROM need))""")))
def rare_class_sample(spark, folder):
    return sampling.rare_preserving_sample(_sample_rows(spark, folder), 3000, ("Credit Event",)).select("text_id", "source", "event_type")


@query("uniform_sample", wrap(sql_with("sample_rows", f"SELECT id AS text_id, ticker FROM sample_rows ORDER BY {DRAWN}, id LIMIT 500")))
def uniform_sample(spark, folder):
    return sampling.uniform_sample(_sample_rows(spark, folder), 500).select("text_id", "ticker")


@query("label_sheet", wrap(sql_with("linked", f"""
SELECT CAST(text_id AS VARCHAR) AS text_id, source, md5(CASE WHEN source IN ('newsapi', 'gdelt') THEN coalesce(title, text) ELSE text END) AS text_md5, '' AS my_label FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {DRAWN}, CAST(text_id AS VARCHAR)) AS place FROM linked WHERE is_relevant AND source IN ('twitter_kaggle', 'newsapi', 'gdelt'))
WHERE place <= 40""")))
def label_sheet(spark, folder):
    linked = link_entities(texts(spark, folder)).withColumn("text_id", F.col("text_id").cast("string"))
    return sampling.label_sheet(linked).select("text_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), "my_label")


# ------------------------------------------------------------------ price tables

@query("wide_to_long_prices", wrap(sql_with("prices_v", """
SELECT date, ticker, adj_close AS close, adj_close FROM prices_v WHERE adj_close IS NOT NULL"""), "close adj_close"))
def wide_to_long_prices(spark, folder):
    """(field, ticker) column pairs of all series back to rows, then standardized."""
    picked = [row["ticker"] for row in prices(spark, folder).select("ticker").distinct().orderBy("ticker").collect()]  # the columns of the wide table
    wide = prices(spark, folder).groupBy(F.col("date").alias("Date")).agg(
        *[F.max(F.when(F.col("ticker") == t, F.col("adj_close"))).alias(name) for t in picked for name in (f"Close|{t}", f"{t}|Adj Close")]
    )
    return price_tables.standardize_prices(price_tables.wide_to_long(wide)).select("date", "ticker", "close", "adj_close")


@query("standardized_prices", wrap("""
SELECT event_id, close, adj_close FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS close,
  CASE WHEN event_id % 9 <> 0 THEN value END AS adj_close FROM events) WHERE close IS NOT NULL""", "close adj_close"))
def standardized_prices(spark, folder):
    """Text numbers coerced, bad ones dropped, adj_close filled from close."""
    raw = events(spark, folder).select(
        F.col("ts").alias("Datetime"), F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias(" Close "),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("Ticker"),
    )
    tidy = price_tables.standardize_prices(raw)
    return tidy.select(F.substring("ticker", 2, 20).cast("bigint").alias("event_id"), "close", "adj_close")


@query("daily_map_prices", wrap("""
SELECT CAST(d AS DATE) AS date, ticker, close FROM (SELECT 'TK' || lpad(CAST(user_id % 14 AS VARCHAR), 2, '0') AS ticker, CAST(ts AS DATE) AS d, max(value) AS close
FROM events GROUP BY ALL) WHERE d >= DATE '2024-01-10'""", "close"))
def daily_map_prices(spark, folder):
    """JSON maps keyed by date, filtered by start date."""
    days = events(spark, folder).selectExpr(
        "concat('tk', lpad(CAST(user_id % 14 AS STRING), 2, '0')) AS ticker", "CAST(to_date(ts) AS STRING) AS day", "value"
    ).groupBy("ticker", "day").agg(F.max("value").alias("close"))
    value = F.create_map(F.lit("1. open"), F.col("close").cast("string"), F.lit("4. close"), F.col("close").cast("string"))
    payloads = days.select("ticker", F.to_json(F.create_map(F.col("day"), value)).alias("payload"))
    return price_tables.from_daily_map(payloads, "2024-01-10").select("date", "ticker", "close")


@query("preferred_prices", wrap(sql_with("prices_v", """
SELECT date, ticker, adj_close FROM prices_v WHERE ticker < 'TK05' UNION ALL SELECT date, ticker, adj_close + 1 FROM prices_v WHERE ticker >= 'TK05'"""), "adj_close"))
def preferred_prices(spark, folder):
    """Fallback rows only for tickers the primary source lacks."""
    all_prices = prices(spark, folder).select("date", "ticker", "adj_close")
    return price_tables.prefer(all_prices.filter("ticker < 'TK05'"), all_prices.withColumn("adj_close", F.col("adj_close") + 1))


# ------------------------------------------------------------------ sinks and fallbacks

@query("export_round_trip", wrap(sql_with("signals_v", "SELECT count(*) AS n, sum(impact_score) AS total FROM signals_v WHERE ticker = 'TK01'"), "total", "n"))
def export_round_trip(spark, folder):
    """Filtered export as JSON lines, read back."""
    path = shared_dir(spark, "export")
    export_signals(signals(spark, folder), path, "jsonl", q.SignalFilter(ticker="TK01"))
    return spark.read.schema("impact_score double").json(path).agg(F.count(F.lit(1)).alias("n"), F.sum("impact_score").alias("total"))


@query("export_limit", sql_with("signals_v", """
SELECT text_id, ticker, 'limit' AS kind FROM (SELECT * FROM signals_v ORDER BY ts, text_id, ticker LIMIT 5000)
UNION ALL SELECT text_id, ticker, 'offset' FROM (SELECT * FROM signals_v ORDER BY ts, text_id, ticker OFFSET 10)"""))
def export_limit(spark, folder):
    """Exports larger than a page: exactly the rows asked for, read back."""
    table_, parts = signals(spark, folder), []
    for kind, limit, offset in (("limit", 5000, 0), ("offset", None, 10)):
        path = shared_dir(spark, f"export-{kind}")
        export_signals(table_, path, "jsonl", limit=limit, offset=offset)
        parts.append(spark.read.schema("text_id bigint, ticker string").json(path).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


@query("csv_round_trip", wrap(sql_with("linked", "SELECT text_id, '[' || array_to_string(list_transform(linked_tickers, lambda t: '\"' || t || '\"'), ',') || ']' AS linked_tickers FROM linked")))
def csv_round_trip(spark, folder):
    """Arrays travel through CSV as JSON text."""
    path = shared_dir(spark, "csv")
    write_signals(link_entities(texts(spark, folder)).select("text_id", "linked_tickers"), path, "csv")
    return spark.read.csv(path, schema="text_id bigint, linked_tickers string", header=True, escape='"')


@query("source_fallback", wrap("SELECT count(*) AS n FROM orders", "", "n"))
def source_fallback(spark, folder):
    """First existing table of a list of candidates."""
    return read_first(spark, f"{folder}/missing.parquet", f"{folder}/orders.parquet").agg(F.count(F.lit(1)).alias("n"))


@query("metric_report", wrap(sql_with("signals_v", """
SELECT 'counts' AS suite, source AS key, 'n' AS metric, count(*)::DOUBLE AS value FROM signals_v GROUP BY source"""), "value"))
def metric_report(spark, folder):
    return long_metrics(signals(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "counts", ["source"])
