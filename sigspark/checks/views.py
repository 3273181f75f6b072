"""Stand-in tables derived from the driver tables, in Spark and in SQL.

Signals and prices come from ``events``, texts from ``documents`` (whole texts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigspark.config import PortfolioParams
from sigspark.operators.alignment import Calendar, trading_calendar
from sigspark.sources.readers import spread

UNIVERSE = tuple(f"TK{i:02d}" for i in range(14))
PARAMS = PortfolioParams(universe=UNIVERSE)

PHRASES = [
    "$AAPL shares jump after quarterly earnings beat",
    "Regulator opens antitrust probe into Alphabet",
    "Boeing unveils new device for pilots",
    "$TSLA $NVDA $AMD $SNOW earnings report due",
    "Fed pauses as inflation cools, treasury yields fall",
    "Moody's cuts credit rating of Boeing to junk status",
    "Russia sanctions widen, export controls on chips from Nvidia",
    "Takeover bid: merger talks lift $KO and $PG",
    "Nice weather today",
    "pls retweet giveaway $USD $brk.b",
    "Barclays raises its price target, analyst upgraded to buy $MSFT",
    "I think the merger of Netflix and Disney+ is a joke",
    "Microsoft and Amazon.com launch a new service",
    "JPM and XOM report revenue growth",
    "Upcoming Earnings Report - Week of May $KO $PG $BA",
    "tariffs again, call options on Tesla Motors",
    "iPhone sales drop at Apple Inc, analyst says",
    "Quarterly earnings report for $AAPL, $MSFT, $AMZN and $FB",
    "Troubled developer fails to pay bond coupon payment",
    "Most Anticipated Releases $AAPL $AMZN $BA $GOOGL $KO",
]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up once per path."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def signals_from(source: DataFrame) -> DataFrame:
    """Signal rows from event rows; works on streams too."""
    return source.selectExpr(
        "event_id AS text_id",
        "ts",
        "CASE WHEN event_id % 25 = 7 THEN 'MARKET' ELSE concat('TK', lpad(CAST(user_id % 14 AS STRING), 2, '0')) END AS ticker",
        "CASE WHEN event_id % 40 = 3 THEN 'financial_phrasebank' WHEN event_id % 3 = 0 THEN 'twitter_kaggle' "
        "WHEN event_id % 3 = 1 THEN 'newsapi' ELSE 'gdelt' END AS source",
        "CAST((event_id * 7919) % 2001 AS DOUBLE) / 1000D - 1D AS sentiment_score",
        "CASE event_type WHEN 'click' THEN 'Product Launch' WHEN 'signup' THEN 'Earnings' "
        "WHEN 'purchase' THEN 'Merger/Acquisition' WHEN 'error' THEN 'Credit Event' ELSE 'Other' END AS event_type",
        "1D + CAST((event_id * 104729) % 9001 AS DOUBLE) / 1000D AS impact_score",
        "CASE WHEN event_type = 'view' THEN 0.2D ELSE 0.6D + CAST(event_id % 5 AS DOUBLE) / 10D END AS event_confidence",
        "0.5D + CAST(event_id % 6 AS DOUBLE) / 10D AS sentiment_confidence",
        "CASE WHEN event_id % 10 = 0 THEN 0.3333D ELSE 1D END AS attribution_weight",
        "event_id % 10 = 0 AS is_broadcast",
        "value",
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return signals_from(events(spark, folder))


SIGNALS_SQL = """
SELECT event_id AS text_id, ts,
  CASE WHEN event_id % 25 = 7 THEN 'MARKET' ELSE concat('TK', lpad(CAST(user_id % 14 AS VARCHAR), 2, '0')) END AS ticker,
  CASE WHEN event_id % 40 = 3 THEN 'financial_phrasebank' WHEN event_id % 3 = 0 THEN 'twitter_kaggle'
    WHEN event_id % 3 = 1 THEN 'newsapi' ELSE 'gdelt' END AS source,
  CAST((event_id * 7919) % 2001 AS DOUBLE) / 1000 - 1 AS sentiment_score,
  CASE event_type WHEN 'click' THEN 'Product Launch' WHEN 'signup' THEN 'Earnings'
    WHEN 'purchase' THEN 'Merger/Acquisition' WHEN 'error' THEN 'Credit Event' ELSE 'Other' END AS event_type,
  1 + CAST((event_id * 104729) % 9001 AS DOUBLE) / 1000 AS impact_score,
  CASE WHEN event_type = 'view' THEN 0.2::DOUBLE ELSE 0.6::DOUBLE + CAST(event_id % 5 AS DOUBLE) / 10 END AS event_confidence,
  0.5::DOUBLE + CAST(event_id % 6 AS DOUBLE) / 10 AS sentiment_confidence,
  CASE WHEN event_id % 10 = 0 THEN 0.3333::DOUBLE ELSE 1::DOUBLE END AS attribution_weight,
  event_id % 10 = 0 AS is_broadcast, value
FROM events"""


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Weekday price per ticker, and the benchmark as the all-ticker mean, in one pass."""
    rows = events(spark, folder).selectExpr(
        "concat('TK', lpad(CAST(user_id % 14 AS STRING), 2, '0')) AS ticker", "to_date(ts) AS date", "value"
    ).filter("weekday(date) < 5")
    grouped = rows.groupingSets([["date", "ticker"], ["date"]], "date", "ticker").agg(
        (50.0 + F.avg("value")).alias("adj_close"), F.grouping("ticker").alias("_all")
    )
    return grouped.select("date", F.when(F.col("_all") == 1, "SPY").otherwise(F.col("ticker")).alias("ticker"), "adj_close")


PRICES_SQL = """
SELECT date, ticker, 50 + avg(value) AS adj_close FROM (
  SELECT concat('TK', lpad(CAST(user_id % 14 AS VARCHAR), 2, '0')) AS ticker, CAST(ts AS DATE) AS date, value FROM events
) WHERE isodow(date) <= 5 GROUP BY date, ticker
UNION ALL
SELECT date, 'SPY', 50 + avg(value) FROM (SELECT CAST(ts AS DATE) AS date, value FROM events)
WHERE isodow(date) <= 5 GROUP BY date"""


def calendar(spark: SparkSession, folder: str) -> Calendar:
    """Trading calendar, evaluated once (bounded by the number of days)."""
    days = events(spark, folder).selectExpr("to_date(ts) AS date", "'SPY' AS ticker").filter("weekday(date) < 5")
    return Calendar.of(trading_calendar(days))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Unified, scored text table over whole documents."""
    phrases = F.array(*[F.lit(phrase) for phrase in PHRASES])
    number = F.col("doc_id")
    docs = spread(table(spark, folder, "documents").select("doc_id", F.col("text").alias("body")), "doc_id")
    phrase = F.get(phrases, (number % len(PHRASES)).cast("int"))
    source = F.when(number % 3 == 0, "twitter_kaggle").when(number % 3 == 1, "newsapi").otherwise("gdelt")
    hint = F.when(number % 4 == 0, "AAPL").when(number % 4 == 1, "PG").when(number % 4 == 2, "MSFT")
    staged = docs.withColumns({"_phrase": phrase, "source": source, "ticker_hint": hint})
    return staged.select(
        F.col("doc_id").alias("text_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(number * 37).cast("int"))).alias("ts"),
        "source",
        "ticker_hint",
        F.when(F.col("ticker_hint").isNull(), F.array().cast("array<string>"))
        .when(number % 8 == 0, F.array("ticker_hint", F.lit("AMZN")))
        .otherwise(F.array("ticker_hint"))
        .alias("ticker_hints"),
        F.when(F.col("source") != "twitter_kaggle", F.col("_phrase")).alias("title"),
        F.concat("_phrase", F.lit(" "), "body").alias("text"),
        F.concat(F.lit("http://ex.test/"), (number % 97).cast("string")).alias("url"),
        (1 + number % 4).alias("dup_count"),
        ((number * 7919) % 2001).cast("double").__truediv__(1000.0).__sub__(1.0).alias("sentiment_score"),
        (0.5 + (number % 6).cast("double") / 10.0).alias("sentiment_confidence"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


TEXTS_SQL = f"""
SELECT doc_id AS text_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS ts, source, ticker_hint,
  CASE WHEN ticker_hint IS NULL THEN []::VARCHAR[] WHEN doc_id % 8 = 0 THEN [ticker_hint, 'AMZN'] ELSE [ticker_hint] END AS ticker_hints,
  CASE WHEN source <> 'twitter_kaggle' THEN phrase END AS title,
  concat(phrase, ' ', body) AS text, concat('http://ex.test/', CAST(doc_id % 97 AS VARCHAR)) AS url,
  1 + doc_id % 4 AS dup_count,
  CAST((doc_id * 7919) % 2001 AS DOUBLE) / 1000 - 1 AS sentiment_score,
  0.5::DOUBLE + CAST(doc_id % 6 AS DOUBLE) / 10 AS sentiment_confidence
FROM (
  SELECT doc_id, text AS body,
    [{', '.join(_quoted(p) for p in PHRASES)}][doc_id % {len(PHRASES)} + 1] AS phrase,
    CASE doc_id % 3 WHEN 0 THEN 'twitter_kaggle' WHEN 1 THEN 'newsapi' ELSE 'gdelt' END AS source,
    CASE doc_id % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'PG' WHEN 2 THEN 'MSFT' END AS ticker_hint
  FROM documents)"""

# common table expressions in dependency order
CTES = {
    "signals_v": SIGNALS_SQL,
    "prices_v": PRICES_SQL,
    "texts_v": TEXTS_SQL,
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM prices_v WHERE ticker = 'SPY')",
    "sig_t0": """SELECT s.*, c.date AS t0, c.idx AS t0_idx
FROM (SELECT *, CAST(ts + INTERVAL 3 HOUR AS DATE) AS eff FROM signals_v) s ASOF LEFT JOIN cal c ON s.eff <= c.date""",
    "rets": """SELECT p.date, p.ticker, p.adj_close, p.ret, p.abs_ret, p.trailing_vol_20, b.ret AS spy_ret, p.ret - b.ret AS ar
FROM (SELECT *, CASE WHEN count(abs_ret) OVER w >= 10 THEN avg(abs_ret) OVER w END AS trailing_vol_20
      FROM (SELECT *, abs(ret) AS abs_ret FROM (
        SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices_v))
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) p
LEFT JOIN (SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS ret FROM prices_v WHERE ticker = 'SPY') b USING (date)""",
    "aligned": """SELECT * FROM sig_t0 WHERE NOT is_broadcast AND ticker <> 'MARKET' AND source <> 'financial_phrasebank'
AND t0_idx <= (SELECT max(idx) FROM cal) - 2""",
    "td": """SELECT a.*, d.event_type AS dominant_event_type FROM (
  SELECT ticker, t0, min(t0_idx) AS t0_idx, max(impact_score) AS max_impact_score,
    sum(sentiment_score * attribution_weight) / sum(attribution_weight) AS mean_sentiment_score,
    count(*) AS signal_count, string_agg(DISTINCT source, ',' ORDER BY source) AS source_str,
    sum(sentiment_confidence * attribution_weight) / sum(attribution_weight) AS weighted_sentiment_confidence,
    bool_or(sentiment_confidence >= 0.8::DOUBLE) AS has_high_conf_sentiment
  FROM aligned GROUP BY ticker, t0) a
JOIN (SELECT ticker, t0, event_type, row_number() OVER (PARTITION BY ticker, t0 ORDER BY n DESC, m DESC, event_type) AS rn
      FROM (SELECT ticker, t0, event_type, count(*) AS n, max(impact_score) AS m FROM aligned GROUP BY ALL)) d
  ON a.ticker = d.ticker AND a.t0 = d.t0 AND d.rn = 1""",
    "ridx": "SELECT r.ticker, c.idx, r.ar, r.trailing_vol_20 FROM rets r JOIN cal c ON r.date = c.date",
    "obs": """SELECT *, abs(ar0) AS abs_ar0, ar0 + ar1 + ar2 AS car_0_2, abs(ar0 + ar1 + ar2) AS abs_car_0_2,
  CAST(date_trunc('week', t0) AS DATE) AS week,
  CASE WHEN mean_sentiment_score < -0.2::DOUBLE THEN 'Negative' WHEN mean_sentiment_score > 0.2::DOUBLE THEN 'Positive' ELSE 'Neutral' END AS sent_bucket
FROM (SELECT t.*, r0.ar AS ar0, r1.ar AS ar1, r2.ar AS ar2, r0.trailing_vol_20 FROM td t
  LEFT JOIN ridx r0 ON t.ticker = r0.ticker AND t.t0_idx = r0.idx
  LEFT JOIN ridx r1 ON t.ticker = r1.ticker AND t.t0_idx + 1 = r1.idx
  LEFT JOIN ridx r2 ON t.ticker = r2.ticker AND t.t0_idx + 2 = r2.idx)""",
}
_NEEDS = {
    "cal": ["prices_v"],
    "sig_t0": ["signals_v", "cal"],
    "rets": ["prices_v"],
    "aligned": ["sig_t0"],
    "td": ["aligned"],
    "ridx": ["rets", "cal"],
    "obs": ["td", "ridx"],
}


def define(name: str, sql: str, *needs: str) -> None:
    CTES[name] = sql
    _NEEDS[name] = list(needs)


def sql_with(names: str, body: str) -> str:
    """``WITH`` the named expressions and all they need."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        if name not in CTES:
            raise KeyError(name)
        if name not in wanted:
            wanted.add(name)
            for other in _NEEDS.get(name, []):
                need(other)

    for name in names.split():
        need(name)
    # materialized: each expression is evaluated once, so all uses see the same rounding
    parts = ",\n".join(
        f"{name} AS {'' if f'FROM {name} ' in sql else 'MATERIALIZED '}({sql})" for name, sql in CTES.items() if name in wanted
    )
    return f"WITH RECURSIVE {parts}\n{body}"
