"""Alignment, returns, ticker-days, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.checks.registry import query, wrap
from sigspark.checks.views import calendar, define, prices, signals, sql_with, table
from sigspark.operators import alignment, returns, stats, tickerday
from sigspark.operators.impact import daily_volume, trailing_volume, volume_signals
from sigspark.plans.study import evaluate
from sigspark.session import persist_table


def price_returns(spark: SparkSession, folder: str) -> DataFrame:
    return returns.abnormal_returns(prices(spark, folder))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return tickerday.observations(signals(spark, folder), price_returns(spark, folder), calendar(spark, folder))


def stored_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations used more than once are written to the shared folder first."""
    return persist_table(observations(spark, folder), "observations")


@query("ticker_day_sentiment", wrap(sql_with("td", """
SELECT ticker, t0, max_impact_score, mean_sentiment_score, signal_count, source_str, weighted_sentiment_confidence,
  has_high_conf_sentiment FROM td"""), "max_impact_score mean_sentiment_score weighted_sentiment_confidence", "signal_count"))
def ticker_day_sentiment(spark, folder):
    days = tickerday.ticker_days(alignment.eligible_signals(signals(spark, folder), calendar(spark, folder)))
    return days.select(
        "ticker", "t0", "max_impact_score", "mean_sentiment_score", "signal_count", "source_str",
        "weighted_sentiment_confidence", "has_high_conf_sentiment",
    )


@query("trading_calendar", wrap(sql_with("cal", "SELECT date, idx FROM cal"), "", "idx"))
def trading_calendar(spark, folder):
    return alignment.trading_calendar(prices(spark, folder))


@query("asof_alignment", wrap(sql_with("sig_t0", "SELECT text_id, t0, coalesce(t0_idx, -1) AS t0_idx FROM sig_t0"), "", "t0_idx"))
def asof_alignment(spark, folder):
    return alignment.align_to_sessions(signals(spark, folder), calendar(spark, folder)).select(
        "text_id", "t0", F.coalesce("t0_idx", F.lit(-1)).alias("t0_idx")
    )


@query("dominant_event", sql_with("td", "SELECT ticker, t0, dominant_event_type FROM td"))
def dominant_event(spark, folder):
    days = tickerday.ticker_days(alignment.eligible_signals(signals(spark, folder), calendar(spark, folder)))
    return days.select("ticker", "t0", "dominant_event_type")


@query("returns_abnormal", wrap(sql_with("rets", "SELECT date, ticker, ret, abs_ret, trailing_vol_20, spy_ret, ar FROM rets"),
                                "ret abs_ret trailing_vol_20 spy_ret ar"))
def returns_abnormal(spark, folder):
    return price_returns(spark, folder).select("date", "ticker", "ret", "abs_ret", "trailing_vol_20", "spy_ret", "ar")


@query("simple_returns", wrap(sql_with("rets", "SELECT date, ticker, ret FROM rets"), "ret"))
def simple_returns(spark, folder):
    return returns.simple_returns(prices(spark, folder)).select("date", "ticker", "ret")


@query("event_window_car", wrap(sql_with("obs", """
SELECT ticker, t0, ar0, ar1, ar2, abs_ar0, car_0_2, abs_car_0_2, trailing_vol_20, week, sent_bucket FROM obs"""),
                                "ar0 ar1 ar2 abs_ar0 car_0_2 abs_car_0_2 trailing_vol_20"))
def event_window_car(spark, folder):
    return observations(spark, folder).select(
        "ticker", "t0", "ar0", "ar1", "ar2", "abs_ar0", "car_0_2", "abs_car_0_2", "trailing_vol_20", "week", "sent_bucket"
    )


@query("signal_drop_audit", wrap(sql_with("sig_t0", """
SELECT source, count(*) AS total, count_if(is_broadcast) AS broadcast_excluded, count_if(ticker = 'MARKET') AS market_excluded,
  count_if(source = 'financial_phrasebank') AS labelled_excluded, count_if(stock) AS evaluated,
  count_if(stock AND NOT windowed) AS dropped_missing_window, count_if(stock AND windowed) AS retained
FROM (SELECT *, NOT is_broadcast AND ticker <> 'MARKET' AND source <> 'financial_phrasebank' AS stock,
  coalesce(t0_idx <= (SELECT max(idx) FROM cal) - 2, false) AS windowed FROM sig_t0) GROUP BY source"""),
    "", "total broadcast_excluded market_excluded labelled_excluded evaluated dropped_missing_window retained"))
def signal_drop_audit(spark, folder):
    return alignment.drop_audit(signals(spark, folder), calendar(spark, folder))


@query("sentiment_confidence_derived", wrap(sql_with("signals_v", """
SELECT text_id, greatest(0, least(1, 2 * (0.5 * sentiment_confidence + 0.5 * event_confidence) - event_confidence)) AS sentiment_confidence
FROM signals_v"""), "sentiment_confidence"))
def sentiment_confidence_derived(spark, folder):
    combined = signals(spark, folder).withColumn(
        "confidence", 0.5 * F.col("sentiment_confidence") + 0.5 * F.col("event_confidence")
    )
    return alignment.with_sentiment_confidence(combined.drop("sentiment_confidence")).select("text_id", "sentiment_confidence")


@query("impact_quintiles", wrap(sql_with("obs", """
SELECT bin, count(*) AS n, avg(max_impact_score) AS mean_impact, avg(abs_ar0) AS mean_abs_ar0, avg(abs_car_0_2) AS mean_abs_car
FROM (SELECT o.*, 1 + (max_impact_score > e[1])::INT + (max_impact_score > e[2])::INT + (max_impact_score > e[3])::INT
  + (max_impact_score > e[4])::INT AS bin
  FROM obs o, (SELECT quantile_cont(max_impact_score, [0.2, 0.4, 0.6, 0.8]) AS e FROM obs)) GROUP BY bin"""),
    "mean_impact mean_abs_ar0 mean_abs_car", "bin n"))
def impact_quintiles(spark, folder):
    return stats.quintile_means(stored_observations(spark, folder))


@query("quintile_spread", wrap(sql_with("obs", """
SELECT avg(abs_ar0) FILTER (max_impact_score > e[4]) - avg(abs_ar0) FILTER (max_impact_score <= e[1]) AS spread
FROM obs, (SELECT quantile_cont(max_impact_score, [0.2, 0.4, 0.6, 0.8]) AS e FROM obs)"""), "spread"))
def quintile_spread(spark, folder):
    return stats.quintile_spread(stored_observations(spark, folder))


@query("sentiment_buckets", wrap(sql_with("obs", """
SELECT sent_bucket, count(*) AS n, avg(ar1) AS mean_ar1, avg(car_0_2) AS mean_car_0_2, count(*) < 30 AS too_few
FROM obs GROUP BY sent_bucket"""), "mean_ar1 mean_car_0_2", "n"))
def sentiment_buckets(spark, folder):
    return tickerday.group_means(observations(spark, folder), "sent_bucket", ["ar1", "car_0_2"])


@query("event_breakdown", wrap(sql_with("obs", """
SELECT dominant_event_type, count(*) AS n, avg(abs_ar0) AS mean_abs_ar0, avg(ar0) AS mean_ar0, avg(car_0_2) AS mean_car_0_2,
  count(*) < 30 AS too_few FROM obs GROUP BY dominant_event_type"""), "mean_abs_ar0 mean_ar0 mean_car_0_2", "n"))
def event_breakdown(spark, folder):
    return tickerday.group_means(observations(spark, folder), "dominant_event_type", ["abs_ar0", "ar0", "car_0_2"])


LONG_SHORT = """avg(ar1) FILTER (sent_bucket = 'Positive') - avg(ar1) FILTER (sent_bucket = 'Negative') AS long_short_ar1,
  avg(car_0_2) FILTER (sent_bucket = 'Positive') - avg(car_0_2) FILTER (sent_bucket = 'Negative') AS long_short_car_0_2"""


@query("long_short_spread", wrap(sql_with("obs", f"SELECT {LONG_SHORT} FROM obs"), "long_short_ar1 long_short_car_0_2"))
def long_short_spread(spark, folder):
    return stats.long_short(observations(spark, folder), ["ar1", "car_0_2"])


@query("high_confidence_spread", wrap(sql_with("obs", f"SELECT {LONG_SHORT} FROM obs WHERE weighted_sentiment_confidence >= 0.8::DOUBLE"),
                                      "long_short_ar1 long_short_car_0_2"))
def high_confidence_spread(spark, folder):
    confident = observations(spark, folder).filter(F.col("weighted_sentiment_confidence") >= 0.8)
    return stats.long_short(confident, ["ar1", "car_0_2"])


@query("era_split", wrap(sql_with("obs", """
SELECT CASE WHEN t0 < DATE '2023-01-01' THEN 'early' WHEN t0 >= DATE '2026-01-01' THEN 'late' ELSE 'between' END AS era,
  count(*) AS n, avg(abs_ar0) AS mean_abs_ar0, count(*) < 30 AS too_few FROM obs GROUP BY 1"""), "mean_abs_ar0", "n"))
def era_split(spark, folder):
    return tickerday.group_means(tickerday.with_era(observations(spark, folder)), "era", ["abs_ar0"])


def _ranks(columns: str, where: str = "true") -> str:
    names = columns.split()
    complete = " AND ".join(f"{name} IS NOT NULL" for name in names)
    ranked = ", ".join(
        f"rank() OVER (ORDER BY {name}) + (count(*) OVER (PARTITION BY {name}) - 1) / 2.0::DOUBLE AS r_{name}" for name in names
    )
    return f"SELECT {ranked} FROM obs WHERE {complete} AND {where}"


@query("spearman_impact", wrap(sql_with("obs", f"SELECT corr(r_max_impact_score, r_abs_ar0) AS rho, count(*) AS n FROM ({_ranks('max_impact_score abs_ar0')})"), "rho", "n"))
def spearman_impact(spark, folder):
    return stats.spearman(stored_observations(spark, folder), "max_impact_score", "abs_ar0")


@query("spearman_impact_car", wrap(sql_with("obs", f"SELECT corr(r_max_impact_score, r_abs_car_0_2) AS rho, count(*) AS n FROM ({_ranks('max_impact_score abs_car_0_2')})"), "rho", "n"))
def spearman_impact_car(spark, folder):
    return stats.spearman(stored_observations(spark, folder), "max_impact_score", "abs_car_0_2")


def p_of(rows: str) -> str:
    """(key, rho, n) with two-sided p-values: the finite series of Student's distribution for whole degrees of freedom."""
    return f"""SELECT * FROM (WITH r AS (SELECT *, n - 2 AS nu, 1 - rho * rho AS c FROM ({rows})),
s AS (SELECT key, sum(term) AS more FROM (
  SELECT key, exp(sum(ln(c * CASE WHEN nu % 2 = 1 THEN 2.0::DOUBLE * k / (2 * k + 1) ELSE (2.0::DOUBLE * k - 1) / (2 * k) END)) OVER (PARTITION BY key ORDER BY k)) AS term
  FROM r JOIN (SELECT range AS k FROM range(1, 200000)) ON k <= (nu - 2) // 2) GROUP BY key)
SELECT r.key, rho, n, CASE WHEN nu % 2 = 1 THEN 1 - 2 / pi() * (asin(abs(rho)) + CASE WHEN nu > 1 THEN abs(rho) * sqrt(c) * (1 + coalesce(more, 0)) ELSE 0 END)
  ELSE 1 - abs(rho) * (1 + coalesce(more, 0)) END AS p_value, CASE WHEN n < 30 THEN 1 ELSE 0 END AS few
FROM r LEFT JOIN s ON r.key = s.key WHERE nu > 0)"""


def spearman_of(rows: str, x: str, y: str, key: str = "'all'") -> str:
    rank = lambda v: f"rank() OVER (PARTITION BY {key} ORDER BY {v}) + (count(*) OVER (PARTITION BY {key}, {v}) - 1) / 2.0::DOUBLE"
    return f"""SELECT key, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT {key} AS key, {rank(x)} AS rx, {rank(y)} AS ry
  FROM ({rows}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY key"""


P_VALUES = f"SELECT key AS sent_bucket, rho, n, p_value, few FROM ({p_of(spearman_of('SELECT * FROM obs', 'max_impact_score', 'abs_ar0', 'sent_bucket'))})"


@query("spearman_p_values", wrap(sql_with("obs", P_VALUES), "rho p_value", "n few"))
def spearman_p_values(spark, folder):
    """Correlation of impact and abnormal return per sentiment, with two-sided p-values."""
    return stats.with_p_value(stats.spearman(stored_observations(spark, folder), "max_impact_score", "abs_ar0", ["sent_bucket"])).where("n > 2")


@query("spearman_by_bucket", wrap(sql_with("obs", """
SELECT sent_bucket, corr(rx, ry) AS rho, count(*) AS n FROM (
  SELECT sent_bucket, rank() OVER (PARTITION BY sent_bucket ORDER BY signal_count)
      + (count(*) OVER (PARTITION BY sent_bucket, signal_count) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY sent_bucket ORDER BY abs_ar0) + (count(*) OVER (PARTITION BY sent_bucket, abs_ar0) - 1) / 2.0::DOUBLE AS ry
  FROM obs WHERE abs_ar0 IS NOT NULL) GROUP BY sent_bucket"""), "rho", "n"))
def spearman_by_bucket(spark, folder):
    return stats.spearman(stored_observations(spark, folder), "signal_count", "abs_ar0", ["sent_bucket"])


PARTIAL = """SELECT xy, xz, yz, n, (xy - xz * yz) / sqrt(greatest(1e-12, (1 - xz * xz) * (1 - yz * yz))) AS partial_rho FROM (
  SELECT corr(r_max_impact_score, r_abs_ar0) AS xy, corr(r_max_impact_score, r_trailing_vol_20) AS xz,
    corr(r_abs_ar0, r_trailing_vol_20) AS yz, count(*) AS n FROM ({ranks}))"""


@query("partial_spearman", wrap(sql_with("obs", PARTIAL.format(ranks=_ranks("max_impact_score abs_ar0 trailing_vol_20"))), "xy xz yz partial_rho", "n"))
def partial_spearman(spark, folder):
    return stats.partial_spearman(stored_observations(spark, folder), "max_impact_score", "abs_ar0", "trailing_vol_20").select(
        "xy", "xz", "yz", "n", "partial_rho"
    )


@query("leave_one_out", wrap(sql_with("obs", PARTIAL.format(ranks=_ranks("max_impact_score abs_ar0 trailing_vol_20", "ticker <> 'TK00'"))), "xy xz yz partial_rho", "n"))
def leave_one_out(spark, folder):
    others = stored_observations(spark, folder).filter(F.col("ticker") != "TK00")
    return stats.partial_spearman(others, "max_impact_score", "abs_ar0", "trailing_vol_20").select("xy", "xz", "yz", "n", "partial_rho")


define("market", """SELECT m.*, r.ret AS spy_ret, abs(r.ret) AS abs_spy_ret FROM (
  SELECT t0, max(impact_score) AS max_impact_score,
    sum(sentiment_score * attribution_weight) / sum(attribution_weight) AS mean_sentiment_score, count(*) AS signal_count
  FROM sig_t0 WHERE ticker = 'MARKET' AND t0 IS NOT NULL GROUP BY t0) m
JOIN rets r ON r.ticker = 'SPY' AND r.date = m.t0 AND r.ret IS NOT NULL""", "sig_t0", "rets")


@query("market_day", wrap(sql_with("market", "SELECT * FROM market"), "max_impact_score mean_sentiment_score spy_ret abs_spy_ret", "signal_count"))
def market_day(spark, folder):
    return tickerday.market_days(signals(spark, folder), price_returns(spark, folder), calendar(spark, folder))


MARKET_PAIRS = f"""SELECT 'impact_abs_return' AS key, rho, n FROM ({spearman_of('SELECT * FROM market', 'max_impact_score', 'abs_spy_ret')})
UNION ALL SELECT 'sentiment_return', rho, n FROM ({spearman_of('SELECT * FROM market', 'mean_sentiment_score', 'spy_ret')})"""


@query("market_study", wrap(sql_with("market", f"SELECT key AS pair, rho, n, p_value, few FROM ({p_of(MARKET_PAIRS)})"), "rho p_value", "n few"))
def market_study(spark, folder):
    """Impact against the size of the benchmark's return, sentiment against the return, with n, p and the few-days mark."""
    return tickerday.market_study(market_day(spark, folder))


DAILY = "SELECT ticker, CAST(ts AS DATE) AS date, count(*) AS volume FROM signals_v WHERE source = 'twitter_kaggle' GROUP BY ALL"


def tweet_volume(spark, folder):
    tweets = signals(spark, folder).filter(F.col("source") == "twitter_kaggle")
    return daily_volume(tweets, "ticker")


@query("daily_volume", wrap(sql_with("signals_v", DAILY), "", "volume"))
def daily_volume_query(spark, folder):
    return tweet_volume(spark, folder)


@query("volume_trailing30", wrap(sql_with("signals_v", f"""
SELECT ticker, date, volume, avg(volume) OVER w AS mean_volume, stddev_samp(volume) OVER w AS std_volume, count(volume) OVER w AS n_days
FROM ({DAILY}) WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""),
    "mean_volume std_volume", "volume n_days"))
def volume_trailing30(spark, folder):
    return trailing_volume(tweet_volume(spark, folder))


@query("volume_signal", wrap(sql_with("signals_v", f"""
SELECT ticker, date, CASE WHEN n < 7 THEN 0.5 WHEN s IS NULL OR s = 0 THEN CASE WHEN v > m THEN 1.0 WHEN v < m THEN 0.0 ELSE 0.5 END
  WHEN (v - m) / s < -20 THEN 0.0 WHEN (v - m) / s > 20 THEN 1.0 ELSE 1 / (1 + exp(-(v - m) / s)) END::DOUBLE AS volume_signal
FROM (
  SELECT q.ticker, q.date, coalesce(d.volume, 0) AS v, q.m, q.s, q.n FROM (
    SELECT ticker, CAST(date + to_days(k) AS DATE) AS date, avg(volume) AS m, stddev_samp(volume) AS s, count(*) AS n
    FROM ({DAILY}), (SELECT CAST(range AS INTEGER) AS k FROM range(1, 31)) GROUP BY 1, 2) q
  LEFT JOIN ({DAILY}) d ON q.ticker = d.ticker AND q.date = d.date)"""), "volume_signal"))
def volume_signal(spark, folder):
    return volume_signals(tweet_volume(spark, folder)).select("ticker", "date", "volume_signal")


N_BOOT, N_PERM = 1000, 1000
#: Blocks drawn with replacement, a row for each slot of each replicate.
def drawn_of(rows: str) -> str:
    """Blocks drawn with replacement, a row for each slot of each replicate."""
    return f"""SELECT replicate, week FROM (
  SELECT replicate, ('0x' || substr(md5(concat_ws('|', 42, replicate, slot)), 1, 8))::BIGINT % n AS b
  FROM range({N_BOOT}) r(replicate) CROSS JOIN (SELECT unnest(range(n)) AS slot, n FROM (SELECT count(DISTINCT week) AS n FROM ({rows})))) d
JOIN (SELECT week, row_number() OVER (ORDER BY week) - 1 AS b FROM (SELECT DISTINCT week FROM ({rows}))) w USING (b)"""


def interval_of(point: str, values: str) -> str:
    """``point`` gives v; ``values`` gives a v for each replicate."""
    return f"""SELECT (SELECT v FROM ({point})) AS estimate, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, count(v) AS n_replicates
FROM ({values}) WHERE v IS NOT NULL AND NOT isnan(v)"""


define("drawn", drawn_of("SELECT * FROM obs"), "obs")
define("replica", "SELECT d.replicate, o.max_impact_score AS x, o.abs_ar0 AS y, o.ar1, o.sent_bucket FROM drawn d JOIN obs o USING (week)", "drawn", "obs")


def spearman_ci_of(x: str, y: str) -> str:
    rows = f"SELECT * FROM obs WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    replicas = f"SELECT d.replicate, o.{x}, o.{y} FROM ({drawn_of(rows)}) d JOIN ({rows}) o USING (week)"
    return interval_of(f"SELECT rho AS v FROM ({spearman_of(rows, x, y)})", f"SELECT rho AS v FROM ({spearman_of(replicas, x, y, 'replicate')})")


INTERVAL = "estimate ci_low ci_high"


@query("bootstrap_spearman_ci", wrap(sql_with("obs", spearman_ci_of("max_impact_score", "abs_ar0")), INTERVAL, "n_replicates"))
def bootstrap_spearman_ci(spark, folder):
    return stats.bootstrap_spearman(stored_observations(spark, folder), "max_impact_score", "abs_ar0", n_boot=N_BOOT)


def long_short_ci_of(column: str, where: str = "true") -> str:
    rows = f"SELECT * FROM obs WHERE {where}"
    difference = f"avg({column}) FILTER (sent_bucket = 'Positive') - avg({column}) FILTER (sent_bucket = 'Negative') AS v"
    return interval_of(f"SELECT {difference} FROM ({rows})", f"SELECT {difference} FROM ({drawn_of(rows)}) d JOIN ({rows}) o USING (week) GROUP BY replicate")


@query("bootstrap_long_short_ci", wrap(sql_with("obs", long_short_ci_of("ar1")), INTERVAL, "n_replicates"))
def bootstrap_long_short_ci(spark, folder):
    return stats.bootstrap_mean_difference(
        stored_observations(spark, folder), "ar1", F.col("sent_bucket") == "Positive", F.col("sent_bucket") == "Negative", n_boot=N_BOOT
    )


def _spread(rows: str, key: str) -> str:
    edges = ", ".join(f"quantile_cont(x, {i / 5}) AS e{i}" for i in range(6))
    return f"""SELECT {key}, avg(y) FILTER (x > e4) - avg(y) FILTER (x <= e1) AS v FROM ({rows}) JOIN (SELECT {key}, {edges} FROM ({rows}) GROUP BY {key}) USING ({key})
WHERE e0 < e1 AND e1 < e2 AND e2 < e3 AND e3 < e4 AND e4 < e5 GROUP BY {key}"""


QUINTILE_CI = interval_of(
    f"SELECT v FROM ({_spread('SELECT 0 AS one, max_impact_score AS x, abs_ar0 AS y FROM obs', 'one')})", _spread("SELECT replicate, x, y FROM replica", "replicate")
)


@query("bootstrap_quintile_ci", wrap(sql_with("replica obs", QUINTILE_CI), INTERVAL, "n_replicates"))
def bootstrap_quintile_ci(spark, folder):
    return stats.bootstrap_quantile_spread(stored_observations(spark, folder), n_boot=N_BOOT)


define("pair_ranks", """SELECT ticker, t0, rank() OVER (ORDER BY max_impact_score) + (count(*) OVER (PARTITION BY max_impact_score) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (ORDER BY abs_ar0) + (count(*) OVER (PARTITION BY abs_ar0) - 1) / 2.0::DOUBLE AS ry FROM obs WHERE abs_ar0 IS NOT NULL""", "obs")
PLACEBO = f"""WITH placed AS (SELECT replicate, ticker, rx, ry, row_number() OVER (PARTITION BY replicate, ticker ORDER BY t0) AS i,
    row_number() OVER (PARTITION BY replicate, ticker ORDER BY CASE WHEN replicate > 0 THEN md5(concat_ws('|', 42, replicate, ticker, t0)) END, t0) AS j
  FROM pair_ranks CROSS JOIN range({N_PERM + 1}) r(replicate)),
rhos AS (SELECT a.replicate, corr(a.rx, b.ry) AS rho FROM placed a JOIN placed b ON b.replicate = a.replicate AND b.ticker = a.ticker AND b.j = a.i GROUP BY a.replicate)
SELECT any_value(o.rho) AS actual_rho, avg(n.rho) AS null_mean, quantile_cont(n.rho, 0.95) AS null_95, count(n.rho) AS n_perm,
  (count_if(n.rho >= o.rho) + 1) / (count(n.rho) + 1.0::DOUBLE) AS p_value
FROM rhos n CROSS JOIN (SELECT rho FROM rhos WHERE replicate = 0) o WHERE n.replicate > 0"""


@query("placebo_rho", wrap(sql_with("pair_ranks", f"SELECT * FROM ({PLACEBO})"), "actual_rho null_mean null_95 p_value", "n_perm"))
def placebo_rho(spark, folder):
    return stats.permutation_test(stored_observations(spark, folder), "max_impact_score", "abs_ar0", n_perm=N_PERM)


def _suite_sql() -> str:
    """Every part of the study as (suite, key, metric, value) rows, each from SQL of its own."""
    quintile = "SELECT quantile_cont(max_impact_score, [0.2, 0.4, 0.6, 0.8]) AS e FROM obs"
    confident = "round(weighted_sentiment_confidence, 9) >= 0.8::DOUBLE"
    control = "max_impact_score abs_ar0 trailing_vol_20"
    partial = lambda where: f"SELECT 'all' AS key, * FROM ({PARTIAL.format(ranks=_ranks(control, where))})"
    buckets = lambda where: f"SELECT sent_bucket AS key, count(*) AS n, avg(ar1) AS mean_ar1, avg(car_0_2) AS mean_car_0_2 FROM obs WHERE {where} GROUP BY 1"
    everything = lambda sql: f"SELECT 'all' AS key, * FROM ({sql})"
    correlation, interval = "rho n p_value few", f"{INTERVAL} n_replicates"
    parts = [("size", "SELECT 'all' AS key, count(*) AS n_observations, (count(*) < 30)::INT AS too_few FROM obs", "n_observations too_few")]
    for target in ("abs_ar0", "abs_car_0_2"):
        parts.append((f"spearman.{target}", p_of(spearman_of("SELECT * FROM obs", "max_impact_score", target)), correlation))
        parts.append((f"spearman_ci.{target}", everything(spearman_ci_of("max_impact_score", target)), interval))
    parts.append(("quintiles", f"""SELECT 1 + (max_impact_score > e[1])::INT + (max_impact_score > e[2])::INT + (max_impact_score > e[3])::INT + (max_impact_score > e[4])::INT AS key,
      count(*) AS n, avg(max_impact_score) AS mean_impact, avg(abs_ar0) AS mean_abs_ar0, avg(abs_car_0_2) AS mean_abs_car FROM obs, ({quintile}) GROUP BY 1""",
      "n mean_impact mean_abs_ar0 mean_abs_car"))
    parts.append(("quintile_spread", f"SELECT 'all' AS key, avg(abs_ar0) FILTER (max_impact_score > e[4]) - avg(abs_ar0) FILTER (max_impact_score <= e[1]) AS spread FROM obs, ({quintile})", "spread"))
    parts.append(("quintile_spread_ci", everything(QUINTILE_CI), interval))
    for name, where in (("sentiment", "true"), ("sentiment_confident", confident)):
        parts.append((name, buckets(where), "n mean_ar1 mean_car_0_2"))
        parts += [(f"{name}.long_short.{column}", everything(long_short_ci_of(column, where)), interval) for column in ("ar1", "car_0_2")]
    parts.append(("events", "SELECT dominant_event_type AS key, count(*) AS n, avg(abs_ar0) AS mean_abs_ar0, avg(ar0) AS mean_ar0, avg(car_0_2) AS mean_car_0_2 FROM obs GROUP BY 1",
      "n mean_abs_ar0 mean_ar0 mean_car_0_2"))
    parts.append(("volatility_control", f"SELECT a.*, p.p_value, p.few FROM ({partial('true')}) a JOIN ({p_of('SELECT key, partial_rho AS rho, n FROM (' + partial('true') + ')')}) p USING (key)",
      "xy xz yz n partial_rho p_value few"))
    others = "ticker <> 'TK00'"
    parts.append(("without_dominant", p_of(spearman_of(f"SELECT * FROM obs WHERE {others}", "max_impact_score", "abs_ar0")), correlation))
    parts.append(("without_dominant_partial", partial(others), "xy xz yz n partial_rho"))
    parts.append(("placebo", everything(PLACEBO), "actual_rho null_mean null_95 n_perm p_value"))
    parts.append(("market", p_of(MARKET_PAIRS), correlation))
    rows = [
        f"SELECT 'between.{suite}' AS suite, CAST(key AS VARCHAR) AS key, unnest({metrics.split()}) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in metrics.split())}]) AS value FROM ({sql})"
        for suite, sql, metrics in parts
    ]
    return " UNION ALL ".join(rows)


@query("evaluation_suite", wrap(sql_with("obs replica pair_ranks market", _suite_sql()), "value"))
def evaluation_suite(spark, folder):
    days = stored_observations(spark, folder)
    return evaluate(days, "between", n_boot=N_BOOT, n_perm=N_PERM, dominant="TK00", market=persist_table(market_day(spark, folder), "market-days"))


# -------------------------------------------------------------------- classification metrics

JUDGED = """SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS y_true,
  CASE WHEN d.n_chars > 1500 THEN 'good' ELSE 'bad' END AS y_pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def judged(spark, folder):
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    return labels.join(documents.select("doc_id", "source", "n_chars"), "doc_id").select(
        "doc_id", "source",
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("y_true"),
        F.when(F.col("n_chars") > 1500, "good").otherwise("bad").alias("y_pred"),
    )


def _report_sql(key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""
SELECT {k}label, CASE WHEN p > 0 THEN tp / p ELSE 0 END::DOUBLE AS "precision", CASE WHEN t > 0 THEN tp / t ELSE 0 END::DOUBLE AS recall,
  CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END::DOUBLE AS f1, t AS support, tp AS hits FROM (
  SELECT {k}label, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (
    SELECT {k}y_true AS label, 1 AS t, 0 AS p, (y_true = y_pred)::INT AS tp FROM judged
    UNION ALL SELECT {k}y_pred, 0, 1, 0 FROM judged) GROUP BY ALL)"""


@query("classification_report", wrap(f"WITH judged AS ({JUDGED}) {_report_sql()}", '"precision" recall f1', "support hits"))
def classification_report(spark, folder):
    return stats.class_report(judged(spark, folder), "y_true", "y_pred")


@query("confusion_matrix", wrap(f"""WITH judged AS ({JUDGED})
SELECT label_true, label_pred, count(j.doc_id) AS n
FROM (SELECT * FROM (VALUES ('good'), ('bad'), ('unsure')) a(label_true), (VALUES ('good'), ('bad'), ('unsure')) b(label_pred)) g
LEFT JOIN judged j ON j.y_true = label_true AND j.y_pred = label_pred GROUP BY ALL""", "", "n"))
def confusion_matrix(spark, folder):
    return stats.confusion(judged(spark, folder), "y_true", "y_pred", ["good", "bad", "unsure"])


@query("metrics_by_source", wrap(f"""WITH judged AS ({JUDGED}), report AS ({_report_sql('source')})
SELECT source, sum(support) AS n, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1
FROM report GROUP BY source""", "accuracy macro_f1 weighted_f1", "n"))
def metrics_by_source(spark, folder):
    return stats.summary_metrics(judged(spark, folder), "y_true", "y_pred", ["source"])


@query("label_correlation", wrap("""
SELECT corr(CASE WHEN quality = 0 AND toxic = 1 THEN -1.0 WHEN quality = 0 THEN 0.0 ELSE 1.0 END::DOUBLE, n_chars) AS pearson
FROM labels JOIN documents USING (doc_id)""", "pearson"))
def label_correlation(spark, folder):
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    label = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "negative").when(F.col("quality") == 0, "neutral").otherwise("positive")
    rows = labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(label.alias("label"), F.col("n_chars").cast("double").alias("score"))
    return stats.label_correlation(rows, "label", "score")
