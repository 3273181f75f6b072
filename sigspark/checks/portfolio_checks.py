"""Portfolio scores, weights, attribution and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.checks.registry import query, wrap
from sigspark.checks.study_checks import price_returns
from sigspark.checks.views import PARAMS, UNIVERSE, calendar, define, signals, sql_with
from sigspark.operators import portfolio as pf
from sigspark.plans import backtest
from sigspark.session import persist_table

BASE = [pf.scenario("baseline", PARAMS)]
ALPHA, LOW, HIGH, CAP = PARAMS.alpha, PARAMS.min_weight, PARAMS.max_weight, PARAMS.max_turnover
SIZE = len(UNIVERSE)


def number(value: float) -> str:
    return f"{value!r}::DOUBLE"


define("port", """SELECT *, CASE WHEN abs(sentiment_score) < 0.2::DOUBLE THEN 0 WHEN sentiment_score < 0 THEN sentiment_score * 1.25::DOUBLE
  ELSE sentiment_score END::DOUBLE AS adj_sentiment, greatest(0, attribution_weight * (impact_score / 10)) AS weight_w
FROM sig_t0 WHERE NOT is_broadcast AND ticker <> 'MARKET' AND source = 'twitter_kaggle' AND t0 IS NOT NULL""", "sig_t0")
define("raws", """SELECT t0, ticker, CASE WHEN sum(weight_w) > 0 THEN sum(adj_sentiment * weight_w) / sum(weight_w) ELSE 0 END AS raw_score
FROM port GROUP BY t0, ticker""", "port")
define("days", "SELECT t0, row_number() OVER (ORDER BY t0) AS n FROM (SELECT DISTINCT t0 FROM port)", "port")
define("dense", f"""SELECT d.t0, d.n, u.ticker, coalesce(r.raw_score, 0) AS raw_score
FROM days d CROSS JOIN (SELECT 'TK' || lpad(CAST(range AS VARCHAR), 2, '0') AS ticker FROM range({SIZE})) u
LEFT JOIN raws r ON r.t0 = d.t0 AND r.ticker = u.ticker""", "days", "raws")
define("ema", f"""SELECT i.t0, i.n, i.ticker, i.raw_score, sum({number(ALPHA)} * pow({number(1 - ALPHA)}, i.n - j.n) * j.raw_score) AS score
FROM dense i JOIN dense j ON i.ticker = j.ticker AND j.n <= i.n GROUP BY ALL""", "dense")
define("tilt", """SELECT *, exp(1.5::DOUBLE * score) / sum(exp(1.5::DOUBLE * score)) OVER (PARTITION BY t0) AS tilt_weight FROM ema""", "ema")


def define_path(name: str, source: str, *needs: str) -> None:
    """Targets and executed weights of ``source``: (scenario, n, t0, k, cap, scores, plain scores or null), tickers in order."""
    each = f"range(1, {SIZE + 1})"
    share = f"(abs(missing) - coalesce(list_sum(o[1:j - 1]), 0)) / ({SIZE} - j + 1)"
    define(f"{name}_tilts", f"""SELECT scenario, n, t0, cap, final, list_transform(e, lambda x: x / list_sum(e)) AS w FROM (
  SELECT *, list_transform(v, lambda x: exp(k * x)) AS e FROM (
    SELECT scenario, n, t0, k, cap, true AS final, s AS v FROM {source} UNION ALL SELECT scenario, n, t0, k, cap, false, plain FROM {source} WHERE plain IS NOT NULL))""", source)
    define(f"{name}_targets", f"""SELECT scenario, n, t0, cap, final, list_transform({each}, lambda i: c[i] + sign(missing) * least(room[i], amount)) AS t FROM (
  SELECT *, coalesce(list_filter(list_transform({each}, lambda j: CASE WHEN {share} <= o[j] THEN {share} END), lambda x: x IS NOT NULL)[1], o[{SIZE}]) AS amount
  FROM (SELECT *, list_sort(room) AS o FROM (
    SELECT *, list_transform(c, lambda x: CASE WHEN missing > 0 THEN {number(HIGH)} - x ELSE x - {number(LOW)} END) AS room FROM (
      SELECT *, 1 - list_sum(c) AS missing FROM (
        SELECT *, list_transform(w, lambda x: greatest({number(LOW)}, least({number(HIGH)}, x))) AS c FROM {name}_tilts)))))""", f"{name}_tilts")
    define(f"{name}_days", f"""SELECT a.scenario, a.n, a.t0, a.cap, a.t, b.t AS f FROM {name}_targets a
LEFT JOIN {name}_targets b ON b.scenario = a.scenario AND b.n = a.n AND NOT b.final WHERE a.final""", f"{name}_targets")
    distance = f"0.5::DOUBLE * list_sum(list_transform({each}, lambda i: abs({{0}}[i] - {{1}}[i])))"
    move = f"CASE WHEN {{2}} > cap THEN list_transform({each}, lambda i: {{1}}[i] + ({{0}}[i] - {{1}}[i]) * (cap / {{2}})) ELSE {{0}} END"
    define(f"{name}_path", f"""SELECT scenario, 0::BIGINT AS n, NULL::DATE AS t0, list_transform({each}, lambda i: {number(1 / SIZE)}) AS w,
  list_transform({each}, lambda i: {number(1 / SIZE)}) AS p, 0::DOUBLE AS turnover, 0::DOUBLE AS needed FROM {name}_days WHERE n = 1
UNION ALL
SELECT scenario, n, t0, list_transform(m, lambda x: x / list_sum(m)), p, least(needed, cap), needed FROM (
  SELECT *, {move.format('t', 'v', 'needed')} AS m FROM (SELECT *, {distance.format('t', 'v')} AS needed FROM (
    SELECT *, CASE WHEN f IS NULL THEN p ELSE list_transform(u, lambda x: x / list_sum(u)) END AS v FROM (
      SELECT *, CASE WHEN f IS NOT NULL THEN {move.format('f', 'p', 'before')} END AS u FROM (SELECT *, CASE WHEN f IS NOT NULL THEN {distance.format('f', 'p')} END AS before FROM (
        SELECT g.*, s.w AS p FROM (SELECT scenario, n, w FROM {name}_path ) s JOIN {name}_days g ON g.scenario = s.scenario AND g.n = s.n + 1))))))""", f"{name}_days")


def define_scenarios(name: str, scenarios: list[dict]) -> None:
    """Scores of each scenario by plain recursion over its days: smoothed, then modified, then carried."""
    null = lambda value: "NULL" if value is None else number(value)
    rows = ", ".join(
        f"('{x['scenario']}', {number(x['k'])}, {number(1 - 2.0 ** (-1.0 / x['half_life']))}, {number(x['deadband'])}, {number(x['neg_multiplier'])}, "
        f"{number(x['max_turnover'])}, {number(x['min_confidence'])}, {UNIVERSE.index(x['exclude']) + 1 if x['exclude'] else 'NULL::INT'}, {null(x['max_score'])}::DOUBLE)"
        for x in scenarios
    )
    define(f"{name}_sc", f"SELECT * FROM (VALUES {rows}) v(scenario, k, alpha, band, neg, cap, least_conf, excluded, most)")
    define(f"{name}_raw", f"""SELECT scenario, t0, ticker, CASE WHEN sum(weight_w) > 0 THEN sum(adj * weight_w) / sum(weight_w) ELSE 0 END AS raw FROM (
  SELECT c.scenario, p.t0, p.ticker, p.weight_w, CASE WHEN abs(sentiment_score) < band THEN 0 WHEN sentiment_score < 0 THEN sentiment_score * neg ELSE sentiment_score END::DOUBLE AS adj
  FROM port p CROSS JOIN {name}_sc c WHERE least_conf <= 0 OR event_confidence >= least_conf) GROUP BY ALL""", "port", f"{name}_sc")
    define(f"{name}_raws", f"""SELECT d.scenario, d.t0, d.n, list(coalesce(r.raw, 0) ORDER BY u.ticker) AS r FROM (
  SELECT scenario, t0, row_number() OVER (PARTITION BY scenario ORDER BY t0) AS n FROM (SELECT DISTINCT scenario, t0 FROM {name}_raw)) d
CROSS JOIN (SELECT 'TK' || lpad(CAST(range AS VARCHAR), 2, '0') AS ticker FROM range({SIZE})) u
LEFT JOIN {name}_raw r ON r.scenario = d.scenario AND r.t0 = d.t0 AND r.ticker = u.ticker GROUP BY ALL""", f"{name}_raw")
    each = f"range(1, {SIZE + 1})"
    define(f"{name}_state", f"""SELECT scenario, 0::BIGINT AS n, NULL::DATE AS t0, list_transform({each}, lambda i: 0::DOUBLE) AS s, list_transform({each}, lambda i: 0::DOUBLE) AS before FROM {name}_sc
UNION ALL
SELECT scenario, n, t0, list_transform({each}, lambda i: CASE WHEN i = excluded THEN 0 WHEN most IS NULL THEN before[i] ELSE least(most, before[i]) END), before FROM (
  SELECT r.scenario, r.n, r.t0, excluded, most, list_transform({each}, lambda i: (1 - alpha) * s[i] + alpha * r[i]) AS before
  FROM (SELECT * FROM {name}_state ) p JOIN {name}_raws r ON r.scenario = p.scenario AND r.n = p.n + 1 JOIN {name}_sc c ON c.scenario = p.scenario)""", f"{name}_raws", f"{name}_sc")
    define(f"{name}_scores", f"""SELECT t.scenario, n, t0, k, cap, s, CASE WHEN excluded IS NOT NULL OR most IS NOT NULL THEN before END AS plain
FROM {name}_state t JOIN {name}_sc c ON c.scenario = t.scenario WHERE n > 0""", f"{name}_state", f"{name}_sc")
    define_path(name, f"{name}_scores")


def define_returns(name: str) -> None:
    """Net daily returns of the executed weights."""
    define(f"{name}_returns", f"""SELECT scenario, return_date, sum(weight * ret) - 0.0005::DOUBLE * max(turnover) AS r FROM (
  SELECT w.*, coalesce(r.ret, 0) AS ret FROM (SELECT p.scenario, p.turnover, s.t0 AS return_date, 'TK' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS ticker, p.w[i] AS weight
    FROM {name}_path p JOIN {name}_days s ON s.scenario = p.scenario AND s.n = p.n + 1 CROSS JOIN range(1, {SIZE + 1}) x(i) WHERE p.n > 0) w
  LEFT JOIN rets r ON r.ticker = w.ticker AND r.date = w.return_date) GROUP BY scenario, return_date""", f"{name}_path", "rets")


define("base_scores", f"SELECT 'baseline' AS scenario, n, t0, 1.5::DOUBLE AS k, {number(CAP)} AS cap, list(score ORDER BY ticker) AS s, NULL::DOUBLE[] AS plain FROM ema GROUP BY n, t0", "ema")
define_path("base", "base_scores")
define("weights", f"""SELECT p.t0, p.n, x.ticker, p.w[k] AS weight, p.p[k] AS prev_weight, t.t[k] AS target_weight, p.turnover, p.needed,
  x.tilt_weight, x.score, x.raw_score
FROM base_path p JOIN base_days t USING (n) JOIN (SELECT *, CAST(right(ticker, 2) AS INT) + 1 AS k FROM tilt) x ON x.n = p.n WHERE p.n > 0""", "base_path", "tilt")
define_scenarios("variant", pf.variants(PARAMS))
define_returns("variant")
define_scenarios("cell", pf.grid(PARAMS))
define_returns("cell")
PERMUTATIONS = 200
define("shuffled_scores", f"""SELECT scenario, n, t0, k, cap, list(score ORDER BY ticker) AS s, NULL::DOUBLE[] AS plain FROM (
  SELECT 'perm-' || lpad(CAST(a.perm AS VARCHAR), 6, '0') AS scenario, a.n, a.t0, 1.5::DOUBLE AS k, {number(CAP)} AS cap, a.ticker, b.score
  FROM (SELECT perm, ticker, n, t0 FROM ema CROSS JOIN range({PERMUTATIONS + 1}) x(perm)) a
  JOIN (SELECT perm, ticker, score, CASE WHEN perm = 0 OR t0 = (SELECT max(t0) FROM ema) THEN n ELSE row_number() OVER (PARTITION BY perm, ticker, t0 = (SELECT max(t0) FROM ema)
      ORDER BY md5(concat_ws('|', 42, perm, ticker, t0)), t0) END AS n
    FROM ema CROSS JOIN range({PERMUTATIONS + 1}) x(perm)) b ON b.perm = a.perm AND b.ticker = a.ticker AND b.n = a.n) GROUP BY ALL""", "ema")
define_path("shuffled", "shuffled_scores")
define_returns("shuffled")
define("steps", "SELECT t0, n, lead(t0) OVER (ORDER BY t0) AS return_date FROM days", "days")
define("fwd", """SELECT w.*, s.return_date, coalesce(r.ret, 0) AS ret FROM weights w JOIN steps s ON s.n = w.n AND s.return_date IS NOT NULL
LEFT JOIN rets r ON r.ticker = w.ticker AND r.date = s.return_date""", "weights", "steps", "rets")
define("strat", """SELECT t0 AS rebalance_date, return_date, sum(weight * ret) AS strat_gross, max(turnover) AS turnover,
  sum(weight * ret) - 0.0005::DOUBLE * max(turnover) AS strat_5bps, sum(weight * ret) - 0.001::DOUBLE * max(turnover) AS strat_10bps
FROM fwd GROUP BY t0, return_date""", "fwd")
define("held", "SELECT return_date, ticker, ret FROM fwd", "fwd")
define("driving", """SELECT *, row_number() OVER (PARTITION BY t0, ticker ORDER BY abs(adj_sentiment * weight_w) DESC, impact_score DESC,
  ('0x' || substr(md5(CAST(text_id AS VARCHAR)), 1, 15))::BIGINT, text_id) AS rank FROM (
  SELECT *, CASE WHEN s > 0 THEN adj_sentiment * weight_w / s ELSE 0 END AS contribution, weight_w / s AS weight_share FROM (
    SELECT *, abs(sentiment_score) < 0.2::DOUBLE AS filtered_by_deadband, sum(weight_w) OVER (PARTITION BY t0, ticker) AS s FROM port))""", "port")


def prepared(spark, folder):
    return pf.portfolio_signals(signals(spark, folder), calendar(spark, folder), PARAMS)


def smoothed(spark, folder):
    return pf.ema_scores(pf.dense_scores(pf.daily_scores(prepared(spark, folder), BASE), UNIVERSE), BASE)


def stored_weights(spark, folder, scenarios=None):
    """Weights are read several times, so the path is computed once."""
    return persist_table(pf.simulate(prepared(spark, folder), scenarios or BASE, PARAMS), "weights")


def strategy(spark, folder):
    return pf.strategy_returns(pf.forward_weights(stored_weights(spark, folder), price_returns(spark, folder)))


@query("daily_raw_score", wrap(sql_with("dense", "SELECT t0, ticker, raw_score FROM dense"), "raw_score"))
def daily_raw_score(spark, folder):
    scores = pf.daily_scores(prepared(spark, folder), BASE)
    return pf.dense_scores(scores, UNIVERSE).select("t0", "ticker", "raw_score")


@query("ema_score", wrap(sql_with("ema", "SELECT t0, ticker, raw_score, score FROM ema"), "raw_score score"))
def ema_score(spark, folder):
    return smoothed(spark, folder).select("t0", "ticker", "raw_score", "score")


@query("tilt_weights", wrap(sql_with("tilt", "SELECT t0, ticker, tilt_weight FROM tilt"), "tilt_weight"))
def tilt_weights(spark, folder):
    return pf.tilt(smoothed(spark, folder)).select("t0", "ticker", "tilt_weight")


@query("bounded_target_weights", wrap(sql_with("weights", "SELECT t0, ticker, target_weight FROM weights"), "target_weight"))
def bounded_target_weights(spark, folder):
    return pf.target_weights(pf.tilt(smoothed(spark, folder)), PARAMS).select("t0", "ticker", "target_weight")


@query("capped_path", wrap(sql_with("weights", f"""
SELECT t0, ticker, weight, prev_weight, turnover, needed > {number(CAP)} AS turnover_capped FROM weights"""), "weight prev_weight turnover"))
def capped_path(spark, folder):
    return pf.simulate(prepared(spark, folder), BASE, PARAMS).select("t0", "ticker", "weight", "prev_weight", "turnover", "turnover_capped")


@query("driving_signals", wrap(sql_with("driving", """
SELECT t0, ticker, text_id, adj_sentiment, weight_w, contribution, weight_share, filtered_by_deadband FROM driving"""),
    "adj_sentiment weight_w contribution weight_share"))
def driving_signals(spark, folder):
    return pf.driving_signals(prepared(spark, folder), PARAMS).select(
        "t0", "ticker", "text_id", "adj_sentiment", "weight_w", "contribution", "weight_share", "filtered_by_deadband"
    )


@query("driving_signal_ranks", wrap(sql_with("driving", """
SELECT t0, ticker, rank, text_id, abs(contribution) AS size FROM driving"""), "size", "rank"))
def driving_signal_ranks(spark, folder):
    return pf.driving_signals(prepared(spark, folder), PARAMS).select("t0", "ticker", "rank", "text_id", F.abs("contribution").alias("size"))


@query("contribution_sums", wrap(sql_with("driving", "SELECT t0, ticker, sum(contribution) AS raw_score FROM driving GROUP BY ALL"), "raw_score"))
def contribution_sums(spark, folder):
    """Contributions of a ticker-day add up to its raw score."""
    driving = pf.driving_signals(prepared(spark, folder), PARAMS)
    return driving.groupBy("t0", "ticker").agg(F.sum("contribution").alias("raw_score"))


@query("top3_signals", wrap(sql_with("port", """
SELECT t0, ticker, rank, text_id, impact_score FROM (SELECT *, row_number() OVER (PARTITION BY t0, ticker
  ORDER BY impact_score DESC, abs(sentiment_score) DESC, text_id) AS rank FROM port) WHERE rank <= 3"""), "impact_score", "rank"))
def top3_signals(spark, folder):
    return pf.top_signals(prepared(spark, folder)).select("t0", "ticker", "rank", "text_id", "impact_score")


@query("high_impact_days", wrap(sql_with("driving", "SELECT t0, max(impact_score) AS impact_score FROM driving GROUP BY t0 ORDER BY 2 DESC, 1 LIMIT 10"), "impact_score"))
def high_impact_days(spark, folder):
    return pf.high_impact_days(pf.driving_signals(prepared(spark, folder), PARAMS)).select("t0", "impact_score")


@query("signal_explanation", wrap(sql_with("driving signals_v", """
SELECT s.text_id, s.ticker, d.t0 AS rebalance_date, d.rank, d.contribution, s.adj AS adj_sentiment, s.w AS weight_w, coalesce(d.s, s.w) AS sum_weights, coalesce(d.weight_share, 1) AS weight_share,
  CASE WHEN abs(s.sentiment_score) < 0.2::DOUBLE THEN 'Mild sentiment (' || printf('%+.2f', nudged) || ') is inside the deadband.'
  WHEN s.sentiment_score < 0 THEN 'Negative sentiment is weighted 1.25x.' ELSE 'Positive sentiment (' || printf('%+.2f', nudged) || ') is used as it is.' END AS explanation FROM (
    SELECT *, CASE WHEN abs(sentiment_score) < 0.2::DOUBLE THEN 0 WHEN sentiment_score < 0 THEN sentiment_score * 1.25::DOUBLE ELSE sentiment_score END::DOUBLE AS adj,
      greatest(0, attribution_weight * (impact_score / 10)) AS w,
      CASE WHEN round(abs(sentiment_score) * 1000) % 10 = 5 THEN sentiment_score + sign(sentiment_score) * 1e-9 ELSE sentiment_score END AS nudged FROM signals_v) s
LEFT JOIN driving d ON d.text_id = s.text_id AND d.ticker = s.ticker"""), "contribution adj_sentiment weight_w sum_weights weight_share", "rank"))
def signal_explanation(spark, folder):
    """All signals; half-way cents are nudged outward on both sides: the engines format ties differently."""
    everything = signals(spark, folder)
    rows = pf.explained_signals(everything, pf.driving_signals(prepared(spark, folder), PARAMS), PARAMS)
    tie = F.round(F.abs("sentiment_score") * 1000) % 10 == 5
    nudged = F.when(tie, F.col("sentiment_score") + F.signum("sentiment_score") * 1e-9).otherwise(F.col("sentiment_score"))
    return pf.explain_signals(rows.withColumn("sentiment_score", nudged), PARAMS).select(
        "text_id", "ticker", "rebalance_date", "rank", "contribution", "adj_sentiment", "weight_w", "sum_weights", "weight_share", "explanation"
    )


@query("forward_returns", wrap(sql_with("fwd", "SELECT t0, return_date, ticker, weight, ret FROM fwd"), "weight ret"))
def forward_returns(spark, folder):
    return pf.forward_weights(stored_weights(spark, folder), price_returns(spark, folder)).select("t0", "return_date", "ticker", "weight", "ret")


@query("strategy_returns", wrap(sql_with("strat", "SELECT * FROM strat"), "strat_gross turnover strat_5bps strat_10bps"))
def strategy_returns(spark, folder):
    return strategy(spark, folder).drop("scenario")


@query("equal_weight_returns", wrap(sql_with("held", f"""
SELECT *, ew_gross - 0.0005::DOUBLE * ew_turnover AS ew_5bps, ew_gross - 0.001::DOUBLE * ew_turnover AS ew_10bps FROM (
  SELECT return_date, m AS ew_gross, 0.5 * sum(abs({number(1 / SIZE)} - {number(1 / SIZE)} * (1 + ret) / (1 + m))) AS ew_turnover
  FROM (SELECT *, avg(ret) OVER (PARTITION BY return_date) AS m FROM held) GROUP BY return_date, m)"""), "ew_gross ew_turnover ew_5bps ew_10bps"))
def equal_weight_returns(spark, folder):
    forward = pf.forward_weights(stored_weights(spark, folder), price_returns(spark, folder))
    return pf.equal_weight_returns(forward.select("return_date", "ticker", "ret"), SIZE)


@query("buy_hold_returns", wrap(sql_with("held", """
SELECT return_date, sum(v) / sum(v / (1 + ret)) - 1 AS bh_ret FROM (
  SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY return_date) AS v FROM held) GROUP BY return_date"""), "bh_ret"))
def buy_hold_returns(spark, folder):
    forward = pf.forward_weights(stored_weights(spark, folder), price_returns(spark, folder))
    return pf.buy_and_hold_returns(forward.select("return_date", "ticker", "ret"))


@query("nav_curves", wrap(sql_with("strat", """
SELECT return_date, product(1 + strat_gross) OVER w AS nav_strat_gross, product(1 + strat_5bps) OVER w AS nav_strat_5bps,
  product(1 + strat_10bps) OVER w AS nav_strat_10bps FROM strat WINDOW w AS (ORDER BY return_date)"""),
    "nav_strat_gross nav_strat_5bps nav_strat_10bps"))
def nav_curves(spark, folder):
    curves = pf.nav_curve(strategy(spark, folder), ["strat_gross", "strat_5bps", "strat_10bps"], ["scenario"])
    return curves.select("return_date", "nav_strat_gross", "nav_strat_5bps", "nav_strat_10bps")


@query("nav_table", wrap(sql_with("strat held rets", f"""
SELECT *, product(1 + strat_gross) OVER w AS nav_strat_gross, product(1 + strat_5bps) OVER w AS nav_strat_5bps,
  product(1 + strat_10bps) OVER w AS nav_strat_10bps, product(1 + ew_5bps) OVER w AS nav_ew_5bps, product(1 + bh_ret) OVER w AS nav_bh_ret,
  product(1 + spy_ret) OVER w AS nav_spy_ret
FROM (SELECT s.*, e.ew_gross, e.ew_turnover, e.ew_gross - 0.0005::DOUBLE * e.ew_turnover AS ew_5bps,
    e.ew_gross - 0.001::DOUBLE * e.ew_turnover AS ew_10bps, b.bh_ret, coalesce(r.ret, 0) AS spy_ret
  FROM strat s JOIN (SELECT return_date, m AS ew_gross, 0.5 * sum(abs({number(1 / SIZE)} - {number(1 / SIZE)} * (1 + ret) / (1 + m))) AS ew_turnover
    FROM (SELECT *, avg(ret) OVER (PARTITION BY return_date) AS m FROM held) GROUP BY return_date, m) e USING (return_date)
  JOIN (SELECT return_date, sum(v) / sum(v / (1 + ret)) - 1 AS bh_ret FROM (
    SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY return_date) AS v FROM held) GROUP BY return_date) b USING (return_date)
  LEFT JOIN rets r ON r.ticker = 'SPY' AND r.date = s.return_date) WINDOW w AS (ORDER BY return_date)"""),
    "strat_gross turnover strat_5bps strat_10bps ew_gross ew_turnover ew_5bps ew_10bps bh_ret spy_ret nav_strat_gross nav_strat_5bps "
    "nav_strat_10bps nav_ew_5bps nav_bh_ret nav_spy_ret"))
def nav_table(spark, folder):
    return backtest.nav_table(stored_weights(spark, folder), price_returns(spark, folder), PARAMS)


def _performance_sql(source: str, key: str = "") -> str:
    part, lead = (f"PARTITION BY {key} ", f"{key}, ") if key else ("", "")
    group = f"GROUP BY {key}" if key else ""
    return f"""
SELECT {lead}n_days, cum_ret, ann_vol, max_dd, ann_ret, CASE WHEN ann_vol > 1e-8 THEN ann_ret / ann_vol ELSE 0 END AS sharpe FROM (
  SELECT *, pow(1 + cum_ret, 252.0::DOUBLE / n_days) - 1 AS ann_ret FROM (
    SELECT {lead}count(*) AS n_days, product(1 + r) - 1 AS cum_ret, stddev_samp(r) * sqrt(252) AS ann_vol, min(nav / peak - 1) AS max_dd
    FROM (SELECT *, max(nav) OVER ({part}ORDER BY return_date) AS peak FROM (
      SELECT *, product(1 + r) OVER ({part}ORDER BY return_date) AS nav FROM ({source}))) {group}))"""


METRICS = "cum_ret ann_vol max_dd ann_ret sharpe"


@query("performance_metrics", wrap(sql_with("strat", _performance_sql("SELECT return_date, strat_5bps AS r FROM strat")), METRICS, "n_days"))
def performance_metrics(spark, folder):
    return pf.performance(strategy(spark, folder), "strat_5bps", ["scenario"]).drop("scenario")


@query("split_period", wrap(sql_with("strat", _performance_sql("""
SELECT return_date, strat_5bps AS r, CASE WHEN row_number() OVER (ORDER BY return_date) <= count(*) OVER () // 2 THEN 'H1' ELSE 'H2' END AS half
FROM strat""", "half")), METRICS, "n_days"))
def split_period(spark, folder):
    return pf.performance(pf.split_halves(strategy(spark, folder), ["scenario"]), "strat_5bps", ["scenario", "half"]).drop("scenario")


@query("day_snapshots", wrap(sql_with("weights", f"""
SELECT t0, ticker, prev_weight, weight, target_weight, bps AS weight_change_bps,
  CASE WHEN bps > 10 THEN 'INCREASE' WHEN bps < -10 THEN 'REDUCE' ELSE 'HOLD' END AS action, o AS ticker_bounded,
  bool_or(o) OVER (PARTITION BY t0) AS day_bounded,
  0.5 * sum(abs(target_weight - prev_weight)) OVER (PARTITION BY t0) > {number(CAP)} + 1e-6 AS turnover_bound
FROM (SELECT *, round((weight - prev_weight) * 10000, 2) AS bps,
  tilt_weight < {number(LOW)} - 1e-6 OR tilt_weight > {number(HIGH)} + 1e-6 AS o FROM weights)"""), "prev_weight weight target_weight weight_change_bps"))
def day_snapshots(spark, folder):
    return pf.day_snapshots(stored_weights(spark, folder), PARAMS).select(
        "t0", "ticker", "prev_weight", "weight", "target_weight", "weight_change_bps", "action", "ticker_bounded", "day_bounded", "turnover_bound"
    )


@query("day_story", wrap(sql_with("weights port", """
SELECT m.t0, m.mover, m.mover_abs_bps, coalesce(c.n_signals, 0) AS n_signals, coalesce(c.n_active, 0) AS n_active FROM (
  SELECT t0, arg_max(ticker, {'a': b, 't': ticker}) AS mover, max(b) AS mover_abs_bps
  FROM (SELECT t0, ticker, abs(round((weight - prev_weight) * 10000, 2)) AS b FROM weights) GROUP BY t0) m
LEFT JOIN (SELECT t0, count(*) AS n_signals, count_if(abs(sentiment_score) >= 0.2::DOUBLE) AS n_active FROM (
  SELECT *, row_number() OVER (PARTITION BY t0, ticker ORDER BY impact_score DESC, abs(sentiment_score) DESC, text_id) AS rank FROM port)
  WHERE rank <= 3 GROUP BY t0) c ON c.t0 = m.t0"""), "mover_abs_bps", "n_signals n_active"))
def day_story(spark, folder):
    snapshots = pf.day_snapshots(stored_weights(spark, folder), PARAMS)
    return pf.day_story(snapshots, pf.top_signals(prepared(spark, folder)))


@query("weights_wide_long", wrap(sql_with("weights", "SELECT t0, ticker, weight FROM weights"), "weight"))
def weights_wide_long(spark, folder):
    wide = pf.widen_weights(pf.simulate(prepared(spark, folder), BASE, PARAMS), UNIVERSE)
    return pf.lengthen_weights(wide, UNIVERSE)


@query("scenario_variants", wrap(sql_with("variant_returns", _performance_sql("SELECT * FROM variant_returns", "scenario")), METRICS, "n_days"))
def scenario_variants(spark, folder):
    weights = stored_weights(spark, folder, pf.variants(PARAMS))
    return backtest.scenario_performance(weights, price_returns(spark, folder))


@query("scenario_grid", wrap(sql_with("cell_returns", _performance_sql("SELECT * FROM cell_returns", "scenario")), METRICS, "n_days"))
def scenario_grid(spark, folder):
    weights = stored_weights(spark, folder, pf.grid(PARAMS))
    return backtest.scenario_performance(weights, price_returns(spark, folder))


@query("placebo_sharpe", wrap(sql_with("shuffled_returns", f"""
SELECT any_value(o.sharpe) AS actual_sharpe, any_value(o.cum_ret) AS actual_cum_ret, avg(m.sharpe) AS null_sharpe_mean, stddev_pop(m.sharpe) AS null_sharpe_std,
  avg(m.cum_ret) AS null_cum_ret_mean, count(*) AS n_perm, 100.0 * count_if(m.sharpe <= o.sharpe) / count(*) AS sharpe_percentile,
  100.0 * count_if(m.cum_ret <= o.cum_ret) / count(*) AS cum_ret_percentile
FROM ({_performance_sql("SELECT * FROM shuffled_returns", "scenario")}) m
CROSS JOIN (SELECT * FROM ({_performance_sql("SELECT * FROM shuffled_returns", "scenario")}) WHERE scenario = 'perm-000000') o WHERE m.scenario <> 'perm-000000'"""),
    "actual_sharpe actual_cum_ret null_sharpe_mean null_sharpe_std null_cum_ret_mean sharpe_percentile cum_ret_percentile", "n_perm"))
def placebo_sharpe(spark, folder):
    return pf.placebo_test(prepared(spark, folder), price_returns(spark, folder), PARAMS, n_perm=PERMUTATIONS)
