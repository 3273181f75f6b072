"""Backtest of the signal-driven portfolio, for any number of scenarios at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.config import PortfolioParams
from sigspark.operators import portfolio as pf
from sigspark.operators.alignment import Calendar


def rebalance_weights(signals: DataFrame, calendar: Calendar, scenarios: list[dict] | None = None,
                      params: PortfolioParams | None = None) -> DataFrame:
    params = params or PortfolioParams()
    scenarios = scenarios or [pf.scenario("baseline", params)]
    return pf.simulate(pf.portfolio_signals(signals, calendar, params), scenarios, params)


def held_returns(dates: DataFrame, returns: DataFrame, universe: tuple[str, ...]) -> DataFrame:
    """(return_date, ticker, ret) for every universe ticker; missing returns are 0."""
    slots = dates.select("return_date", F.explode(F.array(*[F.lit(t) for t in universe])).alias("ticker"))
    earned = returns.select(F.col("date").alias("return_date"), "ticker", "ret")
    return slots.join(earned, ["return_date", "ticker"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def nav_table(weights: DataFrame, returns: DataFrame, params: PortfolioParams | None = None) -> DataFrame:
    """One row per date of the baseline: daily returns, turnover and six cumulative curves."""
    params = params or PortfolioParams()
    base = weights.filter(F.col("scenario") == "baseline")
    strategy = pf.strategy_returns(pf.forward_weights(base, returns)).drop("scenario")
    held = held_returns(strategy.select("return_date"), returns, params.universe)
    equal = pf.equal_weight_returns(held, len(params.universe))
    hold = pf.buy_and_hold_returns(held)
    bench = returns.filter(F.col("ticker") == fv.BENCHMARK).select(F.col("date").alias("return_date"), F.col("ret").alias("spy_ret"))
    joined = strategy.join(equal, "return_date").join(hold, "return_date").join(bench, "return_date", "left")
    joined = joined.withColumn("spy_ret", F.coalesce("spy_ret", F.lit(0.0)))
    return pf.nav_curve(joined, ["strat_gross", "strat_5bps", "strat_10bps", "ew_5bps", "bh_ret", "spy_ret"])


def scenario_performance(weights: DataFrame, returns: DataFrame, ret: str = "strat_5bps") -> DataFrame:
    return pf.performance(pf.strategy_returns(pf.forward_weights(weights, returns)), ret, ["scenario"])
