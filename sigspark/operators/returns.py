"""Daily returns, abnormal returns and trailing volatility without look-ahead.

A ticker has at most one row per trading day, so window partitions by ticker are bounded
by the calendar length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.operators.alignment import MAX_CALENDAR_DAYS
from sigspark.session import local_table

VOLATILITY_DAYS = 20
VOLATILITY_MIN_DAYS = 10


def simple_returns(prices: DataFrame, price: str = "adj_close") -> DataFrame:
    previous = F.lag(price).over(Window.partitionBy("ticker").orderBy("date"))
    return prices.withColumn("ret", F.when(previous != 0, F.col(price) / previous - 1.0))


def trailing_volatility(returns: DataFrame) -> DataFrame:
    """Mean |return| over the 20 rows before the current one; null under 10 observed."""
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(-VOLATILITY_DAYS, -1)
    observed = F.count("abs_ret").over(before)
    return returns.withColumn("abs_ret", F.abs("ret")).withColumn(
        "trailing_vol_20", F.when(observed >= VOLATILITY_MIN_DAYS, F.avg("abs_ret").over(before))
    )


def benchmark_returns(returns: DataFrame, benchmark: str = fv.BENCHMARK) -> tuple[DataFrame, bool]:
    """(date, spy_ret) of the benchmark, evaluated once; the flag says it is safe to broadcast."""
    series = returns.filter(F.col("ticker") == benchmark).select("date", F.col("ret").alias("spy_ret"))
    rows = series.limit(MAX_CALENDAR_DAYS + 1).collect()
    if len(rows) > MAX_CALENDAR_DAYS:
        return series, False
    return local_table(returns.sparkSession, [tuple(row) for row in rows], [("date", "date"), ("spy_ret", "double")]), True


def abnormal_returns(prices: DataFrame, benchmark: str = fv.BENCHMARK) -> DataFrame:
    """Prices + ret, abs_ret, trailing_vol_20, spy_ret, ar."""
    returns = trailing_volatility(simple_returns(prices))
    bench, small = benchmark_returns(simple_returns(prices.filter(F.col("ticker") == benchmark)), benchmark)
    joined = returns.join(F.broadcast(bench) if small else bench, "date", "left")
    return joined.withColumn("ar", F.col("ret") - F.col("spy_ret"))
