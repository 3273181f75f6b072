"""Event study: all statistics of one set of ticker-day observations as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators import stats
from sigspark.operators.tickerday import group_means, market_study
from sigspark.sources.writers import long_metrics


def evaluate(
    days: DataFrame, era: str, n_boot: int = 1000, n_perm: int = 1000, seed: int = 42, dominant: str = "TSLA", market: DataFrame | None = None
) -> DataFrame:
    """(suite, key, metric, value) rows; fewer than five observations give only the count.

    ``days`` is used by every part, so pass a table (or a persisted result), not a long plan. ``market`` brings the market
    days (``market_days``), whose correlations with the benchmark are then part of the suite.
    """
    size = days.agg(F.count(F.lit(1)).alias("n_observations"))
    n = size.collect()[0]["n_observations"]
    parts = [long_metrics(size.withColumn("too_few", F.lit(int(n < 30))), f"{era}.size")]
    if n >= stats.MIN_OBSERVATIONS:
        for target in ("abs_ar0", "abs_car_0_2"):
            rho = stats.spearman(days, "max_impact_score", target)
            parts.append(long_metrics(stats.with_p_value(rho), f"{era}.spearman.{target}"))
            interval = stats.bootstrap_spearman(days, "max_impact_score", target, n_boot=n_boot, seed=seed)
            parts.append(long_metrics(interval, f"{era}.spearman_ci.{target}"))
        parts.append(long_metrics(stats.quintile_means(days), f"{era}.quintiles", ["bin"]))
        parts.append(long_metrics(stats.quintile_spread(days), f"{era}.quintile_spread"))
        parts.append(long_metrics(stats.bootstrap_quantile_spread(days, n_boot=n_boot, seed=seed), f"{era}.quintile_spread_ci"))
        confident = days.filter(F.round("weighted_sentiment_confidence", 9) >= 0.8)  # whatever the order of its sums
        for name, rows in (("sentiment", days), ("sentiment_confident", confident)):
            parts.append(long_metrics(group_means(rows, "sent_bucket", ["ar1", "car_0_2"]), f"{era}.{name}", ["sent_bucket"]))
            for column in ("ar1", "car_0_2"):
                interval = stats.bootstrap_mean_difference(
                    rows, column, F.col("sent_bucket") == "Positive", F.col("sent_bucket") == "Negative", n_boot=n_boot, seed=seed
                )
                parts.append(long_metrics(interval, f"{era}.{name}.long_short.{column}"))
        events = group_means(days, "dominant_event_type", ["abs_ar0", "ar0", "car_0_2"])
        parts.append(long_metrics(events, f"{era}.events", ["dominant_event_type"]))
        control = ("max_impact_score", "abs_ar0", "trailing_vol_20")
        parts.append(long_metrics(stats.with_p_value(stats.partial_spearman(days, *control), "partial_rho"), f"{era}.volatility_control"))
        others = days.filter(F.col("ticker") != dominant)
        parts.append(long_metrics(stats.with_p_value(stats.spearman(others, "max_impact_score", "abs_ar0")), f"{era}.without_dominant"))
        parts.append(long_metrics(stats.partial_spearman(others, *control), f"{era}.without_dominant_partial"))
        placebo = stats.permutation_test(days, "max_impact_score", "abs_ar0", n_perm=n_perm, seed=seed)
        parts.append(long_metrics(placebo, f"{era}.placebo"))
    if market is not None:
        parts.append(long_metrics(market_study(market), f"{era}.market", ["pair"]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
