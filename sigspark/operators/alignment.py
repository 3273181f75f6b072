"""Trading calendar, forward as-of alignment of timestamps, eligibility."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.functions.numeric import clip
from sigspark.session import local_table

# a calendar beyond this many days (270 years) is not broadcast
MAX_CALENDAR_DAYS = 100_000


def trading_calendar(prices: DataFrame, benchmark: str = fv.BENCHMARK) -> DataFrame:
    """(date, idx): distinct benchmark dates in order, or all dates without a benchmark.

    Distinct dates are bounded by the calendar, so numbering them in one task is cheap.
    """
    dates = prices.groupBy("date").agg(F.bool_or(F.col("ticker") == benchmark).alias("_bench"))
    order = Window.partitionBy(F.lit(1))
    chosen = dates.withColumn("_any", F.bool_or("_bench").over(order)).filter(F.col("_bench") | ~F.col("_any"))
    numbered = Window.partitionBy(F.lit(1)).orderBy("date")
    return chosen.select("date", (F.row_number().over(numbered) - 1).alias("idx"))


@dataclass(frozen=True)
class Calendar:
    """A trading calendar evaluated once.

    Within the day limit the dates are known here and every table built from them is safe to
    broadcast; beyond it ``dates`` is None and the joins stay unhinted.
    """

    spark: SparkSession
    dates: tuple[date, ...] | None
    frame: DataFrame

    @staticmethod
    def of(calendar: DataFrame, limit: int = MAX_CALENDAR_DAYS) -> Calendar:
        rows = calendar.limit(limit + 1).collect()
        if len(rows) > limit:
            return Calendar(calendar.sparkSession, None, calendar)
        dates = tuple(sorted(row["date"] for row in rows))
        frame = local_table(calendar.sparkSession, [(day, i) for i, day in enumerate(dates)], [("date", "date"), ("idx", "int")])
        return Calendar(calendar.sparkSession, dates, frame)

    @property
    def small(self) -> bool:
        return self.dates is not None

    @property
    def table(self) -> DataFrame:
        return F.broadcast(self.frame) if self.small else self.frame

    def bounds(self) -> tuple[date | None, int]:
        """(first date, last index)."""
        if self.dates is not None:
            return (self.dates[0] if self.dates else None), len(self.dates) - 1
        row = self.frame.agg(F.min("date").alias("first"), F.max("idx").alias("last")).collect()[0]
        return row["first"], row["last"]

    def sessions(self) -> DataFrame:
        """(day, t0, idx): every day between two sessions with the session it belongs to."""
        mapping = session_map(self.frame)
        return F.broadcast(mapping) if self.small else mapping


def effective_date(ts: Column, cutoff_hour: int = fv.CUTOFF_HOUR_UTC) -> Column:
    """UTC date, or the next one from the cutoff on."""
    return F.to_date(ts + F.make_interval(hours=F.lit(24 - cutoff_hour)))


def session_map(calendar: DataFrame) -> DataFrame:
    """Every calendar day from the first session's week before to the last session -> next session.

    (day, t0, idx); one row per day, bounded by the calendar span. Days before the first
    session are not listed: they all map to it.
    """
    previous = F.lag("date").over(Window.partitionBy(F.lit(1)).orderBy("date"))
    start = F.coalesce(F.date_add("_previous", 1), F.col("date"))
    return calendar.withColumn("_previous", previous).select(
        F.explode(F.sequence(start, F.col("date"))).alias("day"), F.col("date").alias("t0"), "idx"
    )


def align_to_sessions(df: DataFrame, calendar: Calendar, ts: str = "ts", cutoff_hour: int = fv.CUTOFF_HOUR_UTC) -> DataFrame:
    """Attach t0 (first session on or after the effective date) and its index; null past the end."""
    start, _ = calendar.bounds()
    day = effective_date(F.col(ts), cutoff_hour)
    lookup = F.greatest(day, F.lit(start)) if start is not None else day
    mapping = calendar.sessions()
    keyed = df.withColumn("_day", F.when(day.isNotNull(), lookup))
    return keyed.join(mapping, keyed["_day"] == mapping["day"], "left").drop("_day", "day").withColumnRenamed("idx", "t0_idx")


def with_sentiment_confidence(signals: DataFrame) -> DataFrame:
    """Recover sentiment confidence from the combined one where the column is absent."""
    if "sentiment_confidence" in signals.columns:
        return signals
    return signals.withColumn(
        "sentiment_confidence", clip(2 * F.col("confidence") - F.col("event_confidence"), 0.0, 1.0)
    )


def exclusion_flags(signals: DataFrame) -> dict[str, Column]:
    return {
        "broadcast": F.coalesce("is_broadcast", F.lit(False)),
        "market": F.col("ticker") == fv.MARKET,
        "labelled": F.coalesce(F.contains("source", F.lit(fv.LABELLED_SOURCE)), F.lit(False)),
    }


def align_signals(signals: DataFrame, calendar: Calendar, horizon: int = 2) -> DataFrame:
    """Stock signals with t0 and whether their forward window [t0, t0+2] is in the calendar."""
    flags = exclusion_flags(signals)
    stock = with_sentiment_confidence(signals).filter(~flags["broadcast"] & ~flags["market"] & ~flags["labelled"])
    _, last = calendar.bounds()
    aligned = align_to_sessions(stock, calendar)
    return aligned.withColumn("has_window", F.coalesce(F.col("t0_idx") <= last - horizon, F.lit(False)))


def eligible_signals(signals: DataFrame, calendar: Calendar) -> DataFrame:
    return align_signals(signals, calendar).filter("has_window").drop("has_window")


def drop_audit(signals: DataFrame, calendar: Calendar) -> DataFrame:
    """Exclusions and retained signals per source, in one pass over the signals."""
    flags = exclusion_flags(signals)
    _, last = calendar.bounds()
    aligned = align_to_sessions(signals, calendar)
    stock = ~flags["broadcast"] & ~flags["market"] & ~flags["labelled"]
    windowed = F.coalesce(F.col("t0_idx") <= last - 2, F.lit(False))
    return aligned.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(flags["broadcast"]).alias("broadcast_excluded"),
        F.count_if(flags["market"]).alias("market_excluded"),
        F.count_if(flags["labelled"]).alias("labelled_excluded"),
        F.count_if(stock).alias("evaluated"),
        F.count_if(stock & ~windowed).alias("dropped_missing_window"),
        F.count_if(stock & windowed).alias("retained"),
    )
