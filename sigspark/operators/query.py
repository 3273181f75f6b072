"""Filtering, paging and summaries of a signal table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.operators.ranking import ONE_TASK_ROWS
from sigspark.session import persist_table

MAX_PAGE = 1000
ORDER = ("ts", "text_id", "ticker")


@dataclass(frozen=True)
class SignalFilter:
    """Conjunctive conditions; all are plain comparisons that reach the Parquet scan."""

    ticker: str | None = None
    since: str | datetime | date | None = None
    until: str | datetime | date | None = None
    min_impact: float | None = None
    max_impact: float | None = None
    event_type: str | None = None
    source: str | None = None

    def __post_init__(self) -> None:
        if self.min_impact is not None and self.max_impact is not None and self.min_impact > self.max_impact:
            raise ValueError("min_impact must not exceed max_impact")
        for name in ("since", "until"):
            value = getattr(self, name)
            if isinstance(value, str):
                try:
                    datetime.fromisoformat(value.replace("Z", "+00:00"))
                except ValueError as error:
                    raise ValueError(f"{name} is not an ISO date: {value!r}") from error

    def conditions(self) -> list[Column]:
        found = []
        if self.ticker:
            found.append(F.col("ticker") == self.ticker.strip().upper())
        if self.since is not None:
            found.append(F.col("ts") >= F.lit(self.since).cast("timestamp"))
        if self.until is not None:
            found.append(F.col("ts") <= F.lit(self.until).cast("timestamp"))
        if self.min_impact is not None:
            found.append(F.col("impact_score") >= float(self.min_impact))
        if self.max_impact is not None:
            found.append(F.col("impact_score") <= float(self.max_impact))
        if self.event_type:
            found.append(F.lower("event_type") == self.event_type.strip().lower())
        if self.source:
            found.append(F.lower("source") == self.source.strip().lower())
        return found


def select_signals(signals: DataFrame, where: SignalFilter | None = None) -> DataFrame:
    for condition in (where or SignalFilter()).conditions():
        signals = signals.filter(condition)
    return signals


def page(signals: DataFrame, where: SignalFilter | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in time order; ties are ordered by text id and ticker. A page has 1 to ``MAX_PAGE`` rows."""
    _check_size(limit)
    return ordered_slice(signals, where, limit, offset)


def ordered_slice(signals: DataFrame, where: SignalFilter | None, limit: int | None, offset: int) -> DataFrame:
    """Any number of rows in time order from any row on."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset must not be negative")
    rows = select_signals(signals, where).orderBy(*ORDER)
    if limit is None and offset == 0:
        return rows
    if limit is not None and offset + limit <= ONE_TASK_ROWS:
        return rows.offset(offset).limit(limit)
    position = F.col("_position")
    wanted = position >= offset if limit is None else (position >= offset) & (position < offset + limit)
    return numbered(rows).where(wanted).orderBy("_position").drop("_position")


def numbered(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted table with their place in it (``_position``, from 0): a place in a sorted piece and the rows before the piece.

    A plain offset would send all rows through one task. The pieces are written, so that a row keeps its place.
    """
    placed = persist_table(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    piece = F.shiftright("_at", 33)
    sizes = placed.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a piece: a running sum over as many rows as there are pieces
    before = sizes.selectExpr("_piece", "sum(_n) over (order by _piece rows unbounded preceding) - _n as _before")
    located = placed.withColumn("_piece", piece).join(F.broadcast(before), "_piece")
    within = F.col("_at") - F.shiftleft("_piece", 33)
    return located.withColumn("_position", F.col("_before") + within).drop("_piece", "_before", "_at")


def _check_size(size: int) -> None:
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows, not {size}")


def latest(signals: DataFrame, n: int = 10) -> DataFrame:
    _check_size(n)
    return signals.orderBy(F.desc("ts"), F.desc("text_id"), F.desc("ticker")).limit(n)


def by_text_id(signals: DataFrame, text_id) -> DataFrame:
    """The first signal of a text."""
    return signals.filter(F.col("text_id") == text_id).orderBy("ts", "text_id", "ticker").limit(1)


def sanitized(signals: DataFrame) -> DataFrame:
    """Output form: ISO timestamps, empty instead of missing triggers, false instead of missing flags."""
    values = {"ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")}
    if "matched_triggers" in signals.columns:
        values["matched_triggers"] = F.coalesce("matched_triggers", F.array().cast("array<string>"))
    for name in ("is_broadcast", "is_analyst_action"):
        if name in signals.columns:
            values[name] = F.coalesce(name, F.lit(False))
    return signals.withColumns(values)


def roster(signals: DataFrame, tickers: list[str], index_universe: list[str]) -> DataFrame:
    """Configured and observed tickers with counts (0 kept) and index / watch-only flags."""
    spark = signals.sparkSession
    configured = spark.createDataFrame([(t,) for t in tickers], "ticker string").withColumn("_configured", F.lit(True))
    counts = signals.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    joined = configured.join(counts, "ticker", "full")
    in_index = F.col("ticker").isin(*index_universe)
    return joined.select(
        "ticker",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        in_index.alias("is_index_universe"),
        (F.coalesce("_configured", F.lit(False)) & ~in_index).alias("is_watchlist"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


HISTOGRAM_LABELS = [f"{low}-{low + 1}" for low in range(1, 10)] + ["10+"]


def impact_histogram(signals: DataFrame) -> DataFrame:
    """Ten left-closed bins from 1; empty bins kept. One pass of conditional counts."""
    score = F.col("impact_score")
    counts = signals.agg(
        *[F.count_if((score >= low) & (score < low + 1)).alias(f"b{low}") for low in range(1, 11)]
    )
    bins = F.array(
        *[F.struct(F.lit(label).alias("bin"), F.col(f"b{i + 1}").alias("n")) for i, label in enumerate(HISTOGRAM_LABELS)]
    )
    return counts.select(F.explode(bins).alias("_b")).select("_b.*")


def coverage(signals: DataFrame) -> DataFrame:
    """Row count and time range."""
    return signals.agg(F.count(F.lit(1)).alias("n_signals"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def statistics(signals: DataFrame) -> DataFrame:
    """Long form (metric, key, value): totals, counts by event and source, impact histogram."""
    text = lambda name: F.lit(name)
    parts = [
        signals.agg(F.count(F.lit(1)).alias("value")).select(text("total").alias("metric"), text("all").alias("key"), "value")
    ]
    for column in ("event_type", "source"):
        counts = signals.groupBy(column).agg(F.count(F.lit(1)).alias("value"))
        parts.append(counts.select(text(f"by_{column}").alias("metric"), F.col(column).alias("key"), "value"))
    histogram = impact_histogram(signals)
    parts.append(histogram.select(text("impact_histogram").alias("metric"), F.col("bin").alias("key"), F.col("n").alias("value")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def replay(signals: DataFrame, start=None, ticker: str | None = None) -> DataFrame:
    """All matching signals in non-decreasing time order."""
    return select_signals(signals, SignalFilter(ticker=ticker, since=start)).orderBy("ts", "text_id", "ticker")


def between_dates(df: DataFrame, date_column: str, start=None, end=None, ticker: str | None = None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(date_column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date_column) <= F.lit(end).cast("date"))
    if ticker:
        df = df.filter(F.col("ticker") == ticker.strip().upper())
    return df


def crosstab(signals: DataFrame, rows: str = "source", columns: str = "event_type") -> DataFrame:
    """Counts with margins; margin keys read 'All'."""
    cube = signals.cube(rows, columns).agg(F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("_gr"), F.grouping(columns).alias("_gc"))
    label = lambda name, flag: F.when(F.col(flag) == 1, "All").otherwise(F.col(name)).alias(name)
    return cube.select(label(rows, "_gr"), label(columns, "_gc"), "n")


def strongest(signals: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    """Top or bottom rows by impact, then confidence."""
    direction = F.asc if ascending else F.desc
    return signals.orderBy(direction("impact_score"), direction("confidence"), "text_id", "ticker").limit(n)


def other_share(signals: DataFrame, key: str = "source") -> DataFrame:
    is_other = F.col("event_type") == fv.OTHER
    return signals.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_other).alias("other_count"),
        (100.0 * F.avg(is_other.cast("double"))).alias("other_pct"),
    )


def union_key_set(*frames: DataFrame, key: str = "ticker") -> DataFrame:
    result = frames[0].select(key)
    for frame in frames[1:]:
        result = result.union(frame.select(key))
    return result.distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
