"""Rankings and top-k that survive a group holding a third of all rows.

A plain window sends a whole group to one task. Here a group is first cut into ordered
pieces (or salted), each piece is ranked in its own task, and piece offsets make the
result exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.session import fits

SALTS = 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: Column | int, bound: int, salt_by: Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group, exactly, in two rounds.

    Each group is spread over salts and cut to ``bound`` rows per salt, so the second round
    sees at most ``SALTS * bound`` rows per group. ``k`` may vary per row but not exceed
    ``bound``; ``order`` must be total.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    survivors = salted.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= bound).drop("_first", "_salt")
    second = Window.partitionBy(*keys).orderBy(*order)
    limit = F.lit(k) if isinstance(k, int) else k
    return survivors.withColumn(rank, F.row_number().over(second)).filter(F.col(rank) <= limit)


def row_numbers(
    df: DataFrame, keys: list[str], sort: list[str], coarse: list[Column], tie: str, key: str, sizes: DataFrame,
    size: str = "n_rows", rank: str = "rank", limit: int | None = None,
) -> DataFrame:
    """Row number per group by ascending ``sort`` columns, then a hash of the row, then its key.

    ``sizes`` holds the rows per group. Groups that fit one task are ranked by a window. A
    larger group is cut: ``coarse`` columns (a bounded number of values, monotone in ``sort``)
    give ranges, distinct sort values are counted inside a range, and runs of equal sort
    values are cut by the leading bits of the hash. Each cut knows how many rows precede it.
    """
    limit = ONE_TASK_ROWS if limit is None else limit
    plain = Window.partitionBy(*keys).orderBy(*sort, tie, key)
    largest = sizes.agg(F.max(size).alias("n")).collect()[0]["n"] or 0
    if largest <= limit:
        return df.withColumn(rank, F.row_number().over(plain))
    sized = df.join(sizes.select(*keys, F.col(size).alias("_size")), keys)
    small = sized.filter(F.col("_size") <= limit).withColumn(rank, F.row_number().over(plain)).drop("_size")

    ranges = [f"_c{i}" for i in range(len(coarse))]
    cut = sized.filter(F.col("_size") > limit).drop("_size").withColumns(
        {**dict(zip(ranges, coarse)), "_bits": F.shiftright(tie, 59)}
    )
    pieces = cut.groupBy(*keys, *ranges, *sort, "_bits").agg(F.count(F.lit(1)).alias("_n"))
    before_range = Window.partitionBy(*keys).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*keys, *ranges).agg(F.sum("_n").alias("_n"))
    totals = totals.select(*keys, *ranges, F.coalesce(F.sum("_n").over(before_range), F.lit(0)).alias("_before"))
    before_piece = Window.partitionBy(*keys, *ranges).orderBy(*sort, "_bits").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.join(totals, [*keys, *ranges]).select(
        *keys, *sort, "_bits", (F.col("_before") + F.coalesce(F.sum("_n").over(before_piece), F.lit(0))).alias("_offset")
    )
    within = Window.partitionBy(*keys, *sort, "_bits").orderBy(tie, key)
    large = (
        cut.join(offsets, [*keys, *sort, "_bits"])
        .withColumn(rank, (F.col("_offset") + F.row_number().over(within)).cast("int"))
        .drop(*ranges, "_bits", "_offset")
    )
    return small.unionByName(large)


# up to this many rows a group is ranked in one task: an in-memory sort of a few columns
ONE_TASK_ROWS = 1_000_000


def split_points(df: DataFrame, columns: list[str], parts: int | None = None) -> dict[str, list[float]]:
    """About ``parts`` quantiles per column, from one pass: bounded lists used as literals.

    Tables that fit one task need no splitting; their size is checked first.
    """
    if fits(df, ONE_TASK_ROWS):
        return {}
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.approxQuantile(columns, [i / parts for i in range(1, parts)], 0.25 / parts)
    return {name: sorted(set(points)) for name, points in zip(columns, found)}


def windowed_ranks(df: DataFrame, columns: list[str], weight: str, groups: list[str]) -> DataFrame:
    """Average ranks by plain windows, for groups that fit one task (one shuffle for all columns)."""
    keys = groups or [F.lit(1)]
    up = {name: Window.partitionBy(*keys).orderBy(F.asc(name)).rangeBetween(Window.unboundedPreceding, 0) for name in columns}
    down = {name: Window.partitionBy(*keys).orderBy(F.desc(name)).rangeBetween(Window.unboundedPreceding, 0) for name in columns}
    total = df.withColumn("_n", F.sum(weight).over(Window.partitionBy(*keys)))
    # centred: how many lie at or below minus how many lie at or above, halved
    return total.withColumns(
        {f"_r_{name}": (F.sum(weight).over(up[name]) - F.sum(weight).over(down[name])) / 2.0 for name in columns}
    )


def piece_of(value: Column, points: list[float]) -> Column:
    """Index of the range a value falls in; equal values share a range."""
    if not points:
        return F.lit(0)
    bounds = F.array(*[F.lit(point) for point in points])
    return F.size(F.filter(bounds, lambda bound: bound < value))


def average_ranks(weighted: DataFrame, value: str, weight: str, groups: list[str], points: list[float], name: str) -> DataFrame:
    """Average rank of each distinct value per group; ``weight`` is the multiplicity of a row.

    Distinct values are counted first (map-side combine absorbs repeated values), then the
    running count is taken per range of values, so no task orders a whole group.
    """
    counts = (
        weighted.groupBy(*groups, value)
        .agg(F.sum(weight).alias("_n"))
        .withColumn("_piece", piece_of(F.col(value), points))
    )
    sizes = counts.groupBy(*groups, "_piece").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(offsets, [*groups, "_piece"])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + (F.col("_n") + 1) / 2.0)
        .select(*groups, value, name)
    )
