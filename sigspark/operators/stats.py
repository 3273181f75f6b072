"""Rank correlations, bootstrap, permutation tests and classification metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.numeric import total
from sigspark.operators.ranking import average_ranks, piece_of, split_points, windowed_ranks

MIN_OBSERVATIONS = 5


def _correlation(x: str, y: str, weight: Column) -> Column:
    """Weighted Pearson of two columns centred on their known mean; null without variance."""
    cov = F.sum(weight * F.col(x) * F.col(y))
    var = F.sum(weight * F.col(x) * F.col(x)) * F.sum(weight * F.col(y) * F.col(y))
    return F.when(var > 0, cov / F.sqrt(var))


def centred_ranks(
    df: DataFrame, columns: list[str], groups: list[str] | None = None, weight: str | None = None,
    points: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Rows reduced to distinct value tuples with multiplicity ``_w``, group size ``_n`` and
    centred average ranks ``_r_<column>``. Rows with a null in any column are left out.

    ``points`` split large groups into value ranges; they are found here unless given.
    """
    groups = groups or []
    complete = df.dropna(subset=[*columns, *groups])
    weights = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    if points is None:
        points = split_points(complete, columns)
    tuples = complete.groupBy(*groups, *columns).agg(F.sum(weights).alias("_w"))
    if not points:
        return windowed_ranks(tuples, columns, "_w", groups)
    ranked = tuples
    for name in columns:
        ranks = average_ranks(tuples, name, "_w", groups, points[name], f"_r_{name}")
        ranked = ranked.join(ranks, [*groups, name])
    if groups:
        ranked = ranked.join(tuples.groupBy(*groups).agg(F.sum("_w").alias("_n")), groups)
    else:
        size = tuples.agg(F.sum("_w").alias("n")).collect()[0]["n"]
        ranked = ranked.withColumn("_n", F.lit(size))
    return ranked.withColumns({f"_r_{name}": F.col(f"_r_{name}") - (F.col("_n") + 1) / 2.0 for name in columns})


def spearman(
    df: DataFrame, x: str, y: str, groups: list[str] | None = None, weight: str | None = None,
    points: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Spearman rho and n per group (pairs with a null are dropped)."""
    ranked = centred_ranks(df, [x, y], groups, weight, points)
    measures = [_correlation(f"_r_{x}", f"_r_{y}", F.col("_w")).alias("rho"), F.sum("_w").alias("n")]
    return ranked.groupBy(*groups).agg(*measures) if groups else ranked.agg(*measures)


def partial_spearman(df: DataFrame, x: str, y: str, z: str, groups: list[str] | None = None) -> DataFrame:
    """Spearman of x and y controlling for z; null under five complete rows."""
    ranked = centred_ranks(df, [x, y, z], groups)
    pairs = {"xy": (x, y), "xz": (x, z), "yz": (y, z)}
    measures = [_correlation(f"_r_{a}", f"_r_{b}", F.col("_w")).alias(name) for name, (a, b) in pairs.items()]
    measures.append(F.sum("_w").alias("n"))
    parts = ranked.groupBy(*groups).agg(*measures) if groups else ranked.agg(*measures)
    floor = F.greatest(F.lit(1e-12), (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))
    rho = F.when(F.col("n") >= MIN_OBSERVATIONS, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(floor))
    return parts.withColumn("partial_rho", rho)


def student_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation under n - 2 degrees of freedom; null under three pairs, 0 for a perfect correlation.

    For whole degrees of freedom the distribution is a finite series in 1 - rho^2, summed here by a fold over its terms.
    """
    freedom, square = n - 2, 1 - rho * rho
    odd = freedom % 2 == 1
    last = F.floor((freedom - 2) / 2).cast("int")

    def add(acc: Column, k: Column) -> Column:
        factor = F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        term = acc["term"] * square * factor
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), start, add, lambda acc: acc["total"])
    series = F.when(last >= 1, folded).otherwise(1.0)
    inside = F.when(odd, 2.0 / math.pi * (F.asin(F.abs(rho)) + F.when(freedom > 1, F.abs(rho) * F.sqrt(square) * series).otherwise(0.0)))
    share = inside.otherwise(F.abs(rho) * series)
    return F.when((n >= 3) & rho.isNotNull(), F.when(F.abs(rho) >= 1.0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - share)))


def with_p_value(correlations: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """A table of correlations with their p-values and a mark for fewer than 30 pairs."""
    return correlations.withColumns({"p_value": student_p_value(F.col(rho), F.col(n)), "few": (F.col(n) < 30).cast("int")})


# --------------------------------------------------------------------------- binning

BINS = 4096


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0) of a column without nulls, exact.

    Each pass counts the rows of every interval that holds a wanted rank in equal bins (a partly aggregated sum) and goes
    on with the bins that hold one, down to a single value: no task ever holds or sorts the column. A pass cuts an interval
    to a ``BINS``-th, so a few of them do, however many rows there are.
    """
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    held = {rank: (ends["lo"], ends["hi"], 0) for rank in ranks}  # interval and how many rows lie below it
    v = F.col(value).cast("double")
    while intervals := sorted({(lo, hi) for lo, hi, _ in held.values() if lo < hi}):
        inside = F.array(*[F.when((v >= lo) & (v <= hi), F.lit(n)) for n, (lo, hi) in enumerate(intervals)])
        rows = df.select(v.alias("_v"), F.explode(F.array_compact(inside)).alias("_i"))
        low, width = (F.get(F.array(*map(F.lit, ends)), F.col("_i")) for ends in ([lo for lo, _ in intervals], [hi - lo for lo, hi in intervals]))
        place = F.least(F.floor((F.col("_v") - low) / width * BINS), F.lit(BINS - 1))
        counts = rows.groupBy("_i", place.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        found: dict[tuple, list] = {}
        for r in counts.collect():  # at most BINS rows for each interval
            found.setdefault(intervals[r["_i"]], []).append(r)
        for rank, (lo, hi, below) in held.items():
            for r in sorted(found.get((lo, hi), []), key=lambda r: r["_b"]):
                if rank < below + r["n"]:
                    held[rank] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
    return {rank: lo for rank, (lo, _, _) in held.items()}


def quantile_edges(df: DataFrame, value: str, bins: int = 5) -> list[float]:
    """Inner edges with linear interpolation (exact)."""
    known = df.filter(F.col(value).isNotNull())
    n = known.count()
    if not n:
        return []
    places = [i * (n - 1) / bins for i in range(1, bins)]
    at = order_statistics(known, value, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}))
    return [at[math.floor(p)] if p == int(p) else (math.ceil(p) - p) * at[math.floor(p)] + (p - math.floor(p)) * at[math.ceil(p)] for p in places]


def bin_of(value: Column, edges: list[float]) -> Column:
    """1-based right-closed bin; coinciding edges leave bins empty."""
    if not edges:
        return F.lit(1)
    index = F.lit(1)
    for edge in edges:
        index = index + (value > edge).cast("int")
    return F.when(value.isNotNull(), index)


def quintiles(days: DataFrame, value: str = "max_impact_score", bins: int = 5) -> DataFrame:
    return days.withColumn("bin", bin_of(F.col(value), quantile_edges(days, value, bins)))


def quintile_means(days: DataFrame, value: str = "max_impact_score") -> DataFrame:
    return quintiles(days, value).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_impact"),
        F.avg("abs_ar0").alias("mean_abs_ar0"),
        F.avg("abs_car_0_2").alias("mean_abs_car"),
    )


def mean_difference(column: str, high: Column, low: Column) -> Column:
    return F.avg(F.when(high, F.col(column))) - F.avg(F.when(low, F.col(column)))


def long_short(days: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """Mean of positive minus mean of negative observations."""
    bucket = F.col("sent_bucket")
    measures = [
        mean_difference(name, bucket == "Positive", bucket == "Negative").alias(f"long_short_{name}") for name in columns
    ]
    return days.groupBy(*(groups or [])).agg(*measures)


def quintile_spread(days: DataFrame, column: str = "abs_ar0", value: str = "max_impact_score", bins: int = 5) -> DataFrame:
    binned = quintiles(days, value, bins)
    return binned.agg(mean_difference(column, F.col("bin") == bins, F.col("bin") == 1).alias("spread"))


# --------------------------------------------------------------------------- resampling

def block_draws(blocks: DataFrame, block: str, n_boot: int, seed: int, n_blocks: int) -> DataFrame:
    """(replicate, block, draws): how often each block is drawn in each replicate.

    Draws are the first 32 bits of the MD5 of "seed|replicate|slot", so they can be recomputed anywhere.
    Blocks are numbered in order; there are as many as calendar weeks, a bounded number.
    """
    numbered = blocks.select(block).distinct().select(
        block, (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(block)) - 1).alias("_b")
    )
    draws = (
        blocks.sparkSession.range(n_boot)
        .select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_slot"))
        .select("replicate", (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "replicate", "_slot")), 1, 8), 16, 10).cast("long") % n_blocks).cast("int").alias("_b"))
        .groupBy("replicate", "_b")
        .agg(F.count(F.lit(1)).alias("draws"))
    )
    return draws.join(numbered, "_b").select("replicate", block, "draws")


def _block_count(df: DataFrame, block: str) -> int:
    return df.agg(F.count_distinct(block).alias("n")).collect()[0]["n"]


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row results with different columns as one row, without a join."""
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def _interval(replicates: DataFrame, point: DataFrame, ci: float) -> DataFrame:
    tail = (1.0 - ci) / 2.0
    bounds = replicates.filter(F.col("value").isNotNull() & ~F.isnan("value")).agg(
        F.percentile("value", F.lit(tail)).alias("ci_low"),
        F.percentile("value", F.lit(1.0 - tail)).alias("ci_high"),
        F.count(F.lit(1)).alias("n_replicates"),
    )
    return side_by_side(point, bounds)


def bootstrap_mean_difference(
    days: DataFrame, column: str, high: Column, low: Column, block: str = "week", n_boot: int = 1000,
    seed: int = 42, ci: float = 0.95,
) -> DataFrame:
    """Block-bootstrap interval of a difference of means.

    Sums and counts are taken per block first, so replicates multiply blocks, not rows.
    """
    sides = {"hi": high, "lo": low}
    sums = days.groupBy(block).agg(
        *[F.sum(F.when(side, F.col(column))).alias(f"_s{name}") for name, side in sides.items()],
        *[F.count(F.when(side, F.col(column))).alias(f"_n{name}") for name, side in sides.items()],
    )

    def difference(weight: Column) -> Column:
        means = {
            name: F.sum(weight * F.coalesce(F.col(f"_s{name}"), F.lit(0.0))) / F.nullif(F.sum(weight * F.col(f"_n{name}")), F.lit(0))
            for name in sides
        }
        return means["hi"] - means["lo"]

    point = sums.agg(difference(F.lit(1)).alias("estimate"))
    n_blocks = _block_count(days, block)
    if n_blocks <= 2:
        return point.withColumns({"ci_low": F.col("estimate"), "ci_high": F.col("estimate"), "n_replicates": F.lit(0).cast("bigint")})
    replicates = (
        block_draws(sums, block, n_boot, seed, n_blocks).join(sums, block).groupBy("replicate").agg(difference(F.col("draws")).alias("value"))
    )
    return _interval(replicates, point, ci)


def bootstrap_spearman(
    days: DataFrame, x: str, y: str, block: str = "week", n_boot: int = 1000, seed: int = 42, ci: float = 0.95
) -> DataFrame:
    """Block-bootstrap interval of Spearman rho.

    A replicate is the same rows with draw counts as multiplicities, ranked anew per replicate;
    ranks are computed per (replicate, value range), never per whole replicate.
    """
    complete = days.dropna(subset=[x, y]).select(block, x, y)
    points = split_points(complete, [x, y])
    point = spearman(complete, x, y, points=points).select(F.col("rho").alias("estimate"))
    n_blocks = _block_count(complete, block)
    if n_blocks <= 2:
        return point.withColumns({"ci_low": F.col("estimate"), "ci_high": F.col("estimate"), "n_replicates": F.lit(0).cast("bigint")})
    drawn = complete.join(block_draws(complete, block, n_boot, seed, n_blocks), block)
    replicates = spearman(drawn, x, y, ["replicate"], "draws", points).select(F.col("rho").alias("value"))
    return _interval(replicates, point, ci)


def bootstrap_quantile_spread(
    days: DataFrame, column: str = "abs_ar0", value: str = "max_impact_score", bins: int = 5, block: str = "week", n_boot: int = 1000,
    seed: int = 42, ci: float = 0.95,
) -> DataFrame:
    """Block-bootstrap interval of the mean of ``column`` in the highest less that in the lowest quantile bin of ``value``.

    A replicate has quantile edges of its own: those of the rows with draw counts as multiplicities. Its distinct values
    are put in order once, with the draws that precede each (per value range, so no task orders a replicate of any size);
    an edge is read off where the wanted rank falls. A replicate whose edges coincide has no bins and no value.
    """
    complete = days.dropna(subset=[value]).select(block, F.col(value).cast("double").alias("_x"), F.col(column).alias("_y"))
    point = quintile_spread(days.dropna(subset=[value]), column, value, bins).select(F.col("spread").alias("estimate"))
    n_blocks = _block_count(complete, block)
    if n_blocks <= 2:
        return point.withColumns({"ci_low": F.col("estimate"), "ci_high": F.col("estimate"), "n_replicates": F.lit(0).cast("bigint")})
    points = split_points(complete, ["_x"]).get("_x", [])
    sums = complete.groupBy(block, "_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"), F.count("_y").alias("_c"))
    drawn = sums.join(block_draws(complete, block, n_boot, seed, n_blocks), block).groupBy("replicate", "_x").agg(
        *[F.sum(F.col(name) * F.col("draws")).alias(name) for name in ("_n", "_s", "_c")]
    ).withColumn("_piece", piece_of(F.col("_x"), points))
    pieces = drawn.groupBy("replicate", "_piece").agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy("replicate").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("replicate", "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"), F.sum("_size").over(Window.partitionBy("replicate")).alias("_all"))
    within = Window.partitionBy("replicate", "_piece").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.join(pieces, ["replicate", "_piece"]).withColumn("_before", F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    spot = [F.lit(float(i)) * (F.col("_all") - 1) / bins for i in range(bins + 1)]

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_x")))

    ends = [at(side(p)).alias(f"_{name}{i}") for i, p in enumerate(spot) for name, side in (("l", F.floor), ("h", F.ceil))]
    edges = placed.groupBy("replicate").agg(F.max("_all").alias("_all"), *ends)
    edge = lambda i: F.col(f"_l{i}") + (spot[i] - F.floor(spot[i])) * (F.col(f"_h{i}") - F.col(f"_l{i}"))
    edges = edges.select("replicate", *[edge(i).alias(f"_e{i}") for i in range(bins + 1)])
    apart = F.lit(True)
    for i in range(bins):
        apart = apart & (F.col(f"_e{i}") < F.col(f"_e{i + 1}"))
    edges = edges.filter(apart).select("replicate", F.col("_e1").alias("_first"), F.col(f"_e{bins - 1}").alias("_last"))
    low, high = F.col("_x") <= F.col("_first"), F.col("_x") > F.col("_last")
    mean = lambda side: F.sum(F.when(side, F.col("_s"))) / F.nullif(F.sum(F.when(side, F.col("_c"))), F.lit(0))
    replicates = drawn.join(edges, "replicate").groupBy("replicate").agg((mean(high) - mean(low)).alias("value"))
    return _interval(replicates, point, ci)


#: Replicates of a permutation test are taken in so many parts, each with a copy of the groups' ranks.
PARTS = 16


def permutation_test(
    days: DataFrame, x: str, y: str, group: str = "ticker", key: str = "t0", n_perm: int = 1000, seed: int = 42
) -> DataFrame:
    """Placebo for Spearman rho: y is shuffled within each group.

    Shuffling moves y between rows but not its overall ranks, so ranks are taken once. A group (one row a day, bounded by
    the calendar) is one array of rank pairs; a replicate puts the array's second ranks in the order of a seeded hash, and
    all it hands on is the group's sum of products. Rows are neither multiplied nor joined with themselves.
    """
    complete = days.dropna(subset=[x, y]).select(group, key, x, y)
    points = split_points(complete, [x, y])
    weighted = complete.withColumn("_w", F.lit(1).cast("bigint"))
    if points:
        ranked = complete
        for name in (x, y):
            ranked = ranked.join(average_ranks(weighted, name, "_w", [], points[name], f"_r_{name}"), name)
        middle = F.lit((complete.count() + 1) / 2)
        ranked = ranked.withColumns({f"_r_{name}": F.col(f"_r_{name}") - middle for name in (x, y)})
    else:
        ranked = windowed_ranks(weighted, [x, y], "_w", [])
    pair = F.struct(F.col(key).alias("key"), F.col(f"_r_{x}").alias("rx"), F.col(f"_r_{y}").alias("ry"))
    groups = ranked.groupBy(F.col(group).cast("string").alias("_g")).agg(F.array_sort(F.collect_list(pair)).alias("_h"))
    spread = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, n_perm + 1) - 1)))).repartition("_g", "_part")

    def products(replicate: Column) -> Column:
        def drawn(day: Column) -> Column:
            return F.when(replicate > 0, F.md5(F.concat_ws("|", F.lit(seed), replicate, "_g", day["key"].cast("string")))).otherwise("")  # 0 keeps the observed order

        mixed = F.array_sort(F.transform("_h", lambda day: F.struct(drawn(day).alias("draw"), day["key"].alias("key"), day["ry"].alias("ry"))))
        return total(F.zip_with("_h", mixed, lambda a, b: a["rx"] * b["ry"]))

    numbers = F.sequence(F.col("_part"), F.lit(n_perm), F.lit(min(PARTS, n_perm + 1)))
    dots = spread.select(F.inline(F.transform(numbers, lambda r: F.struct(r.alias("replicate"), products(r).alias("dot")))))
    scale = ranked.agg(F.sqrt(F.sum(F.col(f"_r_{x}") ** 2) * F.sum(F.col(f"_r_{y}") ** 2)).alias("scale")).first()["scale"]
    rho = dots.groupBy("replicate").agg((F.sum("dot") / F.nullif(F.lit(scale), F.lit(0.0))).alias("rho"))
    observed = F.max(F.when(F.col("replicate") == 0, F.col("rho")))
    null = F.when(F.col("replicate") > 0, F.col("rho"))
    summary = rho.agg(
        observed.alias("actual_rho"),
        F.avg(null).alias("null_mean"),
        F.percentile(null, F.lit(0.95)).alias("null_95"),
        F.count(null).alias("n_perm"),
        F.collect_list(null).alias("_null"),
    )
    beaten = F.size(F.filter("_null", lambda value: value >= F.col("actual_rho")))
    return summary.select("actual_rho", "null_mean", "null_95", "n_perm", ((beaten + 1) / (F.col("n_perm") + 1)).alias("p_value"))


# --------------------------------------------------------------------------- classification

def confusion(df: DataFrame, true: str, predicted: str, labels: list, groups: list[str] | None = None) -> DataFrame:
    """Counts for every (true, predicted) pair of the fixed labels, zeros kept."""
    groups = groups or []
    known = df.filter(F.col(true).isin(*labels) & F.col(predicted).isin(*labels))
    cells = [
        F.count_if((F.col(true) == t) & (F.col(predicted) == p)).alias(f"c_{i}_{j}")
        for i, t in enumerate(labels)
        for j, p in enumerate(labels)
    ]
    wide = known.groupBy(*groups).agg(*cells) if groups else known.agg(*cells)
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("label_true"), F.lit(p).alias("label_pred"), F.col(f"c_{i}_{j}").alias("n"))
            for i, t in enumerate(labels)
            for j, p in enumerate(labels)
        ]
    )
    return wide.select(*groups, F.explode(rows).alias("cell")).select(*groups, "cell.*")


def class_report(df: DataFrame, true: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label present (zero where undefined)."""
    groups = groups or []
    pairs = df.groupBy(*groups, F.col(true).alias("_t"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    sides = pairs.select(
        *groups,
        F.explode(
            F.array(
                F.struct(F.col("_t").alias("label"), F.col("_c").alias("t"), F.lit(0).cast("bigint").alias("p"),
                         F.when(F.col("_t") == F.col("_p"), F.col("_c")).otherwise(0).alias("tp")),
                F.struct(F.col("_p").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("_c").alias("p"),
                         F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("s"),
    )
    sums = sides.groupBy(*groups, "s.label").agg(
        F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.tp").alias("hits")
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(
        F.col("support") + F.col("predicted") > 0, 2.0 * F.col("hits") / (F.col("support") + F.col("predicted"))
    ).otherwise(0.0)
    return sums.select(*groups, "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits")


def summary_metrics(df: DataFrame, true: str, predicted: str, groups: list[str] | None = None, labels: list | None = None) -> DataFrame:
    """n, accuracy, macro-F1 and weighted F1.

    Macro-F1 averages over the labels present, or over all ``labels`` when they are fixed.
    """
    groups = groups or []
    report = class_report(df, true, predicted, groups)
    macro = F.avg("f1") if labels is None else F.sum("f1") / float(len(labels))
    measures = [
        F.sum("support").alias("n"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        macro.alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    ]
    return report.groupBy(*groups).agg(*measures) if groups else report.agg(*measures)


def label_correlation(df: DataFrame, label: str, score: str) -> DataFrame:
    """Pearson of a score against the ordinal label (-1, 0, 1)."""
    ordinal = F.when(F.col(label) == "negative", -1.0).when(F.col(label) == "neutral", 0.0).when(F.col(label) == "positive", 1.0)
    return df.agg(F.corr(ordinal, F.col(score)).alias("pearson"))
