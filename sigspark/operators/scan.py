"""Running states of linear recurrences by an associative scan.

A step takes a state s to ``least(c, a * s + b)`` (no bound where c is null), with a >= 0. Two such steps make a third, so the
steps of a series can be combined block by block: a row combines the steps of its block up to itself, blocks are combined
in the same way one level higher, and what precedes a block is handed down to its rows. Work is linear in the length of a
series, and no task folds a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
#: The top level takes any number of blocks; its share of the work stays below that of the rows up to some 260,000 steps.
LEVELS = 2


def step(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))


def then(first: Column, second: Column) -> Column:
    """One step after another; ``least`` passes over a missing bound."""
    a, b = second["a"], second["b"]
    return step(a * first["a"], a * first["b"] + b, F.least(second["c"], a * first["c"] + b))


def combined(steps: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.aggregate(steps, step(F.lit(1.0), F.lit(0.0), none), then)


def running_steps(df: DataFrame, keys: list[str], position: str, steps: str, levels: int = LEVELS) -> DataFrame:
    """``df`` with ``_upto``: the steps of a series combined from its first row to this one. ``position`` counts from 0."""
    at = f"_block{levels}"
    staged = df.withColumn(at, F.floor(F.col(position) / BLOCK).cast("int") if levels > 1 else F.lit(0))
    block = Window.partitionBy(*keys, at).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumn("_upto", combined(F.collect_list(steps).over(block)))
    if levels <= 1:
        return staged.drop(at)
    whole = staged.groupBy(*keys, at).agg(F.max_by("_upto", position).alias("_steps"))
    before = running_steps(whole, keys, at, "_steps", levels - 1)
    before = before.select(*keys, (F.col(at) + 1).alias(at), F.col("_upto").alias("_before"))
    handed = staged.join(before, [*keys, at], "left")
    return handed.withColumn("_upto", F.when(F.col("_before").isNull(), F.col("_upto")).otherwise(then(F.col("_before"), F.col("_upto")))).drop(at, "_before")


def state_after(steps: Column, start: float = 0.0) -> Column:
    return F.least(steps["c"], steps["a"] * F.lit(start) + steps["b"])
