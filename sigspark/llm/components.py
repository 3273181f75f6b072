"""Connected components of a link table, by alternating stars.

Each round rewires links so that every node points to the smallest node it knows: a large-star step links a node's
larger neighbours to the smallest of its neighbourhood, a small-star step does so with its smaller ones. The number of
rounds grows with the logarithm of a component's diameter, and links never exceed their first number. A node that has
very many links is no hot spot: the smallest neighbour is a partly aggregated minimum, and the join that hands it out
is an ordinary equi-join, whose hot keys Spark splits; it sorts and merges, for broadcasting a small table would take
the driver's memory and a thread of it in each of many short rounds. Each round is written to the shared folder, so that a lost
executor costs one round. Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.session import persist_table


def star(links: DataFrame, smaller: bool) -> DataFrame:
    """One star step on (a, b) with a > b. ``smaller``: over the smaller neighbours only."""
    if smaller:
        around = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    else:
        around = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("x")).select("x.*")
    least = around.groupBy("node").agg(F.min("near").alias("least"))
    joined = around.join(least.hint("merge"), "node")
    if smaller:
        both = F.array(F.struct(F.col("near").alias("a"), F.col("least").alias("b")), F.struct(F.col("node").alias("a"), F.col("least").alias("b")))
        rewired = joined.select(F.explode(both).alias("x")).select("x.*").where("a > b")
    else:
        rewired = joined.where("near > node").select(F.col("near").alias("a"), F.least("least", "node").alias("b"))
    return rewired.distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) of any orderable type -> (node, root), where root is the component's smallest node; roots themselves have no row."""
    current = persist_table(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )
    measure = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = measure(current)
    while True:
        current = persist_table(star(star(current, smaller=False), smaller=True), "links")
        after = measure(current)
        if after == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
