"""Attach computed columns so that later filters do not copy their expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(stage: DataFrame, kept: list[str], outputs: dict[str, Column]) -> DataFrame:
    """``kept`` columns of ``stage`` plus ``outputs``, which replace columns of the same name.

    The outputs are generated as one struct per row. A filter on one of them is evaluated on
    the finished value; pushed below a plain projection it would repeat the whole chain of
    pattern matches, several times over. Filters on the kept columns still reach the scan.
    """
    names = {name: f"_out_{name}" for name in outputs}
    struct = F.struct(*[column.alias(names[name]) for name, column in outputs.items()])
    carried = [name for name in kept if name not in outputs]
    generated = stage.select(*carried, F.inline(F.array(struct)))
    order = [*kept, *[name for name in outputs if name not in kept]]
    return generated.select(*[F.col(names[name]).alias(name) if name in outputs else F.col(name) for name in order])
