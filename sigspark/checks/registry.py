"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.session import bound_batches, use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(function(bound_batches(use_utc(spark)), folder))

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded (and -0.0 as 0.0), counts as bigint: comparable across engines."""
    columns = []
    for field in df.schema:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            column = F.round(column.cast("double"), DIGITS) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint", "long"):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def wrap(sql: str, doubles: str = "", ints: str = "") -> str:
    """Same rounding for the SQL side, by column name."""
    replaced = [f"round({name}, {DIGITS}) + 0.0 AS {name}" for name in doubles.split()]
    replaced += [f"CAST({name} AS BIGINT) AS {name}" for name in ints.split()]
    return f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({sql})" if replaced else sql
