"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null (unlike greatest/least alone)."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an intermediate value, so that an expression inside a fold is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)


def sigmoid(z: Column) -> Column:
    return F.when(z < -20, F.lit(0.0)).when(z > 20, F.lit(1.0)).otherwise(1.0 / (1.0 + F.exp(-z)))


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    """Small fixed table as a CASE expression: no join."""
    result = None
    for name, value in table.items():
        result = F.when(key == name, F.lit(float(value))) if result is None else result.when(key == name, F.lit(float(value)))
    return F.lit(float(default)) if result is None else result.otherwise(F.lit(float(default)))
