"""Fixtures of the odd tables."""

import pytest
from odd_tables import FIELDS, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), FIELDS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], FIELDS)
