"""All queries, by importing the modules that register them."""

from sigspark.checks import ingest_checks, portfolio_checks, stream_checks, study_checks, table_checks, text_checks  # noqa: F401
from sigspark.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
