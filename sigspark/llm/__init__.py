"""Operators for building training data: formatting, deduplication, decontamination, scoring, counting, sharding.

Each operator is one module with a general interface; ``queries`` holds the thin registered queries and their SQL.
Rows with null texts count as empty texts, rows repeated with equal id and text are treated alike, and columns that an
operator does not name are ignored, whatever they are called.
"""
