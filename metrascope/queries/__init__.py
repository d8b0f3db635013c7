"""Registry of queries over the driver's tables, and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import authorship, corpus, ledgers, rates, reviews, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (authorship, rates, corpus, ledgers, reviews, runs):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
