"""The engine's queries over the tables of a data folder, each with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import functional, relational, structural

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = relational.QUERIES | functional.QUERIES | structural.QUERIES
ORACLE_SQL: dict[str, str] = relational.ORACLE_SQL | functional.ORACLE_SQL | structural.ORACLE_SQL
