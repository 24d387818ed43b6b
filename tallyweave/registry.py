"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.plans import advantage_queries, batch_queries, batch_tools, loss_queries, more_queries, scoring_queries, tables  # noqa: F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return tables.QUERIES


def oracle_sql() -> dict[str, str]:
    return tables.SQL
