"""All queries over the driver's tables, by the ids of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import further, more, relational, search, sources


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of the dense and the keyword channel, fused by reciprocal ranks."""
    return search.co05_hybrid(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.QUERIES | search.QUERIES | sources.QUERIES | more.QUERIES | further.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.SQL | search.SQL | sources.SQL | more.SQL | further.SQL
