"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, graph_sql, problems


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated ancestor reached again over the links: shortest paths, ranked."""
    return graph_queries.path_rank(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return graph_queries.QUERIES | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return graph_sql.ORACLE | problems.ORACLE
