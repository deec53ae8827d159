"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import chunk_queries, entity_queries, file_queries, graph_queries, layout_queries, service_queries, stream_queries, vector_queries  # noqa: F401 - modules register their queries
from docloom.plans.catalog import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["entity_counts_by_type"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
