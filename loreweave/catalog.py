"""The registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreweave.plans import catalog_graph, catalog_retrieval, catalog_tables, catalog_text
from loreweave.plans.registry import QUERIES, ORACLES

__all__ = ["catalog_graph", "catalog_retrieval", "catalog_tables", "catalog_text", "flagship", "oracle_sql", "queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
