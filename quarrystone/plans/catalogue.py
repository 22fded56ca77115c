"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.plans import history_queries, index_queries, maintenance_queries, model_queries, more_queries, retrieval_queries, text_queries  # noqa: F401  (they register)
from quarrystone.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
