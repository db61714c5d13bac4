"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pacemark.plans import (evaluation_queries, history_queries, model_queries,  # noqa: F401
                            pair_queries, quality_queries, source_queries, text_queries)
from pacemark.plans.registry import QUERIES, SQL
from pacemark.session import prepare


def _prepared(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The plan, after the session got the settings it depends on."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return plan(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(plan) for name, plan in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
