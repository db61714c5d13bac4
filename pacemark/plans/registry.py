"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def register(plan):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded and integers widened, so that two engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
