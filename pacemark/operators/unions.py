"""Unions that later steps may group or join by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def stacked(first: DataFrame, *others: DataFrame, allow_missing: bool = False) -> DataFrame:
    """All rows of all inputs, columns matched by name. The session must have been prepared (see ``session.prepare``)."""
    if first.sparkSession.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        raise ValueError("call pacemark.session.prepare(spark) once before using the operators")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), others, first)
