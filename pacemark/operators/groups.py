"""Results of the same groups side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Columns of both for each group, a group of missing values included.

    Without groups the right side has one row, and no join is needed.
    """
    if not by:
        other = right.select(F.struct(*right.columns)).scalar()
        return left.withColumn("_other", other).select(*left.columns, "_other.*")
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by])
    return left.join(renamed, same).drop(*[f"_right_{c}" for c in by])
