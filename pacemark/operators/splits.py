"""Splits and samples decided by a hash of the key.

Membership depends on the row's key alone, so it does not change with the number
of partitions, the order of rows or a recomputed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions.parsing import item_key


def _digest(repo: Column, issue_number: Column, seed: int) -> Column:
    return F.md5(F.concat(item_key(repo, issue_number), F.lit(f"#{seed}")).cast("binary"))


def _hex_number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def holdout(repo: Column, issue_number: Column, seed: int = fv.SEED,
            test_percent: int = fv.TEST_PERCENT) -> Column:
    part = _hex_number(_digest(repo, issue_number, seed), 1) % 100
    return F.when(part < test_percent, F.lit("test")).otherwise(F.lit("train"))


def fold(repo: Column, issue_number: Column, seed: int = fv.SEED, folds: int = fv.FOLDS) -> Column:
    return _hex_number(_digest(repo, issue_number, seed), 9) % folds


def sample(df: DataFrame, n: int, seed: int = fv.SEED) -> DataFrame:
    """Exactly ``n`` rows (or all, when there are fewer), picked by hash order."""
    return (df.withColumn("_order", _digest(F.col("repo"), F.col("issue_number"), seed))
            .orderBy("_order", "repo", "issue_number").limit(n).drop("_order"))
