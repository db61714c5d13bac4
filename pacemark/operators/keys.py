"""Keyed union, deduplication, anti and semi joins, quotas.

Keep-first and keep-last need an explicit order; ``row_number() = 1`` lets Spark
drop all but one row per key before the shuffle, so a key with very many copies
does not travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.operators.unions import stacked


def _one_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return _one_per_key(df, key, [F.col(c).asc_nulls_first() for c in order])


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``."""
    return _one_per_key(df, key, [F.col(c).desc_nulls_last() for c in order])


def existing_wins(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Union of both sides, one row per key, rows already held win."""
    both = stacked(existing.withColumn("_source", F.lit(0)), new.withColumn("_source", F.lit(1)),
                   allow_missing=True)
    return keep_first(both, key, ["_source", *order]).drop("_source")


def newest_wins(cached: DataFrame, new: DataFrame, key: list[str],
                order: list[str] | None = None) -> DataFrame:
    """Union of both sides, one row per key, newly computed rows win."""
    both = stacked(cached.withColumn("_source", F.lit(0)), new.withColumn("_source", F.lit(1)),
                   allow_missing=True)
    return keep_last(both, key, ["_source", *(order or [])]).drop("_source")


def only_new(df: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has not been seen."""
    return df.join(seen.select(*key), key, "left_anti")


def only_listed(df: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """Rows on the allow-list; an empty list allows all.

    The test for an empty list is a scalar of one row, so it costs no join.
    """
    listed = df.join(allowed.select(*key).distinct().withColumn("_listed", F.lit(True)), key, "left")
    no_list = allowed.agg(F.count("*").alias("n")).scalar() == F.lit(0)
    return listed.where(F.col("_listed").isNotNull() | no_list).drop("_listed")


def key_union(*logs: DataFrame, key: list[str]) -> DataFrame:
    """All keys of several logs, each once."""
    return stacked(*[log.select(*key) for log in logs]).distinct()


def settled(log: DataFrame) -> DataFrame:
    """Keys that need no second look: kept or rejected, while failed ones are tried again."""
    return log.where(F.col("outcome").isin("kept", "rejected"))


def remaining_quota(repos: DataFrame, held: DataFrame, target: int = fv.TARGET_SAMPLE_SIZE) -> DataFrame:
    """Rows held per listed repo and how many may still be added."""
    counts = held.groupBy("repo").agg(F.count("*").alias("held"))
    return repos.join(counts, "repo", "left").select(
        "repo", F.coalesce("held", F.lit(0)).alias("held"),
        F.greatest(F.lit(target) - F.coalesce("held", F.lit(0)), F.lit(0)).alias("remaining"))


def fill_quota(candidates: DataFrame, quota: DataFrame, updated: str, tie_break: list[str],
               target: int = fv.TARGET_SAMPLE_SIZE) -> DataFrame:
    """Newest candidates of each repo up to what its quota leaves.

    No repo can take more than ``target`` rows, and that fixed bound is applied
    first: Spark then keeps at most ``target`` rows per repo and task before the
    shuffle, also for a repo that holds most of the data.
    """
    newest = Window.partitionBy("repo").orderBy(F.col(updated).desc(), *[F.col(c) for c in tie_break])
    bounded = (candidates.withColumn("_position", F.row_number().over(newest))
               .where(F.col("_position") <= target))
    return (bounded.join(quota.select("repo", "remaining"), "repo")
            .where(F.col("_position") <= F.col("remaining"))
            .drop("_position", "remaining"))
