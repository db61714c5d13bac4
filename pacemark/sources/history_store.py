"""Churn of files kept as sums per file and day, so that a delivery of commits adds only its own days.

A store is a folder of two tables, both laid out by span of ``SPAN_DAYS`` days and by delivery:
``commits`` holds the delivered rows, each ``(repo, commit_id, path)`` once, and ``sums`` their sums per
repo, path and day. A delivery reads the spans it falls in and writes its own folders in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.operators import keys
from pacemark.operators.unions import stacked
from pacemark.session import written
from pacemark.sources.readers import path_exists
from pacemark.sources.sinks import gathered

#: Days in a folder; as fixed as the store, since it names its folders.
SPAN_DAYS = 28
ROW = ["repo", "commit_id", "path"]


def day_of(at: Column) -> Column:
    """Days since 1970, by UTC."""
    return F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int")


def _replace(df: DataFrame, path: str) -> None:
    (gathered(df, ["span"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("span", "delivery").parquet(path))


def _daily(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", "path", "day", "span", "delivery").agg(
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count("*").alias("commits"),
        F.min("committed_at").alias("first_seen"), F.max("committed_at").alias("last_modified"))


def add_delivery(store: str, number: int, commit_files: DataFrame) -> None:
    """Add the commits of one delivery; days of any age may come late.

    Rows that an earlier delivery brought are left out, and of repeated rows the smallest by time, added
    and deleted lines is kept; the time of a commit does not change between deliveries. Rows without a time
    are left out, since no bound lets them in. A delivery that is run again after a failure replaces what it wrote:
    its rows first, then the sums of its rows as they are stored. One without rows writes nothing.
    """
    spark = commit_files.sparkSession
    day = day_of(F.col("committed_at"))
    dated = commit_files.where(F.col("committed_at").isNotNull()).select(
        *ROW, "committed_at", "added", "deleted", day.alias("day"),
        F.floor(day / F.lit(SPAN_DAYS)).cast("int").alias("span"), F.lit(number).alias("delivery"))
    fresh = written(keys.keep_first(dated, ROW, ["committed_at", "added", "deleted"]), "delivered")
    # one number for each span of days that the delivery falls in
    touched = [r["span"] for r in fresh.select("span").distinct().collect()]
    if not touched:
        return
    stored = fresh.schema
    commits, mine = f"{store}/commits", F.col("span").isin(touched) & (F.col("delivery") == number)
    if path_exists(spark, commits):
        held = spark.read.parquet(commits).where(F.col("span").isin(touched) & (F.col("delivery") < number))
        # rows without a repo, commit or path are known again as well
        same = [fresh[c].eqNullSafe(held[c]) for c in ("span", *ROW)]
        fresh = fresh.join(held, same, "left_anti")
    _replace(fresh, commits)
    _replace(_daily(spark.read.schema(stored).parquet(commits).where(mine)), f"{store}/sums")


def file_history_since(spark: SparkSession, store: str, bounds: DataFrame) -> DataFrame:
    """What ``history.file_history`` says of the stored commits from ``_since`` of their repo on.

    ``bounds`` has one ``_since`` per ``repo``. Whole days come from the sums; commits are read only
    for the day on which a repo's bound falls. Earlier spans of both tables are not read.
    """
    bounds = bounds.where(F.col("_since").isNotNull()).select("repo", "_since", day_of(F.col("_since")).alias("_day"))
    earliest = F.floor(bounds.agg(F.min("_day")).scalar() / F.lit(SPAN_DAYS)).cast("int")
    sums = spark.read.parquet(f"{store}/sums").where(F.col("span") >= earliest)
    later = sums.join(bounds, "repo").where(F.col("day") > F.col("_day"))
    commits = spark.read.parquet(f"{store}/commits").where(F.col("span") >= earliest)
    spans = bounds.withColumn("span", F.floor(F.col("_day") / F.lit(SPAN_DAYS)).cast("int"))
    first_day = commits.join(spans, ["repo", "span"]).where(
        (F.col("day") == F.col("_day")) & (F.col("committed_at") >= F.col("_since")))
    parts = ["repo", "path", "added", "deleted", "commits", "first_seen", "last_modified"]
    return (stacked(later.select(*parts), _daily(first_day).select(*parts)).groupBy("repo", "path").agg(
        *[F.sum(c).alias(c) for c in ("added", "deleted", "commits")],
        F.min("first_seen").alias("first_seen"), F.max("last_modified").alias("last_modified")))


def bounds_of(pairs: DataFrame, lookback_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """``_since`` of each repo: its first pair less the lookback."""
    return pairs.groupBy("repo").agg(
        (F.min("issue_created_at") - F.make_dt_interval(F.lit(lookback_days))).alias("_since"))
