"""Tables of the data quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations, text
from pacemark.operators import quantiles
from pacemark.sources.schemas import KEY


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def missing_report(pairs: DataFrame, flag_percent: float = 10.0) -> DataFrame:
    """Missing values and type per column in one pass; for texts null or '' counts as missing."""
    kinds = dict(pairs.dtypes)
    counts = [F.count_if(_empty(c) if kinds[c] == "string" else F.col(c).isNull()).alias(c)
              for c in pairs.columns]
    one_row = pairs.agg(F.count("*").alias("_total"), *counts)
    share = F.col("missing") / F.nullif(F.col("total"), F.lit(0)) * 100
    types = F.create_map(*[F.lit(x) for pair in pairs.dtypes for x in pair])
    return (one_row.withColumnRenamed("_total", "total")
            .unpivot(["total"], pairs.columns, "column_name", "missing")
            .select("column_name", "total", "missing", share.alias("missing_percent"),
                    (share > flag_percent).alias("flagged"),
                    F.element_at(types, F.col("column_name")).alias("data_type")))


def text_statistics(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Length in characters and words of each text column; null counts as ''."""
    measured = pairs.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"),
        text.text_length(F.coalesce(c, F.lit(""))).alias("chars"),
        text.word_count(F.coalesce(c, F.lit(""))).alias("words")) for c in columns])))
    plain = measured.groupBy("column_name").agg(
        F.count_if(F.col("chars") > 0).alias("non_empty"),
        (F.count_if(F.col("chars") > 0) / F.count("*") * 100).alias("non_empty_percent"),
        *[f(c).alias(f"{n}_{c}") for c in ("chars", "words")
          for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])
    medians = quantiles.quantiles_of(measured, ["column_name"], {c: {f"median_{c}": 0.5} for c in ("chars", "words")})
    return plain.join(medians.drop("n"), "column_name")


def duration_statistics(rows: DataFrame, value: str = "duration_hours") -> DataFrame:
    """One row: count, missing, range, quartiles, mean, 95th percentile, std and skewness.

    The skewness is corrected for bias, as pandas does it.
    """
    n = F.count(value)
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    plain = rows.agg(
        F.count_if(F.col(value).isNull()).alias("missing"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.when(n > 2, corrected).alias("skewness"))
    ranked = quantiles.quantiles(rows, [], value, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    parts = plain.select(F.struct(*plain.columns)).scalar()
    return ranked.withColumn("_plain", parts).select(
        F.col("n").alias("count"), "_plain.*", "p25", "median", "p75", "p95")


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max of several columns, one row each."""
    long = rows.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column_name", "value")
    plain = long.groupBy("column_name").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    ranked = quantiles.quantiles(long, ["column_name"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return plain.join(ranked, "column_name").select(
        "column_name", F.col("n").alias("count"), "mean", "std", "min", "p25", "median", "p75", "max")


def duration_histogram(rows: DataFrame, value: str = "duration_hours") -> DataFrame:
    """Rows in each of the seven buckets, empty ones included, with their share of all rows."""
    # at most eight rows are left for the window; rows without a bucket count towards the total
    counts = (rows.groupBy(durations.quality_bucket(F.col(value)).alias("bucket"))
              .agg(F.count("*").alias("n"))
              .withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100))
    labels = F.array(*[F.lit(label) for _, _, label in fv.QUALITY_BUCKETS])
    every = rows.sparkSession.range(1).select(F.posexplode(labels).alias("bucket_order", "bucket"))
    return every.join(counts, "bucket", "left").select(
        "bucket_order", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("percent", F.lit(0.0)).alias("percent"))


def repo_breakdown(rows: DataFrame, value: str = "duration_hours") -> DataFrame:
    """Rows, share, median and mean hours of each repo."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    plain = rows.groupBy("repo").agg(F.count("*").alias("count"), F.avg(value).alias("mean_hours"))
    ranked = quantiles.quantiles(rows, ["repo"], value, {"median_hours": 0.5}).drop("n")
    return plain.join(ranked, "repo", "left").select(
        "repo", "count", (F.col("count") / total * 100).alias("percent"), "median_hours", "mean_hours")


def issue_counters(pairs: DataFrame) -> DataFrame:
    """Counts of suspicious rows, one row per kind; all members of a duplicate key count."""
    hours = F.col("duration_hours")
    repeated = pairs.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    duplicates = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    counters = {
        "negative_duration": F.count_if(hours < 0),
        "zero_duration": F.count_if(hours == 0),
        "under_one_hour": F.count_if(hours < 1),
        "empty_issue_body": F.count_if(_empty("issue_body")),
        "empty_pr_body": F.count_if(_empty("pr_body")),
        "no_files_changed": F.count_if(F.col("num_files_changed") == 0)}
    one_row = pairs.agg(*[c.alias(n) for n, c in counters.items()]).withColumn("duplicate_key", duplicates)
    return one_row.unpivot([], [*counters, "duplicate_key"], "counter", "n")


def filter_impact(rows: DataFrame, value: str = "duration_hours",
                  min_hours: float = fv.MIN_DURATION_HOURS,
                  max_days: float = fv.MAX_DURATION_DAYS) -> DataFrame:
    """What the duration filter keeps and removes, and the median and mean of what is kept."""
    inside = durations.in_bounds(F.col(value), min_hours, max_days)
    counts = rows.agg(
        F.count_if(inside).alias("kept"), F.count_if(~inside).alias("removed"),
        (F.count_if(inside) / F.nullif(F.count("*"), F.lit(0)) * 100).alias("kept_percent"),
        (F.count_if(~inside) / F.nullif(F.count("*"), F.lit(0)) * 100).alias("removed_percent"),
        F.avg(F.when(inside, F.col(value))).alias("kept_mean"))
    median = quantiles.quantiles(rows.where(inside), [], value, {"m": 0.5}).select("m").scalar()
    return counts.withColumn("kept_median", median)
