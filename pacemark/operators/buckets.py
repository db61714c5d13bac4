"""Duration buckets of actual and predicted hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations, text
from pacemark.operators import metrics, quantiles
from pacemark.operators.unions import stacked
from pacemark.sources.schemas import KEY

LABELS = [label for _, _, label in fv.PREDICTION_BUCKETS]


def _label_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """Every bucket once per group, so that empty buckets show."""
    every = F.posexplode(F.array(*[F.lit(label) for label in LABELS])).alias("bucket_order", "bucket")
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
    return groups.select(*by, every)


def bucketed(predictions: DataFrame) -> DataFrame:
    return (metrics.errors(predictions)
            .withColumn("actual_bucket", durations.prediction_bucket(F.col("actual_hours")))
            .withColumn("predicted_bucket", durations.prediction_bucket(F.col("predicted_hours"))))


def bucket_grid(predictions: DataFrame, by: list[str], percent: bool = False) -> DataFrame:
    """Actual bucket by predicted bucket, all cells; counts, or shares of the row."""
    cells = bucketed(predictions).groupBy(*by, "actual_bucket").pivot("predicted_bucket", LABELS).count()
    names = [f"predicted_{i}" for i in range(len(LABELS))]
    cells = cells.toDF(*by, "bucket", *names)
    grid = _label_rows(cells, by).join(cells, [*by, "bucket"], "left").fillna(0, names)
    if percent:
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        return grid.select(*by, "bucket_order", "bucket", *[
            F.coalesce(F.col(n) / F.nullif(total, F.lit(0)) * 100, F.lit(0.0)).alias(n) for n in names])
    return grid.select(*by, "bucket_order", "bucket", *names)


def bucket_accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows whose predicted bucket is the actual one."""
    hit = (F.col("actual_bucket") == F.col("predicted_bucket")).cast("long")
    return bucketed(predictions).groupBy(*by).agg(
        F.sum(hit).alias("correct"), F.count("*").alias("total"),
        (F.avg(hit) * 100).alias("accuracy"))


def error_by_range(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Absolute error per actual bucket: count, median, mean and 90th percentile."""
    rows = bucketed(predictions).withColumnRenamed("actual_bucket", "bucket")
    group = [*by, "bucket"]
    means = rows.groupBy(*group).agg(F.avg("abs_error").alias("mean_error_h"))
    ranked = quantiles.quantiles_of(rows, group, {
        "abs_error": {"median_error_h": 0.5, "p90_error_h": 0.9}, "rel_error": {"median_rel_error": 0.5}})
    return means.join(ranked, group).select(
        *group, F.col("n").alias("count"), "median_error_h", "mean_error_h", "p90_error_h",
        "median_rel_error")


def box_statistics(predictions: DataFrame, by: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles of the absolute error per bucket and the whiskers of a box plot."""
    rows = bucketed(predictions).withColumnRenamed("actual_bucket", "bucket").select(
        *by, "bucket", "abs_error")
    group = [*by, "bucket"]
    boxes = quantiles.quantiles(rows, group, "abs_error", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    error, width = F.col("abs_error"), (F.col("q3") - F.col("q1")) * reach
    low = F.min(F.when(error >= F.col("q1") - width, error))
    high = F.max(F.when(error <= F.col("q3") + width, error))
    outside = (error < F.col("q1") - width) | (error > F.col("q3") + width)
    return (rows.join(boxes, group).groupBy(*group, "n", "q1", "median", "q3")
            .agg(F.least(low, F.col("q1")).alias("whisker_low"),
                 F.greatest(high, F.col("q3")).alias("whisker_high"),
                 F.count_if(outside).alias("outliers")))


def band_flags(predictions: DataFrame, share: float = 0.25) -> DataFrame:
    """Whether each prediction lies within a share of the actual hours."""
    return predictions.withColumn("within_band", durations.within_band(
        F.col("actual_hours"), F.col("predicted_hours"), share))


def best_and_worst(predictions: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The ``n`` best and worst predictions of each actual bucket by relative error.

    Both positions are bounded by a constant, so Spark keeps ``n`` rows per bucket and
    task before the shuffle. The two ends are found in separate passes for that reason.
    """
    rows = bucketed(predictions)
    ends = []
    for kind, order in (("best", F.col("rel_error").asc()), ("worst", F.col("rel_error").desc())):
        window = Window.partitionBy(*by, "actual_bucket").orderBy(order, *[F.col(c) for c in KEY])
        ends.append(rows.withColumn("position", F.row_number().over(window))
                    .where(F.col("position") <= n).withColumn("kind", F.lit(kind)))
    return stacked(*ends)


def described_examples(examples: DataFrame, pairs: DataFrame, text_limit: int = 400) -> DataFrame:
    """Examples joined back to the texts they came from, with readable hours."""
    source = pairs.select(*KEY, "issue_title", "issue_body", F.size("pr_files_changed").alias("files"))
    # a fixed number of examples per bucket and group: texts of other pairs do not travel
    source = source.join(F.broadcast(examples.select(*KEY).distinct()), KEY, "left_semi")
    return examples.join(source, KEY, "left").withColumns({
        "actual": durations.readable_hours(F.col("actual_hours")),
        "predicted": durations.readable_hours(F.col("predicted_hours")),
        "error": durations.readable_hours(F.col("abs_error")),
        "excerpt": text.short_text(F.col("issue_body"), text_limit),
        "files": F.coalesce("files", F.lit(0)).cast("long")})
