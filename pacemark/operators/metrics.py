"""Error metrics of predictions, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations
from pacemark.operators import quantiles, ranks
from pacemark.operators.groups import side_by_side
from pacemark.sources.schemas import KEY

METRICS = ["mae", "mdae", "mre", "pred_25", "pred_50", "r2", "sa"]


def errors(predictions: DataFrame) -> DataFrame:
    """Absolute and relative error next to each prediction; NaN hours count as missing."""
    actual, predicted = F.col("actual_hours"), F.col("predicted_hours")
    present = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in predictions.dtypes
               if c in ("actual_hours", "predicted_hours") and kind in ("double", "float")}
    return (predictions.withColumns(present).withColumn("abs_error", durations.absolute_error(actual, predicted))
            .withColumn("rel_error", durations.relative_error(actual, predicted)))


def regression_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """MAE, MdAE, MMRE, PRED(25), PRED(50) and R2 of each group, in percent where usual."""
    rows = errors(predictions)
    error = F.col("abs_error")
    plain = rows.groupBy(*by).agg(
        F.avg(error).alias("mae"),
        F.avg("rel_error").alias("mre"),
        (F.avg((F.col("rel_error") <= 0.25).cast("double")) * 100).alias("pred_25"),
        (F.avg((F.col("rel_error") <= 0.50).cast("double")) * 100).alias("pred_50"),
        (1 - F.avg(error * error) / F.nullif(F.var_pop("actual_hours"), F.lit(0.0))).alias("r2"))
    medians = quantiles.quantiles(rows, by, "abs_error", {"mdae": 0.5})
    return side_by_side(plain, medians, by).select(
        *by, "n", "mae", "mdae", "mre", "pred_25", "pred_50", "r2")


def accuracy_over_random(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Standardised accuracy of the test rows against random guesses from the train rows.

    ``predictions`` holds both splits. A baseline without error gives zeros.
    """
    guesses = ranks.random_guess_error(predictions, by, "actual_hours", F.col("split") == "test")
    return _accuracy(predictions, guesses, by)


def accuracy_over_draws(predictions: DataFrame, by: list[str], draws: int = 1000, seed: int = fv.SEED) -> DataFrame:
    """The same with a baseline from ``draws`` seeded runs of random guessing instead of their exact expectation."""
    present = errors(predictions)
    guesses = ranks.drawn_guess_error(present, by, "actual_hours", F.col("split") == "test", KEY, draws, seed)
    return _accuracy(predictions, guesses, by)


def _accuracy(predictions: DataFrame, guesses: DataFrame, by: list[str]) -> DataFrame:
    tested = errors(predictions.where("split = 'test'")).groupBy(*by).agg(F.avg("abs_error").alias("mae"))
    base, spread, mae = F.col("mae_p0"), F.col("std_p0"), F.col("mae")
    gain = F.when(spread > 0, (base - mae) / spread).otherwise(F.lit(0.0))
    return side_by_side(guesses, tested, by).select(
        *by, "mae", "mae_p0",
        F.when(base == 0, F.lit(0.0)).otherwise(spread).alias("std_p0"),
        F.when(base == 0, F.lit(0.0)).otherwise((1 - mae / base) * 100).alias("sa"),
        F.when(base == 0, F.lit(0.0)).otherwise(gain).alias("glass_delta"))


def accuracy_over_mean(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy against always answering the mean of the same rows; one group gives one row."""
    means = predictions.groupBy(*by).agg(F.avg("actual_hours").alias("_mean"))
    if by:
        rows = errors(predictions).join(means, by)
    else:
        rows = errors(predictions).withColumn("_mean", means.scalar())
    base = F.sum(F.abs(F.col("actual_hours") - F.col("_mean")))
    return rows.groupBy(*by).agg(
        F.when(base > 0, (1 - F.sum("abs_error") / base) * 100).otherwise(F.lit(0.0)).alias("sa_mean"))


def all_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of the test rows, standardised accuracy included."""
    tested = regression_metrics(predictions.where("split = 'test'"), by)
    return side_by_side(tested, accuracy_over_random(predictions, by).drop("mae"), by)


def split_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median and standard deviation of the target in each group."""
    plain = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return side_by_side(plain, quantiles.quantiles(rows, by, value, {"median": 0.5}), by).select(
        *by, "n", "mean", "median", "std")


def summary_table(metrics: DataFrame, models: list[str]) -> DataFrame:
    """One row per metric, one column per model."""
    long = metrics.unpivot(["model"], METRICS, "metric", "value")
    return long.groupBy("metric").pivot("model", models).agg(F.first("value")).select(
        "metric", *[F.col(m).alias(f"model_{m.lower()}") for m in models])


def estimator_delta(estimator: DataFrame, reference: DataFrame,
                    names: list[str] | None = None) -> DataFrame:
    """Metric by metric what an external estimator adds to or takes from a model."""
    names = names or ["mae", "mdae", "sa", "pred_25", "r2"]
    ours = estimator.unpivot([], names, "metric", "estimator")
    theirs = reference.unpivot([], names, "metric", "model")
    return ours.join(theirs, "metric").withColumn("delta", F.col("estimator") - F.col("model"))
