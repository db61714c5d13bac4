"""Evaluation of an external estimator that answers in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.functions import parsing
from pacemark.operators import metrics
from pacemark.operators.groups import side_by_side
from pacemark.sources.schemas import KEY


def parsed_answers(answers: DataFrame, column: str = "answer", hours_key: str = "hours") -> DataFrame:
    """Answers with the hours and the reasoning they state."""
    stated = parsing.stated_estimate(F.col(column), hours_key)
    return answers.withColumn("_stated", stated).select(
        "*", F.col("_stated.hours").alias("predicted_hours"), F.col("_stated.reasoning").alias("reasoning")
    ).drop("_stated")


def answer_counts(estimates: DataFrame) -> DataFrame:
    """Answers that could be read and answers that could not."""
    return estimates.agg(F.count("predicted_hours").alias("n_samples"),
                         F.count_if(F.col("predicted_hours").isNull()).alias("n_failed"))


def estimator_metrics(pairs: DataFrame, estimates: DataFrame) -> DataFrame:
    """Metrics of the readable answers, accuracy against the mean of the same rows."""
    rows = pairs.join(estimates.select(*KEY, "predicted_hours"), KEY).dropna(subset=["predicted_hours"])
    return (side_by_side(metrics.regression_metrics(rows, []), metrics.accuracy_over_mean(rows, []), [])
            .withColumnRenamed("sa_mean", "sa"))
