"""Empty, one-sided and incomplete inputs: defined results instead of errors."""

import math

import pytest

from pacemark.operators import comparison, embeddings, metrics, quality, ranks
from pacemark.operators.unions import stacked
from pyspark.sql import functions as F

PREDICTIONS = "model string, split string, repo string, issue_number long, actual_hours double, predicted_hours double"


def predictions(spark, rows):
    return spark.createDataFrame(rows, PREDICTIONS)


def test_report_leaves_out_a_missing_model(spark):
    rows = [(m, "test", "r", i, 10.0 * i, 10.0 * i + d) for i in range(1, 9) for m, d in (("A", 1.5 * i), ("B", -1.0 - i))]
    report = comparison.comparison_report(predictions(spark, rows), ["A", "B", "C"])
    assert [(r.model_1, r.model_2) for r in report.collect()] == [("A", "B")]


def test_perfect_correlation_is_infinite(spark):
    df = spark.createDataFrame([([float(i), float(i % 3)], float(2 * i)) for i in range(10)], "v array<double>, y double")
    scores = {r.element: r.f_score for r in embeddings.f_scores(df, "v", "y").collect()}
    assert math.isinf(scores[0]) and 0 <= scores[1] < 1


def test_filter_impact_of_nothing(spark):
    row = quality.filter_impact(spark.createDataFrame([], "duration_hours double")).first()
    assert (row.kept, row.removed, row.kept_percent, row.kept_median) == (0, 0, None, None)


def test_groups_with_one_split_have_no_guesses(spark):
    rows = [("both", 1.0, True), ("both", 3.0, False), ("test", 1.0, True), ("train", 2.0, False)]
    df = spark.createDataFrame(rows, "g string, v double, t boolean")
    got = {r.g: r.mae_p0 for r in ranks.random_guess_error(df, ["g"], "v", F.col("t")).collect()}
    assert got == {"both": 2.0, "test": None, "train": None}


def test_nan_counts_as_missing_in_all_metrics(spark):
    rows = [("A", "test", "r", 1, 10.0, 12.0), ("A", "test", "r", 2, 10.0, float("nan")), ("A", "test", "r", 3, 20.0, 14.0)]
    row = metrics.regression_metrics(predictions(spark, rows), ["model"]).first()
    assert (row.n, row.mae, row.mdae) == (2, 4.0, 4.0)


def test_unions_leave_the_session_alone(spark):
    df = spark.range(2)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert stacked(df, df).count() == 4
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        with pytest.raises(ValueError, match="prepare"):
            stacked(df, df)
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
