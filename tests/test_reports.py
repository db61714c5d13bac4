"""Quality report and bucket tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.operators import buckets, metrics, quality, repos, sensitivity

PREDICTIONS = "repo string, issue_number long, model string, split string, actual_hours double, predicted_hours double"
MIDDLES = [4.0, 16.0, 48.0, 120.0, 400.0, 1000.0]

# The bucket grids published for two models on 896 test rows; rows are
# actual buckets, columns predicted ones.
TEXT_MODEL_GRID = [[0, 4, 40, 34, 8, 0], [0, 1, 32, 39, 18, 0], [0, 1, 37, 78, 41, 0],
                   [0, 1, 26, 71, 35, 0], [0, 2, 41, 124, 94, 2], [0, 2, 13, 65, 86, 1]]
HISTORY_MODEL_GRID = [[0, 0, 1, 84, 1, 0], [0, 0, 1, 89, 0, 0], [0, 0, 4, 150, 3, 0],
                      [0, 0, 4, 127, 2, 0], [0, 0, 4, 258, 1, 0], [0, 0, 1, 166, 0, 0]]


def from_grid(spark, grid):
    rows, n = [], 0
    for i, line in enumerate(grid):
        for j, count in enumerate(line):
            for _ in range(count):
                rows.append(("r", n, "m", "test", MIDDLES[i], MIDDLES[j]))
                n += 1
    return spark.createDataFrame(rows, PREDICTIONS)


@pytest.mark.parametrize("published,correct,percent", [
    (TEXT_MODEL_GRID, 204, 22.8), (HISTORY_MODEL_GRID, 132, 14.7)])
def test_published_grids(spark, published, correct, percent):
    df = from_grid(spark, published)
    grid = buckets.bucket_grid(df, ["model"]).orderBy("bucket_order").collect()
    assert [[r[f"predicted_{j}"] for j in range(6)] for r in grid] == published
    accuracy = buckets.bucket_accuracy(df, ["model"]).first()
    assert (accuracy.correct, accuracy.total) == (correct, 896)
    assert accuracy.accuracy == pytest.approx(percent, abs=0.05)
    shares = buckets.bucket_grid(df, ["model"], percent=True).collect()
    assert all(sum(r[f"predicted_{j}"] for j in range(6)) == pytest.approx(100) for r in shares)


def test_empty_buckets_show_in_the_grid(spark):
    df = from_grid(spark, [[2, 0, 0, 0, 0, 1]] + [[0] * 6] * 5)
    grid = buckets.bucket_grid(df, ["model"]).collect()
    assert len(grid) == 6 and sum(r.predicted_0 + r.predicted_5 for r in grid) == 3
    assert len(buckets.bucket_grid(df, []).collect()) == 6


def noisy(spark, n=600):
    rng = np.random.RandomState(3)
    actual = rng.lognormal(4, 1.5, n)
    predicted = actual * rng.lognormal(0, 0.8, n)
    rows = [("r", i, "m", "test", float(a), float(p)) for i, (a, p) in enumerate(zip(actual, predicted))]
    return spark.createDataFrame(rows, PREDICTIONS), actual, np.abs(actual - predicted)


def bounds(label):
    low, high = next((lo, hi) for lo, hi, lab in fv.PREDICTION_BUCKETS if lab == label)
    return low, float("inf") if high is None else high


def test_errors_and_boxes_per_bucket(spark):
    df, actual, error = noisy(spark)
    for r in buckets.error_by_range(df, ["model"]).collect():
        low, high = bounds(r.bucket)
        e = error[(actual >= low) & (actual < high)]
        assert (r["count"], r.median_error_h, r.mean_error_h, r.p90_error_h) == (
            len(e), pytest.approx(np.median(e)), pytest.approx(e.mean()), pytest.approx(np.percentile(e, 90)))
    for r in buckets.box_statistics(df, ["model"]).collect():
        low, high = bounds(r.bucket)
        e = error[(actual >= low) & (actual < high)]
        q1, q3 = np.percentile(e, [25, 75])
        inside = e[(e >= q1 - 1.5 * (q3 - q1)) & (e <= q3 + 1.5 * (q3 - q1))]
        assert (r.whisker_low, r.whisker_high, r.outliers) == (
            pytest.approx(inside.min()), pytest.approx(inside.max()), len(e) - len(inside))


def test_best_and_worst_examples(spark):
    df, actual, error = noisy(spark)
    chosen = buckets.best_and_worst(df, ["model"], 2).collect()
    relative = error / actual
    for label in {r.actual_bucket for r in chosen}:
        low, high = bounds(label)
        ordered = np.sort(relative[(actual >= low) & (actual < high)])
        for kind, want in (("best", ordered[:2]), ("worst", ordered[::-1][:2])):
            got = sorted((r.position, r.rel_error) for r in chosen if (r.actual_bucket, r.kind) == (label, kind))
            assert [x for _, x in got] == pytest.approx(list(want))
    plan = buckets.best_and_worst(df, ["model"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_band(spark):
    df = spark.createDataFrame([("r", 1, "m", "test", 100.0, p) for p in (74.9, 75.0, 125.0, 125.1)], PREDICTIONS)
    assert [r.within_band for r in buckets.band_flags(df).orderBy("predicted_hours").collect()] == [False, True, True, False]


def pairs(spark):
    rows = [("r", 1, "a b", "", 5.0, 1), ("r", 1, None, "x", -1.0, 0), ("s", 2, "", None, 0.0, 2),
            ("s", 3, "word", "y z w", 0.5, 0), ("s", 4, "t", "q", None, 3)]
    return spark.createDataFrame(rows, "repo string, issue_number long, issue_body string, pr_body string, "
                                       "duration_hours double, num_files_changed long")


def test_missing_values(spark):
    got = {r.column_name: (r.missing, r.missing_percent, r.flagged) for r in quality.missing_report(pairs(spark)).collect()}
    assert got["issue_body"] == (2, 40.0, True) and got["pr_body"] == (2, 40.0, True)
    assert got["duration_hours"] == (1, 20.0, True) and got["repo"] == (0, 0.0, False)


def test_counters(spark):
    got = {r.counter: r.n for r in quality.issue_counters(pairs(spark)).collect()}
    assert got == {"negative_duration": 1, "zero_duration": 1, "under_one_hour": 3, "empty_issue_body": 2,
                   "empty_pr_body": 2, "no_files_changed": 2, "duplicate_key": 2}


def test_text_statistics(spark):
    r = {x.column_name: x for x in quality.text_statistics(pairs(spark), ["issue_body", "pr_body"]).collect()}
    assert (r["issue_body"].non_empty, r["issue_body"].max_chars, r["issue_body"].median_words) == (3, 4, 1.0)
    assert (r["pr_body"].min_words, r["pr_body"].max_words, r["pr_body"].mean_chars) == (0, 3, 1.4)


def test_duration_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (30.0,), (None,)], "duration_hours double")
    r = quality.duration_statistics(df).first()
    assert (r["count"], r.missing, r.min, r.max, r.median, r.p25) == (5, 1, 1.0, 30.0, 4.0, 2.0)
    assert r.skewness == pytest.approx(1.8142, abs=1e-4)
    assert r.std == pytest.approx(np.std([1, 2, 4, 10, 30], ddof=1))


def test_histogram_shows_every_bucket(spark):
    got = quality.duration_histogram(pairs(spark)).orderBy("bucket_order").collect()
    assert [r.n for r in got] == [3, 0, 0, 0, 0, 0, 0]
    assert got[0].percent == pytest.approx(60)


def test_filter_impact(spark):
    df = spark.createDataFrame([(h,) for h in (0.5, 1.0, 24.0, 500.0, 2160.0, 2161.0, 5000.0, None)], "duration_hours double")
    r = quality.filter_impact(df).first()
    assert (r.kept, r.removed, r.kept_percent, r.kept_median) == (4, 4, 50.0, 262.0)


def test_describe(spark):
    r = quality.describe(pairs(spark), ["duration_hours", "num_files_changed"]).where("column_name = 'num_files_changed'").first()
    assert (r["count"], r.mean, r.min, r.median, r.max) == (5, 1.2, 0.0, 1.0, 3.0)


def test_inclusion_flags_use_the_unrounded_age(spark):
    activity = spark.sql("""SELECT 'r' repo, true is_closed, id author, timestamp'2022-01-20' created_at FROM range(20)
                            UNION ALL SELECT 's', false, 1, timestamp'2010-01-01'""")
    stats = repos.inclusion_statistics(activity)
    flags = {r.repo: r for r in repos.inclusion_flags(stats, F.lit("2025-01-01").cast("timestamp"), min_closed=20).collect()}
    r = flags["r"]
    assert (r.contributor_count, r.age_years) == (11, pytest.approx(2.9, abs=0.06))
    assert (r.meets_issue_threshold, r.meets_contributor_threshold, r.meets_age_threshold, r.passes_all) == (True, True, False, False)
    assert (flags["s"].total_closed_issues, flags["s"].contributor_count, flags["s"].passes_all) == (0, 1, False)


def test_caps_with_few_rows_are_left_out(spark):
    df = spark.range(60).select((F.col("id") * 10.0 + 1).alias("hours"))
    got = {r.threshold: r["count"] for r in sensitivity.capped_rows(df, "hours").groupBy("threshold").count().collect()}
    assert got == {"30d": 60, "60d": 60, "90d": 60, "no cap": 60}


@pytest.mark.parametrize("flags,verdict", [(["no", "err"], "robust null"), (["YES", "YES"], "helps"), (["YES", "no"], "mixed")])
def test_verdict(spark, flags, verdict):
    df = spark.createDataFrame([(f,) for f in flags], "a_vs_c_sig string")
    assert sensitivity.sensitivity_verdict(df).first().verdict == verdict


def test_summary_table(spark):
    row = {"mae": 1.0, "mdae": 2.0, "mre": 3.0, "pred_25": 4.0, "pred_50": 5.0, "r2": 6.0, "sa": 7.0}
    df = spark.createDataFrame([(m, *[v + k for v in row.values()]) for k, m in enumerate("AB")],
                               "model string, " + ", ".join(f"{c} double" for c in row))
    got = {r.metric: (r.model_a, r.model_b, r.model_c) for r in metrics.summary_table(df, ["A", "B", "C"]).collect()}
    assert got["mae"] == (1.0, 2.0, None) and got["sa"] == (7.0, 8.0, None)
