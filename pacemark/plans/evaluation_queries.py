"""Metrics, paired comparison, buckets and sensitivity, on predictions SQL can recompute."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations
from pacemark.operators import buckets, comparison, estimates, metrics, sensitivity
from pacemark.plans import views
from pacemark.plans.registry import query, tidy
from pacemark.session import written
from pacemark.sources import standins
from pacemark.sources.schemas import KEY

_MODELS = ["A", "B", "C"]


def _tested(spark, sf_dir):
    return standins.predictions(spark, sf_dir).where("split = 'test'")


@query(f"""WITH {views.PREDICTIONS}
SELECT repo, issue_number, model, split, round(actual_hours, 6) AS actual_hours, predicted_hours FROM predictions""")
def simple_predictions(spark, sf_dir):
    return tidy(standins.predictions(spark, sf_dir).select(
        *KEY, "model", "split", "actual_hours", "predicted_hours"))


_METRICS_SQL = f"WITH {views.PREDICTIONS}, {views.metrics('model')}"


@query(f"""WITH {views.PREDICTIONS}
SELECT model, count(*) AS n, round(avg(abs_error), 6) AS mae, round(quantile_cont(abs_error, 0.5), 6) AS mdae,
  round(avg(rel_error), 6) AS mre, round(avg(CASE WHEN rel_error <= 0.25 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pred_25,
  round(avg(CASE WHEN rel_error <= 0.5 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pred_50,
  round(1 - avg(abs_error * abs_error) / nullif(var_pop(actual_hours), 0), 6) AS r2
FROM tested GROUP BY model""")
def regression_metrics(spark, sf_dir):
    return tidy(metrics.regression_metrics(_tested(spark, sf_dir), ["model"]))


@query(f"""{_METRICS_SQL}
SELECT model, round(mae, 6) AS mae, round(mae_p0, 6) AS mae_p0, round(std_p0, 6) AS std_p0, round(sa, 6) AS sa,
  round(glass_delta, 6) AS glass_delta FROM measured""")
def sa_random_exact(spark, sf_dir):
    return tidy(metrics.accuracy_over_random(standins.predictions(spark, sf_dir), ["model"]))


_DRAWS = 200


@query(f"""WITH {views.PREDICTIONS},
ranked AS (
  SELECT model, actual_hours AS guess, row_number() OVER (PARTITION BY model ORDER BY actual_hours) - 1 AS rank
  FROM predictions WHERE split = 'train'),
sizes AS (SELECT model, count(*) AS n_train FROM ranked GROUP BY model),
drawn AS (
  SELECT model, draw, actual_hours,
    CAST('0x' || substr(md5(concat_ws('|', '{fv.SEED}', draw, repo, issue_number)), 1, 13) AS BIGINT) % n_train AS rank
  FROM tested JOIN sizes USING (model), range(0, {_DRAWS}) d(draw)),
runs AS (SELECT model, draw, avg(abs(actual_hours - guess)) AS e FROM drawn JOIN ranked USING (model, rank) GROUP BY ALL),
guessed AS (SELECT model, avg(e) AS mae_p0, stddev_samp(e) AS std_p0 FROM runs GROUP BY model),
own AS (SELECT model, avg(abs_error) AS mae FROM tested GROUP BY model)
SELECT model, round(mae, 6) AS mae, round(mae_p0, 6) AS mae_p0, round(std_p0, 6) AS std_p0,
  round((1 - mae / mae_p0) * 100, 6) AS sa, round((mae_p0 - mae) / std_p0, 6) AS glass_delta FROM own JOIN guessed USING (model)""")
def sa_random_draws(spark, sf_dir):
    """Accuracy over random guessing from 200 seeded runs."""
    return tidy(metrics.accuracy_over_draws(standins.predictions(spark, sf_dir), ["model"], _DRAWS))


@query(f"""WITH {views.PREDICTIONS}, means AS (SELECT model, avg(actual_hours) AS m FROM tested GROUP BY model)
SELECT model, round((1 - sum(abs_error) / sum(abs(actual_hours - m))) * 100, 6) AS sa_mean
FROM tested JOIN means USING (model) GROUP BY model""")
def sa_mean(spark, sf_dir):
    return tidy(metrics.accuracy_over_mean(_tested(spark, sf_dir), ["model"]))


@query(f"""{_METRICS_SQL}, long AS (UNPIVOT (SELECT model, mae, mdae, mre, pred_25, pred_50, r2, sa FROM measured)
  ON mae, mdae, mre, pred_25, pred_50, r2, sa INTO NAME metric VALUE v)
SELECT metric, round(max(v) FILTER (model = 'A'), 6) AS model_a, round(max(v) FILTER (model = 'B'), 6) AS model_b,
  round(max(v) FILTER (model = 'C'), 6) AS model_c FROM long GROUP BY metric""")
def model_summary(spark, sf_dir):
    measured = metrics.all_metrics(standins.predictions(spark, sf_dir), ["model"])
    return tidy(metrics.summary_table(measured, _MODELS))


@query(f"""WITH {views.PREDICTIONS}, {views.paired()}
SELECT model_1, model_2, n, zeros, w_plus, w_minus, statistic, round(z, 6) AS z, round({views.normal_p('z')}, 6) AS p_value
FROM signed""")
def wilcoxon_test(spark, sf_dir):
    errors = written(comparison.paired_errors(_tested(spark, sf_dir), _MODELS), "errors")
    return tidy(comparison.wilcoxon(errors, comparison.PAIR))


_DELTA_SQL = """deltas AS (
  SELECT x.model_1, x.model_2, count(DISTINCT x.rowid) AS n_first, count(DISTINCT y.rowid) AS n_second,
    count(*) FILTER (x.error_1 > y.error_2) AS above, count(*) FILTER (x.error_1 < y.error_2) AS below
  FROM numbered x JOIN numbered y USING (model_1, model_2) GROUP BY ALL)"""
_DELTAS = f"""numbered AS (SELECT *, row_number() OVER () AS rowid FROM paired), {_DELTA_SQL},
effects AS (SELECT *, (above - below) / (CAST(n_first AS DOUBLE) * n_second) AS delta FROM deltas)"""


@query(f"""WITH {views.PREDICTIONS}, {views.paired()}, {_DELTAS}
SELECT model_1, model_2, n_first, n_second, above, below, round(delta, 6) AS delta, {views.effect('delta')} AS effect
FROM effects""")
def cliffs_delta(spark, sf_dir):
    errors = comparison.paired_errors(_tested(spark, sf_dir), _MODELS)
    counts = ["n_first", "n_second", "above", "below"]
    out = comparison.cliffs_delta(errors, comparison.PAIR)
    return tidy(out.withColumns({c: F.col(c).cast("long") for c in counts}))


@query(f"""WITH {views.PREDICTIONS}, {views.paired()}, {_DELTAS},
means AS (SELECT model_1, model_2, avg(error_1) AS m1, avg(error_2) AS m2 FROM paired GROUP BY ALL),
tests AS (SELECT *, {views.normal_p('z')} AS p FROM signed)
SELECT model_1, model_2, n, statistic, round(z, 6) AS z, round(p, 6) AS p_value, p < 0.05 AS is_significant,
  round(delta, 6) AS cliffs_delta, {views.effect('delta')} AS effect, round(m1, 6) AS mean_error_1,
  round(m2, 6) AS mean_error_2, CASE WHEN m1 < m2 THEN model_1 ELSE model_2 END AS better_model,
  round((greatest(m1, m2) - least(m1, m2)) / greatest(m1, m2) * 100, 6) AS improvement_percent
FROM tests JOIN effects USING (model_1, model_2) JOIN means USING (model_1, model_2)""")
def model_comparison(spark, sf_dir):
    return tidy(comparison.comparison_report(_tested(spark, sf_dir), _MODELS))


_BUCKETED = f"""bucketed AS (
  SELECT *, {views.prediction_bucket('actual_hours')} AS bucket,
    {views.prediction_bucket('predicted_hours')} AS predicted_bucket FROM tested)"""
_LABELS = f"""labels AS (
  SELECT unnest({views.words(buckets.LABELS)}) AS bucket, CAST(unnest(range(0, 6)) AS BIGINT) AS bucket_order),
grid AS (
  SELECT model, bucket_order, bucket FROM (SELECT DISTINCT model FROM tested), labels)"""
_CELL = [f"count(*) FILTER (predicted_bucket = '{label}') AS p{i}" for i, label in enumerate(buckets.LABELS)]
_GRID_SQL = f"""WITH {views.PREDICTIONS}, {_BUCKETED}, {_LABELS},
cells AS (SELECT model, bucket, count(*) AS n, {', '.join(_CELL)} FROM bucketed GROUP BY ALL)"""


@query(_GRID_SQL + " SELECT model, bucket_order, bucket, "
       + ", ".join(f"coalesce(p{i}, 0) AS predicted_{i}" for i in range(6))
       + " FROM grid LEFT JOIN cells USING (model, bucket)")
def bucket_grid(spark, sf_dir):
    return tidy(buckets.bucket_grid(_tested(spark, sf_dir), ["model"]))


@query(_GRID_SQL + " SELECT model, bucket_order, bucket, "
       + ", ".join(f"round(coalesce(p{i} * 100e0 / n, 0), 6) AS predicted_{i}" for i in range(6))
       + " FROM grid LEFT JOIN cells USING (model, bucket)")
def bucket_grid_percent(spark, sf_dir):
    return tidy(buckets.bucket_grid(_tested(spark, sf_dir), ["model"], percent=True))


@query(f"""WITH {views.PREDICTIONS}, {_BUCKETED}
SELECT model, count(*) FILTER (bucket = predicted_bucket) AS correct, count(*) AS total,
  round(count(*) FILTER (bucket = predicted_bucket) * 100e0 / count(*), 6) AS accuracy FROM bucketed GROUP BY model""")
def bucket_accuracy(spark, sf_dir):
    return tidy(buckets.bucket_accuracy(_tested(spark, sf_dir), ["model"]))


@query(f"""WITH {views.PREDICTIONS}, {_BUCKETED}
SELECT model, bucket, count(*) AS count, round(quantile_cont(abs_error, 0.5), 6) AS median_error_h,
  round(avg(abs_error), 6) AS mean_error_h, round(quantile_cont(abs_error, 0.9), 6) AS p90_error_h,
  round(quantile_cont(rel_error, 0.5), 6) AS median_rel_error FROM bucketed GROUP BY ALL""")
def error_by_range(spark, sf_dir):
    return tidy(buckets.error_by_range(_tested(spark, sf_dir), ["model"]))


@query(f"""WITH {views.PREDICTIONS}, {_BUCKETED},
boxes AS (
  SELECT model, bucket, count(*) AS n, quantile_cont(abs_error, 0.25) AS q1, quantile_cont(abs_error, 0.5) AS median,
    quantile_cont(abs_error, 0.75) AS q3 FROM bucketed GROUP BY ALL)
SELECT model, bucket, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3,
  round(least(min(CASE WHEN abs_error >= q1 - 1.5e0 * (q3 - q1) THEN abs_error END), any_value(q1)), 6) AS whisker_low,
  round(greatest(max(CASE WHEN abs_error <= q3 + 1.5e0 * (q3 - q1) THEN abs_error END), any_value(q3)), 6) AS whisker_high,
  count(CASE WHEN abs_error < q1 - 1.5e0 * (q3 - q1) OR abs_error > q3 + 1.5e0 * (q3 - q1) THEN 1 END) AS outliers
FROM bucketed JOIN boxes USING (model, bucket) GROUP BY model, bucket""")
def box_stats(spark, sf_dir):
    return tidy(buckets.box_statistics(_tested(spark, sf_dir), ["model"]))


@query(f"""WITH {views.PREDICTIONS}
SELECT repo, issue_number, model, predicted_hours BETWEEN 0.75e0 * actual_hours AND 1.25e0 * actual_hours AS within_band
FROM tested""")
def band_flags(spark, sf_dir):
    return buckets.band_flags(_tested(spark, sf_dir)).select(*KEY, "model", "within_band")


def _readable_sql(h: str) -> str:
    return (f"CASE WHEN {h} < 1 THEN CAST(trunc({h} * 60) AS BIGINT) || ' min' WHEN {h} < 24 THEN format('{{:.1f}}h', {h}) "
            f"WHEN {h} / 24 < 14 THEN format('{{:.1f}}d', {h} / 24) ELSE format('{{:.1f}}w', {h} / 24 / 7) END")


_EXAMPLES_SQL = f"""WITH {views.PREDICTIONS}, {_BUCKETED}, {views.pairs()},
best AS (SELECT *, 'best' AS kind, row_number() OVER (
  PARTITION BY model, bucket ORDER BY rel_error, repo, issue_number) AS position FROM bucketed),
worst AS (SELECT *, 'worst' AS kind, row_number() OVER (
  PARTITION BY model, bucket ORDER BY rel_error DESC, repo, issue_number) AS position FROM bucketed),
chosen AS (SELECT * FROM best WHERE position <= 3 UNION ALL SELECT * FROM worst WHERE position <= 3),
texts AS (
  SELECT repo, issue_number, issue_title, num_files_changed, regexp_replace(replace(replace(coalesce(issue_body, ''),
    chr(13), ''), E'\\n\\n', E'\\n'), '^[{views.SPACE}]+|[{views.SPACE}]+$', '', 'g') AS t FROM pairs)"""


@query(f"""{_EXAMPLES_SQL}
SELECT c.model, c.bucket AS actual_bucket, c.predicted_bucket, c.kind, c.position, c.repo, c.issue_number, issue_title,
  round(rel_error, 6) AS rel_error, {_readable_sql('actual_hours')} AS actual,
  {_readable_sql('predicted_hours')} AS predicted, {_readable_sql('abs_error')} AS error, num_files_changed AS files,
  CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(substr(t, 1, 400), '[{views.SPACE}]+$', '') || '...' END AS excerpt
FROM chosen c LEFT JOIN texts USING (repo, issue_number)""")
def best_worst_examples(spark, sf_dir):
    chosen = buckets.best_and_worst(_tested(spark, sf_dir), ["model"], 3)
    described = buckets.described_examples(chosen, standins.pairs(spark, sf_dir))
    return tidy(described.select("model", "actual_bucket", "predicted_bucket", "kind", "position", *KEY,
                                 "issue_title", "rel_error", "actual", "predicted", "error", "files", "excerpt"))


@query(f"""WITH {views.issues()}, h AS (SELECT *, (merged_us - created_us) / 3.6e9 AS h FROM issues)
SELECT repo, issue_number, CASE WHEN h < 1 THEN 'Trivial' WHEN h < 4 THEN 'Small' WHEN h < 16 THEN 'Medium'
  WHEN h < 40 THEN 'Large' ELSE 'XL' END AS effort_tier, {views.prediction_bucket('h')} AS bucket,
  {views.bucket('h', fv.QUALITY_BUCKETS, None)} AS quality_bucket, {_readable_sql('h')} AS readable,
  round(ln(1 + h), 6) AS log_hours, round(greatest(exp(ln(1 + h)) - 1, 0), 6) AS hours_again
FROM h""")
def effort_tiers(spark, sf_dir):
    hours = F.col("hours")
    return tidy(standins.timed_issues(spark, sf_dir).select(
        *KEY, durations.effort_tier(hours).alias("effort_tier"),
        durations.prediction_bucket(hours).alias("bucket"),
        durations.quality_bucket(hours).alias("quality_bucket"),
        durations.readable_hours(hours).alias("readable"),
        durations.log_target(hours).alias("log_hours"),
        durations.hours_from_log(durations.log_target(hours)).alias("hours_again")))


@query(f"""{_METRICS_SQL}, answers AS (
  SELECT i.repo, i.issue_number, actual_hours, CASE WHEN i.value < 30 THEN NULL ELSE CAST(i.k AS DOUBLE) END AS predicted
  FROM issues i JOIN (SELECT * FROM tested WHERE model = 'A') t USING (repo, issue_number)),
valid AS (SELECT *, abs(actual_hours - predicted) AS e FROM answers WHERE predicted IS NOT NULL),
m AS (SELECT avg(actual_hours) AS m FROM valid),
theirs AS (
  SELECT avg(e) AS mae, quantile_cont(e, 0.5) AS mdae, (1 - sum(e) / sum(abs(actual_hours - m))) * 100 AS sa,
    avg(CASE WHEN e / greatest(actual_hours, 1e-6) <= 0.25 THEN 1e0 ELSE 0e0 END) * 100 AS pred_25,
    1 - avg(e * e) / var_pop(actual_hours) AS r2 FROM valid, m),
x AS (UNPIVOT theirs ON mae, mdae, sa, pred_25, r2 INTO NAME metric VALUE estimator),
y AS (UNPIVOT (SELECT mae, mdae, sa, pred_25, r2 FROM measured WHERE model = 'A')
  ON mae, mdae, sa, pred_25, r2 INTO NAME metric VALUE model)
SELECT metric, round(estimator, 6) AS estimator, round(model, 6) AS model, round(estimator - model, 6) AS delta
FROM x JOIN y USING (metric)""")
def estimator_delta(spark, sf_dir):
    """An estimator that answers every test item in free text, against model A."""
    predictions = standins.predictions(spark, sf_dir)
    tested = predictions.where("split = 'test' and model = 'A'").select(*KEY, "actual_hours")
    issues = standins.issue_events(spark, sf_dir).select(*KEY, "k", "value")
    answer = F.when(F.col("value") < 30, "cannot say").otherwise(
        F.concat(F.lit('{"hours": '), F.col("k").cast("string"), F.lit("}")))
    answers = estimates.parsed_answers(issues.select(*KEY, answer.alias("answer")))
    joined = written(tested.join(answers.select(*KEY, "predicted_hours"), KEY), "answers")
    theirs = estimates.estimator_metrics(joined.select(*KEY, "actual_hours"), joined.drop("actual_hours"))
    model = metrics.all_metrics(predictions.where("model = 'A'"), ["model"])
    return tidy(metrics.estimator_delta(theirs, model))


@query(f"""WITH {views.PREDICTIONS}, answers AS (
  SELECT CASE WHEN i.value < 30 THEN NULL ELSE i.k END AS p FROM issues i
  JOIN (SELECT * FROM tested WHERE model = 'A') t USING (repo, issue_number))
SELECT count(p) AS n_samples, count(*) FILTER (p IS NULL) AS n_failed FROM answers""")
def estimator_answers(spark, sf_dir):
    tested = _tested(spark, sf_dir).where("model = 'A'").select(*KEY)
    issues = standins.issue_events(spark, sf_dir).select(*KEY, "k", "value")
    answer = F.when(F.col("value") < 30, "cannot say").otherwise(
        F.concat(F.lit('{"hours": '), F.col("k").cast("string"), F.lit("}")))
    answers = estimates.parsed_answers(issues.select(*KEY, answer.alias("answer")))
    return estimates.answer_counts(answers.join(tested, KEY, "left_semi"))


_CAPS = "(VALUES ('14d', 336e0), ('30d', 720e0), ('60d', 1440e0), ('90d', 2160e0), ('no cap', NULL)) c(threshold, cap)"
_CAPPED_SQL = f"""WITH {views.BANDED}, repeated AS (
  SELECT b.*, threshold FROM banded b, {_CAPS} WHERE hours >= 1 AND (cap IS NULL OR hours <= cap)),
capped AS (
  SELECT * FROM repeated WHERE threshold IN (SELECT threshold FROM repeated GROUP BY threshold HAVING count(*) >= 50)),
{views.simple_predictions('capped', 'threshold')},
{views.metrics('threshold, model')}, {views.paired('threshold')},
tests AS (SELECT threshold, model_2, {views.normal_p('z')} AS p FROM signed WHERE model_1 = 'A'),
sizes AS (SELECT threshold, count(*) AS n_samples FROM capped GROUP BY threshold),
flags AS (
  SELECT threshold, max(p) FILTER (model_2 = 'C') AS ac, max(p) FILTER (model_2 = 'B') AS ab FROM tests GROUP BY threshold)"""


def _sig(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'err' WHEN {p} < 0.05 THEN 'YES' ELSE 'no' END"


_WANTED = [("A", ["mae", "mdae", "sa", "r2", "pred_25"]), ("B", ["mae", "sa", "r2"]),
           ("C", ["mae", "sa", "r2", "pred_25"])]
_WIDE = ", ".join(f"round(max({m}) FILTER (model = '{name}'), 6) AS {name.lower()}_{m}"
                  for name, ms in _WANTED for m in ms)


def _sensitivity(spark, sf_dir):
    rows = written(sensitivity.capped_rows(standins.banded_issues(spark, sf_dir), "hours"), "capped")
    predictions = written(standins.simple_predictions(rows, ["threshold"]), "capped_predictions")
    return sensitivity.sensitivity_table(predictions)


@query(f"""{_CAPPED_SQL},
wide AS (SELECT threshold, {_WIDE} FROM measured GROUP BY threshold)
SELECT threshold, n_samples, wide.* EXCLUDE (threshold), round(ac, 6) AS a_vs_c_p, round(ab, 6) AS a_vs_b_p,
  {_sig('ac')} AS a_vs_c_sig, {_sig('ab')} AS a_vs_b_sig
FROM sizes JOIN wide USING (threshold) LEFT JOIN flags USING (threshold)""")
def sensitivity_analysis(spark, sf_dir):
    return tidy(_sensitivity(spark, sf_dir))


@query(f"""{_CAPPED_SQL},
counted AS (SELECT count(*) FILTER (ac < 0.05) AS significant, count(*) AS thresholds FROM sizes LEFT JOIN flags USING (threshold))
SELECT significant, thresholds, CASE WHEN significant = 0 THEN 'robust null'
  WHEN significant = thresholds THEN 'helps' ELSE 'mixed' END AS verdict FROM counted""")
def sensitivity_verdict(spark, sf_dir):
    return sensitivity.sensitivity_verdict(_sensitivity(spark, sf_dir))
