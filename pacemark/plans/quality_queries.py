"""The data quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations, parsing
from pacemark.operators import metrics, quality, splits, text_features
from pacemark.plans import views
from pacemark.plans.registry import query, tidy
from pacemark.session import written
from pacemark.sources import standins
from pacemark.sources.readers import read_table
from pacemark.sources.schemas import KEY

_COLUMNS = ["repo", "issue_number", "issue_title", "issue_body", "issue_labels", "created_us", "assigned_us",
            "merged_us", "pr_number", "pr_title", "pr_body", "files", "num_files_changed", "duration_hours"]
_TEXT = ["issue_title", "issue_body", "pr_title", "pr_body"]


def _saved_pairs(spark, sf_dir, *columns):
    pairs = standins.pairs(spark, sf_dir)
    return written(pairs.select(*columns) if columns else pairs, "pairs")


def _durations(spark, sf_dir):
    return written(_hours(spark, sf_dir), "durations")


def _hours(spark, sf_dir):
    return standins.issue_events(spark, sf_dir).select(*KEY, "num_files_changed", durations.duration_hours(
        F.col("issue_created_at"), F.col("issue_assigned_at"), F.col("pr_merged_at")).alias("duration_hours"))


_HOURS_SQL = f"""{views.issues()}, rows AS (
  SELECT *, (merged_us - coalesce(assigned_us, created_us)) / 3.6e9 AS h FROM issues)"""

_NUMBERS = {"duration_hours": "double", **dict.fromkeys(
    ["issue_number", "created_us", "assigned_us", "merged_us", "pr_number", "num_files_changed"], "bigint")}
_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_NUMBERS.get(c, 'string')}' AS data_type, count(*) AS total, count(*) FILTER ("
    + (f"coalesce({c}, '') = ''" if c in ("repo", *_TEXT) else
       f"len({c}) = 0" if c in ("files", "issue_labels") else f"{c} IS NULL") + ") AS missing FROM pairs"
    for c in _COLUMNS)


@query(f"""WITH {views.pairs()}, counts AS ({_MISSING_SQL})
SELECT column_name, data_type, total, missing, round(missing * 100e0 / total, 6) AS missing_percent,
  missing * 100e0 / total > 10 AS flagged FROM counts""")
def missing_report(spark, sf_dir):
    pairs = standins.pairs(spark, sf_dir)
    stored = pairs.select(
        "repo", "issue_number", "issue_title", "issue_body",
        parsing.join_list(F.col("issue_labels")).alias("issue_labels"),
        F.unix_micros("issue_created_at").alias("created_us"),
        F.unix_micros("issue_assigned_at").alias("assigned_us"),
        F.unix_micros("pr_merged_at").alias("merged_us"), "pr_number", "pr_title", "pr_body",
        parsing.join_list(F.col("pr_files_changed")).alias("files"), "num_files_changed", "duration_hours")
    return tidy(quality.missing_report(stored))


_TEXT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, length(coalesce({c}, '')) AS chars, {views.word_count(f'coalesce({c}, chr(32))')} AS words FROM pairs"
    for c in _TEXT)


@query(f"""WITH {views.pairs()}, m AS ({_TEXT_SQL})
SELECT column_name, count(*) FILTER (chars > 0) AS non_empty,
  round(count(*) FILTER (chars > 0) * 100e0 / count(*), 6) AS non_empty_percent,
  CAST(min(chars) AS BIGINT) AS min_chars, round(avg(chars), 6) AS mean_chars, CAST(max(chars) AS BIGINT) AS max_chars,
  min(words) AS min_words, round(avg(words), 6) AS mean_words, max(words) AS max_words,
  round(quantile_cont(chars, 0.5), 6) AS median_chars, round(quantile_cont(words, 0.5), 6) AS median_words
FROM m GROUP BY column_name""")
def text_stats(spark, sf_dir):
    return tidy(quality.text_statistics(_saved_pairs(spark, sf_dir, *_TEXT), _TEXT))


@query(f"""WITH {_HOURS_SQL}
SELECT count(h) AS count, count(*) FILTER (h IS NULL) AS missing, round(min(h), 6) AS min, round(max(h), 6) AS max,
  round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, round(skewness(h), 6) AS skewness,
  round(quantile_cont(h, 0.25), 6) AS p25, round(quantile_cont(h, 0.5), 6) AS median,
  round(quantile_cont(h, 0.75), 6) AS p75, round(quantile_cont(h, 0.95), 6) AS p95 FROM rows""")
def duration_stats(spark, sf_dir):
    return tidy(quality.duration_statistics(_durations(spark, sf_dir)))


@query(f"""WITH {_HOURS_SQL}, labels AS (
  SELECT unnest({views.words([b[2] for b in fv.QUALITY_BUCKETS])}) AS bucket,
    unnest(range(0, {len(fv.QUALITY_BUCKETS)})) AS bucket_order)
SELECT CAST(bucket_order AS BIGINT) AS bucket_order, bucket, count(h) AS n,
  round(count(h) * 100e0 / (SELECT count(*) FROM rows), 6) AS percent
FROM labels LEFT JOIN rows ON {views.bucket('h', fv.QUALITY_BUCKETS, None)} = bucket GROUP BY ALL""")
def duration_hist(spark, sf_dir):
    return tidy(quality.duration_histogram(_hours(spark, sf_dir)))


@query(f"""WITH {_HOURS_SQL}
SELECT repo, count(*) AS count, round(count(*) * 100e0 / (SELECT count(*) FROM rows), 6) AS percent,
  round(quantile_cont(h, 0.5), 6) AS median_hours, round(avg(h), 6) AS mean_hours FROM rows GROUP BY repo""")
def repo_breakdown(spark, sf_dir):
    return tidy(quality.repo_breakdown(_durations(spark, sf_dir)))


@query(f"""WITH {views.pairs('first')}, {views.pairs('second', 'signup')},
pairs AS (SELECT * FROM first UNION ALL SELECT * FROM second),
repeated AS (SELECT count(*) AS n FROM pairs GROUP BY repo, issue_number HAVING count(*) > 1)
SELECT 'negative_duration' AS counter, count(*) FILTER (duration_hours < 0) AS n FROM pairs
UNION ALL SELECT 'zero_duration', count(*) FILTER (duration_hours = 0) FROM pairs
UNION ALL SELECT 'under_one_hour', count(*) FILTER (duration_hours < 1) FROM pairs
UNION ALL SELECT 'empty_issue_body', count(*) FILTER (coalesce(issue_body, '') = '') FROM pairs
UNION ALL SELECT 'empty_pr_body', count(*) FILTER (coalesce(pr_body, '') = '') FROM pairs
UNION ALL SELECT 'no_files_changed', count(*) FILTER (num_files_changed = 0) FROM pairs
UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT) FROM repeated""")
def issue_counters(spark, sf_dir):
    columns = [*KEY, "duration_hours", "issue_body", "pr_body", "num_files_changed"]
    pairs = standins.pairs(spark, sf_dir).select(*columns).unionByName(
        standins.pairs(spark, sf_dir, "signup").select(*columns))
    return tidy(quality.issue_counters(written(pairs, "pairs")))


@query(f"""WITH {_HOURS_SQL}
SELECT count(*) FILTER (h BETWEEN 1 AND 2160) AS kept, count(*) FILTER (NOT h BETWEEN 1 AND 2160) AS removed,
  round(count(*) FILTER (h BETWEEN 1 AND 2160) * 100e0 / count(*), 6) AS kept_percent,
  round(count(*) FILTER (NOT h BETWEEN 1 AND 2160) * 100e0 / count(*), 6) AS removed_percent,
  round(avg(h) FILTER (h BETWEEN 1 AND 2160), 6) AS kept_mean,
  round(quantile_cont(h, 0.5) FILTER (h BETWEEN 1 AND 2160), 6) AS kept_median FROM rows""")
def filter_impact(spark, sf_dir):
    return tidy(quality.filter_impact(_durations(spark, sf_dir)))


@query(f"""WITH texts AS (SELECT coalesce(source, '') || ' ' || coalesce(text, '') AS t FROM documents),
m AS (SELECT 'text_length' AS column_name, length(t) AS v FROM texts
  UNION ALL SELECT 'word_count', {views.word_count('t')} FROM texts)
SELECT column_name, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  CAST(min(v) AS DOUBLE) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS p75, CAST(max(v) AS DOUBLE) AS max FROM m GROUP BY column_name""")
def feature_describe(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    features = text_features.derived_features(documents, ["doc_id"], F.col("source"), F.col("text"))
    columns = ["text_length", "word_count"]
    return tidy(quality.describe(written(features.select(*columns), "text_features"), columns))


@query(f"""WITH {views.issues()}
SELECT repo, issue_number, {views.holdout()} AS split, {views.fold()} AS fold FROM issues""")
def holdout_split(spark, sf_dir):
    rows = standins.issue_events(spark, sf_dir)
    repo, number = F.col("repo"), F.col("issue_number")
    return tidy(rows.select(*KEY, splits.holdout(repo, number).alias("split"),
                            splits.fold(repo, number).alias("fold")))


@query(f"""WITH {views.BANDED}
SELECT split, count(*) AS n, round(avg(hours), 6) AS mean, round(quantile_cont(hours, 0.5), 6) AS median,
  round(stddev_samp(hours), 6) AS std FROM banded WHERE hours BETWEEN 1 AND 2160 GROUP BY split""")
def split_stats(spark, sf_dir):
    rows = standins.timed_issues(spark, sf_dir).where(durations.in_bounds(F.col("hours")))
    marked = rows.withColumn("split", splits.holdout(F.col("repo"), F.col("issue_number")))
    return tidy(metrics.split_statistics(written(marked, "split_rows"), ["split"], "hours"))


@query(f"""WITH {views.issues()}
SELECT repo, issue_number FROM issues
ORDER BY md5(repo || '#' || issue_number || '#{fv.SEED}'), repo, issue_number LIMIT 100""")
def estimator_sample(spark, sf_dir):
    """The sample an external estimator is asked about; its size is the feature."""
    return splits.sample(standins.timed_issues(spark, sf_dir), 100).select(*KEY)
