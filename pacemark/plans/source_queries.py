"""Tables that are stored and read back, the way a study keeps them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacemark.functions import parsing
from pacemark.operators import keys, metrics, repos
from pacemark.plans import views
from pacemark.plans.registry import query, tidy
from pacemark.session import new_table_path
from pacemark.sources import readers, schemas, sinks, standins
from pacemark.sources.readers import read_table
from pacemark.sources.schemas import KEY


@query(f"""WITH {views.pairs()}
SELECT repo, issue_number, issue_title, nullif(issue_body, '') AS issue_body, array_to_string(issue_labels, '|') AS issue_labels,
  created_us, assigned_us, merged_us, pr_number, pr_title, pr_body,
  nullif(array_to_string(files, '|'), '') AS pr_files_changed, num_files_changed, round(duration_hours, 6) AS duration_hours
FROM pairs""")
def pairs_csv_round_trip(spark, sf_dir):
    """Pairs as CSV, read with the declared schema; '' and null are one in that format."""
    pairs = standins.pairs(spark, sf_dir).withColumns({
        "issue_labels": parsing.join_list(F.col("issue_labels")),
        "pr_files_changed": parsing.join_list(F.col("pr_files_changed"))})
    folder = new_table_path(spark, "raw")
    sinks.write_csv(pairs.select(*schemas.ISSUE_PAIRS.names), f"{folder}/issue_pr_pairs.csv")
    back = readers.read_pairs(spark, folder)
    times = {"created_us": "issue_created_at", "assigned_us": "issue_assigned_at", "merged_us": "pr_merged_at"}
    texts = {c: F.nullif(c, F.lit("")) for c in ("issue_body", "pr_files_changed")}
    return tidy(back.withColumns({n: F.unix_micros(c) for n, c in times.items()}).withColumns(texts)
                .drop(*times.values()))


@query(f"""WITH {views.issues()}, log AS (
  SELECT repo, issue_number FROM issues WHERE created_us < 1704931200000000)
SELECT DISTINCT repo, issue_number FROM (SELECT * FROM log UNION ALL SELECT repo, issue_number FROM issues)""")
def checked_log_store(spark, sf_dir):
    """The log of seen keys, kept as a table and appended to."""
    issues = standins.issue_events(spark, sf_dir).select(*KEY, "issue_created_at")
    path = new_table_path(spark, "checked")
    first = issues.where(F.col("issue_created_at") < F.lit("2024-01-11").cast("timestamp"))
    first.select(*KEY).write.parquet(path)
    sinks.append_checked(spark.read.parquet(path), issues.select(*KEY), path)
    return spark.read.parquet(path).select(*KEY)


@query(f"""WITH {views.issues('first')}, {views.issues('second', 'signup')}
SELECT repo, issue_number, merged_us FROM first WHERE repo NOT IN (SELECT repo FROM second WHERE value >= 300)
UNION ALL SELECT repo, issue_number, merged_us FROM second WHERE repo IN (SELECT repo FROM second WHERE value >= 300)""")
def partial_saves(spark, sf_dir):
    """Pairs saved per repo; the repos that were collected again are replaced, the others stay."""
    path = new_table_path(spark, "partial")

    def collected(end):
        return standins.issue_events(spark, sf_dir, end).select(
            *KEY, "value", F.unix_micros("pr_merged_at").alias("merged_us"))

    sinks.save_partial_pairs(collected("purchase"), path)
    again = collected("signup")
    chosen = again.where(F.col("value") >= 300).select("repo")
    sinks.save_partial_pairs(again.join(chosen.distinct(), "repo", "left_semi"), path)
    return spark.read.parquet(path).select(*KEY, "merged_us")


@query("""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n,
  round(list_sum(list_transform(list_reverse(embedding), lambda x, i: x::DOUBLE * i)), 5) + 0e0 AS total FROM embeddings""")
def encoder_feature_store(spark, sf_dir):
    """Features of two encoders side by side; a reader scans the partition of one. The second reverses the vectors."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = new_table_path(spark, "features")
    turned = vectors.withColumn("embedding", F.reverse("embedding"))
    for name, features in (("given", vectors), ("reversed", turned)):
        slug = parsing.encoder_slug(F.lit(f"some org/{name}"))
        sinks.save_encoder_features(features.withColumn("encoder", slug), path)
    full = readers.read_features(spark, path, "some_org__given").select("vec_id", F.size("embedding").alias("n"))
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda t, x: t + x)
    other = readers.read_features(spark, path, "some_org__reversed").select("vec_id", total.alias("total"))
    return tidy(full.join(other, "vec_id"), 5)


@query(f"""WITH {views.PREDICTIONS}
SELECT model, count(*) AS n, round(avg(abs_error), 6) AS mae, round(quantile_cont(abs_error, 0.5), 6) AS mdae
FROM tested GROUP BY model""")
def metrics_json_round_trip(spark, sf_dir):
    """Metrics stored as JSON, one row per model, and read back with their schema."""
    tested = standins.predictions(spark, sf_dir).where("split = 'test'")
    measured = metrics.regression_metrics(tested, ["model"]).select("model", "n", "mae", "mdae")
    path = new_table_path(spark, "metrics")
    sinks.write_metrics(measured, path)
    return tidy(spark.read.schema(measured.schema).json(path))


@query("""WITH stats AS (
  SELECT n_name AS repo, count(*) FILTER (o_orderstatus = 'F') AS closed, count(DISTINCT o_custkey) AS people
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
valid AS (SELECT repo FROM stats WHERE closed >= 200 AND people >= 10)
SELECT n_name AS repo, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IN (SELECT repo FROM valid) OR NOT EXISTS (SELECT 1 FROM valid) GROUP BY n_name""")
def allowed_by_validation(spark, sf_dir):
    """The validation result stored as JSON and read back as the list of repos to collect from."""
    activity = standins.repo_activity(spark, sf_dir)
    flags = repos.inclusion_flags(repos.inclusion_statistics(activity), F.lit("2024-01-01").cast("timestamp"),
                                  min_closed=200)
    path = new_table_path(spark, "validation")
    sinks.write_metrics(flags, path)
    allowed = readers.valid_repos(spark.read.schema(schemas.VALIDATION).json(path))
    return keys.only_listed(activity, allowed, ["repo"]).groupBy("repo").agg(F.count("*").alias("n"))
