"""File history, co-change and history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.operators import history
from pacemark.plans import views
from pacemark.plans.registry import query, tidy
from pacemark.session import new_table_path, written
from pacemark.sources import history_store, sinks, standins
from pacemark.sources.schemas import KEY


@query(f"""WITH {views.COMMIT_FILES}
SELECT repo, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS commits,
  min(at_us) AS first_us, max(at_us) AS last_us FROM commit_files GROUP BY ALL""")
def file_history(spark, sf_dir):
    files = history.file_history(standins.commit_files(spark, sf_dir))
    return files.select("repo", "path", "added", "deleted", "commits",
                        F.unix_micros("first_seen").alias("first_us"),
                        F.unix_micros("last_modified").alias("last_us"))


@query(f"""WITH {views.COMMIT_FILES}, {views.edges('edges', 'commit_files')}
SELECT repo, source, partner, n FROM edges""")
def cochange_edges(spark, sf_dir):
    commits = standins.stored_commits(spark, sf_dir)
    return history.stored_edges(commits, commits.select("repo", "path"))


def _tables(spark, sf_dir):
    commits = standins.stored_commits(spark, sf_dir)
    own = commits.select("repo", F.col("commit_id").alias("issue_number"), "path")
    return written(standins.order_pairs(spark, sf_dir), "order_pairs"), own, commits


@query(f"""WITH {views.COMMIT_FILES}, {views.ORDER_PAIRS}, {views.history('features', 'order_pairs')}
SELECT * FROM features""")
def history_features(spark, sf_dir):
    return tidy(history.history_features(*_tables(spark, sf_dir)))


@query(f"""WITH {views.COMMIT_FILES}, {views.ORDER_PAIRS},
held AS (SELECT * FROM order_pairs WHERE created_us < 883612800000000),
fresh AS (SELECT * FROM order_pairs WHERE created_us >= 883612800000000),
{views.history('held_features', 'held')}, {views.history('fresh_features', 'fresh')}
SELECT * FROM held_features UNION ALL SELECT * FROM fresh_features""")
def history_cache_refresh(spark, sf_dir):
    """Pairs created before 1998 are cached; the others form the next batch with its own bound."""
    pairs, own, commits = _tables(spark, sf_dir)
    held = pairs.where(F.col("issue_created_at") < F.lit("1998-01-01").cast("timestamp"))
    cache = new_table_path(spark, "history_cache")

    def compute(missing):
        return history.history_features(missing, own, commits)

    sinks.refresh_feature_cache(spark, cache, cache, held, compute)
    return tidy(sinks.refresh_feature_cache(spark, cache, cache, pairs, compute))


@query(f"""WITH {views.COMMIT_FILES}, {views.ORDER_PAIRS},
bounds AS (SELECT repo, min(created_us) - {fv.LOOKBACK_DAYS} * 86400000000 AS since_us FROM order_pairs
  WHERE created_us >= 820454400000000 GROUP BY ALL)
SELECT repo, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS commits,
  min(at_us) AS first_us, max(at_us) AS last_us
FROM commit_files JOIN bounds USING (repo) WHERE at_us >= since_us GROUP BY ALL""")
def file_history_deliveries(spark, sf_dir):
    """History of the files since the pairs of 1996 and later, from three deliveries.

    The second repeats half a year of the first, the third is late: commits of winter 1995 to 1996.
    """
    pairs, _, commits = _tables(spark, sf_dir)
    at = F.col("committed_at")
    late = at.between("1995-11-01", "1996-02-01")
    store = new_table_path(spark, "history_store")
    for number, part in enumerate([(at < "1997-01-01") & ~late, (at >= "1996-07-01") & ~late, late]):
        history_store.add_delivery(store, number, commits.where(part))
    bounds = history_store.bounds_of(pairs.where(F.col("issue_created_at") >= F.lit("1996-01-01").cast("timestamp")))
    files = history_store.file_history_since(spark, store, bounds)
    return files.select("repo", "path", "added", "deleted", "commits", F.unix_micros("first_seen").alias("first_us"),
                        F.unix_micros("last_modified").alias("last_us"))


_BEFORE_SQL = """past AS (
  SELECT p.repo, p.issue_number, o.path, created_us, CAST(coalesce(sum(c.added), 0) AS BIGINT) AS added,
    CAST(coalesce(sum(c.deleted), 0) AS BIGINT) AS deleted, count(c.path) AS commits, max(c.at_us) AS last_us
  FROM order_pairs p JOIN commit_files o ON o.repo = p.repo AND o.commit_id = p.issue_number
  LEFT JOIN commit_files c ON c.repo = o.repo AND c.path = o.path AND c.at_us < p.created_us GROUP BY ALL)"""


@query(f"""WITH {views.COMMIT_FILES}, {views.ORDER_PAIRS}, {_BEFORE_SQL}
SELECT repo, issue_number, path, added, deleted, commits, last_us FROM past""")
def file_history_before(spark, sf_dir):
    """Churn of the files of each pair before it was created."""
    pairs, own, commits = _tables(spark, sf_dir)
    past = history.history_before(own.join(pairs.select(*KEY, "issue_created_at"), KEY), commits)
    return past.withColumn("last_us", F.unix_micros("last_modified")).drop("last_modified")


@query(f"""WITH {views.COMMIT_FILES}, {views.ORDER_PAIRS}, {_BEFORE_SQL}
SELECT p.repo, p.issue_number, count(path) AS num_files, CAST(coalesce(sum(added), 0) AS BIGINT) AS churn_added_before,
  CAST(coalesce(sum(deleted), 0) AS BIGINT) AS churn_deleted_before, CAST(coalesce(sum(commits), 0) AS BIGINT) AS commits_before,
  coalesce(max(commits), 0) AS max_change_frequency_before, count(last_us) AS files_changed_before,
  round((any_value(p.created_us) - max(last_us)) / 8.64e10, 6) AS days_since_change
FROM order_pairs p LEFT JOIN past USING (repo, issue_number) GROUP BY ALL""")
def history_before(spark, sf_dir):
    """What was known of each pair's files when it was created."""
    return tidy(history.features_before(*_tables(spark, sf_dir)))


_SCORES_SQL = """vec AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
center AS (SELECT i, avg(v) AS m FROM vec GROUP BY i),
scores AS (
  SELECT vec_id, 1 - sum(v * m) / nullif(sqrt(sum(v * v)) * sqrt(sum(m * m)), 0) AS complexity_score
  FROM vec JOIN center USING (i) GROUP BY vec_id)"""


@query(f"""WITH {views.COMMIT_FILES}, {views.ORDER_PAIRS}, {views.history('features', 'order_pairs')}, {_SCORES_SQL},
{views.text_features('text_features', 'documents', 'doc_id', 'lang', 'text')}
SELECT f.*, round(duration_hours, 6) AS duration_hours, round(complexity_score, 6) AS complexity_score,
  text_length, word_count, cross_ref_density, ambiguity_index, technical_scope
FROM features f JOIN order_pairs USING (repo, issue_number)
JOIN text_features d ON d.doc_id = f.issue_number % (SELECT count(*) FROM documents)
JOIN scores v ON v.vec_id = f.issue_number % (SELECT count(*) FROM embeddings)""")
def model_features(spark, sf_dir):
    """All features of a pair side by side, joined by key."""
    return tidy(standins.feature_table(spark, sf_dir).select(
        *KEY, "duration_hours", *fv.TEXT_FEATURES, *fv.HISTORY_FEATURES))
