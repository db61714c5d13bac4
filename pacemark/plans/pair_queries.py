"""Linking, filtering, cleaning, merging and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacemark.functions import durations, parsing
from pacemark.operators import cleaning, keys, linking, repos, scoring
from pacemark.plans import views
from pacemark.plans.registry import query, tidy
from pacemark.session import written
from pacemark.sources import standins
from pacemark.sources.readers import read_table
from pacemark.sources.schemas import KEY

_SPLIT_DATE = "2024-01-11"
_SPLIT_US = 1_704_931_200_000_000


@query(f"""WITH {views.issues()}
SELECT repo, issue_number, created_us, assigned_us, merged_us,
  round((merged_us - coalesce(assigned_us, created_us)) / 3.6e9, 6) AS duration_hours,
  round((merged_us - created_us) / 3.6e9, 6) AS standard_hours
FROM issues""")
def pairs_first_resolution(spark, sf_dir):
    rows = standins.issue_events(spark, sf_dir)
    created, assigned, merged = (F.col(c) for c in ("issue_created_at", "issue_assigned_at", "pr_merged_at"))
    return tidy(rows.select(
        *KEY, F.unix_micros(created).alias("created_us"), F.unix_micros(assigned).alias("assigned_us"),
        F.unix_micros(merged).alias("merged_us"),
        durations.duration_hours(created, assigned, merged).alias("duration_hours"),
        durations.hours_between(created, merged).alias("standard_hours")))


_LINK_SQL = """issues AS (
  SELECT 'repo' || (o_custkey % 8) AS repo, o_orderkey AS issue_number, epoch_us(o_orderdate) AS created_us
  FROM orders WHERE o_orderstatus <> 'P'),
pulls AS (
  SELECT 'repo' || (p_partkey % 8) AS repo, p_partkey AS pr_number, p_size AS commit_id, p_retailprice,
    1009843200000000 + p_size * 86400000000 AS merged_us, p_partkey * 7 AS mentions
  FROM part WHERE p_type <> 'ECONOMY'),
timeline AS (
  SELECT i.repo, i.issue_number, l.* FROM issues i JOIN lineitem l ON l.l_orderkey = i.issue_number),
commits AS (
  SELECT repo, commit_id, arg_min(pr_number, (p_retailprice, pr_number)) AS pr_number FROM pulls GROUP BY ALL),
links AS (
  SELECT t.repo, t.issue_number, 0 AS late, l_linenumber, l_shipdate, l_partkey, l_suppkey, p.pr_number, 'reference' AS via
  FROM timeline t JOIN pulls p ON p.pr_number = t.l_partkey AND p.repo = t.repo WHERE l_returnflag = 'A'
  UNION ALL
  SELECT t.repo, t.issue_number, 0, l_linenumber, l_shipdate, l_partkey, l_suppkey, c.pr_number, 'commit'
  FROM timeline t JOIN commits c ON c.commit_id = CAST(t.l_quantity AS BIGINT) AND c.repo = t.repo
  WHERE l_returnflag = 'N'
  UNION ALL
  SELECT i.repo, i.issue_number, 1, NULL, NULL, NULL, NULL, min(p.pr_number), 'mention'
  FROM issues i JOIN pulls p ON p.mentions = i.issue_number AND p.repo = i.repo GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY repo, issue_number
    ORDER BY late, l_linenumber, l_shipdate, l_partkey, l_suppkey, pr_number, via) AS place FROM links),
assigned AS (
  SELECT repo, issue_number, min(epoch_us(l_shipdate)) AS assigned_us FROM timeline
  WHERE l_returnflag = 'R' GROUP BY ALL)"""


@query(f"""WITH {_LINK_SQL}
SELECT b.repo, b.issue_number, b.pr_number, b.via, assigned_us, merged_us,
  round((merged_us - coalesce(assigned_us, created_us)) / 3.6e9, 6) AS duration_hours
FROM best b JOIN issues USING (repo, issue_number) JOIN pulls p USING (repo, pr_number)
LEFT JOIN assigned a ON a.repo = b.repo AND a.issue_number = b.issue_number WHERE place = 1""")
def pairs_linked(spark, sf_dir):
    linked = linking.linked_pairs(*standins.link_tables(spark, sf_dir))
    return tidy(linked.select(
        *KEY, "pr_number", "via", F.unix_micros("issue_assigned_at").alias("assigned_us"),
        F.unix_micros("pr_merged_at").alias("merged_us"), "duration_hours"))


@query(f"""WITH {_LINK_SQL}
SELECT repo, issue_number, assigned_us FROM assigned""")
def issue_assignment(spark, sf_dir):
    issues, timeline, _, _ = standins.link_tables(spark, sf_dir)
    open_issues = issues.where(~F.col("is_pull_request")).select(*KEY)
    first = linking.first_assigned(timeline).join(open_issues, KEY, "left_semi")
    return first.select(*KEY, F.unix_micros("issue_assigned_at").alias("assigned_us"))


@query(f"""WITH {views.pairs()}
SELECT repo, issue_number, round(duration_hours, 6) AS duration_hours FROM pairs
WHERE length(coalesce(issue_title, '') || ' ' || coalesce(issue_body, '')) >= 50
  AND duration_hours BETWEEN 1 AND 2160
  AND NOT list_has_any(issue_labels, ['duplicate', 'wontfix', 'invalid', 'question'])""")
def pairs_filtered(spark, sf_dir):
    return tidy(cleaning.include_pairs(standins.pairs(spark, sf_dir)).select(*KEY, "duration_hours"))


def _collected(spark, sf_dir):
    """The same issues as two collectors found them: merged by purchase, or by signup."""
    first = standins.pairs(spark, sf_dir).withColumn("source", F.lit(0).cast("long"))
    second = standins.pairs(spark, sf_dir, "signup").withColumn("source", F.lit(1).cast("long"))
    return first.unionByName(second)


_COLLECTED_SQL = f"""{views.pairs('first')}, {views.pairs('second', 'signup')},
collected AS (SELECT *, 0 AS source FROM first UNION ALL SELECT *, 1 FROM second),
kept AS (
  SELECT * FROM collected WHERE repo IN (SELECT repo FROM collected GROUP BY repo HAVING count(*) >= 10)
    AND regexp_matches(coalesce(issue_body, ''), '[^{views.SPACE}]') AND num_files_changed > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, issue_number ORDER BY source) AS place FROM kept),
cleaned AS (SELECT *, (merged_us - created_us) / 3.6e9 AS hours FROM numbered WHERE place = 1 AND merged_us > created_us)"""


@query(f"""WITH {_COLLECTED_SQL}
SELECT repo, issue_number, CAST(source AS BIGINT) AS source, round(hours, 6) AS duration_hours FROM cleaned""")
def pairs_cleaned(spark, sf_dir):
    cleaned = cleaning.clean_pairs(_collected(spark, sf_dir), ["source"])
    return tidy(cleaned.select(*KEY, "source", "duration_hours"))


@query(f"""WITH {_COLLECTED_SQL}, counts AS (
  SELECT (SELECT count(*) FROM collected) AS n_before, (SELECT count(*) FROM cleaned) AS n_after)
SELECT n_before, n_after, n_before - n_after AS n_removed,
  round((n_before - n_after) * 100e0 / n_before, 6) AS removed_percent FROM counts""")
def cleaning_summary(spark, sf_dir):
    columns = [*KEY, "source", "issue_body", "num_files_changed", "issue_created_at", "pr_merged_at"]
    collected = written(_collected(spark, sf_dir).select(*columns), "collected")
    return tidy(cleaning.cleaning_summary(collected, cleaning.clean_pairs(collected, ["source"])))


@query(f"""WITH {views.issues()}
SELECT repo, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS percent
FROM issues GROUP BY repo""")
def repo_shares(spark, sf_dir):
    return tidy(cleaning.repo_shares(standins.issue_events(spark, sf_dir)))


_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _line_batches(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select(*_LINE_KEY, *_LINE_ORDER)
    held = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    return lines.where(held), lines.where(~held)


def _line_sql(source_order: str, direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in _LINE_ORDER)
    return f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY (l_shipdate >= TIMESTAMP '1999-01-01') {source_order}, {order}) AS place FROM lineitem) WHERE place = 1"""


@query(_line_sql("ASC", "ASC"))
def merge_keep_first(spark, sf_dir):
    held, new = _line_batches(spark, sf_dir)
    return tidy(keys.existing_wins(held, new, _LINE_KEY, _LINE_ORDER).drop("l_shipdate"))


@query(_line_sql("DESC", "DESC"))
def cache_keep_last(spark, sf_dir):
    held, new = _line_batches(spark, sf_dir)
    return tidy(keys.newest_wins(held, new, _LINE_KEY, _LINE_ORDER).drop("l_shipdate"))


def _seen_log(pairs):
    """Issues looked at so far, with what came of each."""
    seen = pairs.where(F.col("issue_created_at") < F.lit(_SPLIT_DATE).cast("timestamp"))
    outcome = (F.when(F.col("value") < 20, "failed").when(F.col("num_files_changed") == 0, "rejected")
               .otherwise("kept"))
    return seen.select(*KEY, outcome.alias("outcome"))


_SEEN_SQL = f"""{views.issues()}, log AS (
  SELECT repo, issue_number, CASE WHEN value < 20 THEN 'failed' WHEN k % 5 = 0 THEN 'rejected' ELSE 'kept' END AS outcome
  FROM issues WHERE created_us < {_SPLIT_US}),
fresh AS (
  SELECT * FROM issues i WHERE NOT EXISTS (
    SELECT 1 FROM log l WHERE l.repo = i.repo AND l.issue_number = i.issue_number AND l.outcome <> 'failed'))"""


@query(f"""WITH {_SEEN_SQL} SELECT repo, issue_number FROM fresh""")
def ingest_new_only(spark, sf_dir):
    pairs = standins.issue_events(spark, sf_dir)
    return keys.only_new(pairs, keys.settled(_seen_log(pairs)), KEY).select(*KEY)


@query(f"""WITH {_SEEN_SQL}
SELECT DISTINCT repo, issue_number FROM (SELECT repo, issue_number FROM log UNION ALL SELECT repo, issue_number FROM fresh)""")
def checked_log_union(spark, sf_dir):
    pairs = standins.issue_events(spark, sf_dir)
    log = _seen_log(pairs)
    return keys.key_union(log, keys.only_new(pairs, keys.settled(log), KEY), key=KEY)


_QUOTA = 200
_HELD_UNTIL, _HELD_UNTIL_US = "2024-01-03", 1_704_240_000_000_000
_ALLOWED_MIN = 225


@query(f"""WITH {views.issues()},
allowed AS (SELECT repo FROM issues GROUP BY repo HAVING count(*) >= {_ALLOWED_MIN}),
held AS (SELECT repo, count(*) AS held FROM issues WHERE created_us < {_HELD_UNTIL_US} GROUP BY repo),
new AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY merged_us DESC, issue_number) AS place
  FROM issues WHERE created_us >= {_HELD_UNTIL_US})
SELECT n.repo, n.issue_number, n.merged_us FROM new n LEFT JOIN held USING (repo)
WHERE place <= greatest({_QUOTA} - coalesce(held, 0), 0)
  AND (n.repo IN (SELECT repo FROM allowed) OR NOT EXISTS (SELECT 1 FROM allowed))""")
def quota_per_repo(spark, sf_dir):
    pairs = standins.issue_events(spark, sf_dir).select(*KEY, "issue_created_at", "pr_merged_at")
    held = pairs.where(F.col("issue_created_at") < F.lit(_HELD_UNTIL).cast("timestamp"))
    allowed = pairs.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") >= _ALLOWED_MIN)
    candidates = keys.only_listed(
        pairs.where(F.col("issue_created_at") >= F.lit(_HELD_UNTIL).cast("timestamp")), allowed, ["repo"])
    quota = keys.remaining_quota(pairs.select("repo").distinct(), held, _QUOTA)
    taken = keys.fill_quota(candidates, quota, "pr_merged_at", ["issue_number"], _QUOTA)
    return taken.select(*KEY, F.unix_micros("pr_merged_at").alias("merged_us"))


@query("""WITH stats AS (
  SELECT n_name AS repo, count(*) FILTER (o_orderstatus = 'F') AS total_closed_issues,
    least(count(DISTINCT o_custkey), 11) AS contributor_count, min(o_orderdate) AS started
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
flags AS (
  SELECT *, floor((epoch_us(TIMESTAMP '1998-01-03') - epoch_us(started)) / 86400e6) / 365.25e0 AS years FROM stats)
SELECT repo, total_closed_issues, contributor_count, round(years, 1) AS age_years,
  total_closed_issues >= 200 AS meets_issue_threshold, contributor_count >= 10 AS meets_contributor_threshold,
  years >= 3 AS meets_age_threshold,
  total_closed_issues >= 200 AND contributor_count >= 10 AND years >= 3 AS passes_all FROM flags""")
def repo_validation_flags(spark, sf_dir):
    statistics = repos.inclusion_statistics(standins.repo_activity(spark, sf_dir))
    today = F.lit("1998-01-03").cast("timestamp")
    return tidy(repos.inclusion_flags(statistics, today, min_closed=200))


@query(f"""WITH {views.pairs()}
SELECT repo, issue_number, repo || '#' || issue_number AS item_key,
  array_to_string(files, '|') AS files_text, CAST(len(files) AS BIGINT) AS n_files,
  CAST(len(list_filter(string_split(array_to_string(files, '|') || '||', '|'), lambda x: x <> '')) AS BIGINT) AS n_named,
  CASE WHEN len(files) = 0 THEN 0 ELSE CAST(len(string_split(array_to_string(files, '|'), '|')) AS BIGINT) END AS n_decoded,
  CAST(len(list_filter(list_transform(string_split(array_to_string(files, ' ,, '), ','), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_listed
FROM pairs""")
def file_lists(spark, sf_dir):
    rows = standins.pairs(spark, sf_dir).select(*KEY, "pr_files_changed")
    text = parsing.join_list(F.col("pr_files_changed"))
    return tidy(rows.select(
        *KEY, parsing.item_key(F.col("repo"), F.col("issue_number")).alias("item_key"),
        text.alias("files_text"), F.size("pr_files_changed").alias("n_files"),
        F.size(parsing.split_list(F.concat(text, F.lit("||")))).alias("n_named"),
        F.size(parsing.split_list(text, keep_blank=True)).alias("n_decoded"),
        F.size(parsing.comma_list(F.array_join("pr_files_changed", " ,, "))).alias("n_listed")))


@query("""SELECT p_partkey, replace(replace(p_brand || '/' || p_name, '/', '__'), ' ', '_') AS slug FROM part""")
def encoder_slugs(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part")
    name = parsing.full_name(F.col("p_brand"), F.col("p_name"))
    return parts.select("p_partkey", parsing.encoder_slug(name).alias("slug"))


@query("""WITH tidy AS (SELECT page_id, regexp_replace(trim(url), '/+$', '') AS url FROM pages),
parts AS (
  SELECT page_id, string_split(CASE WHEN contains(url, 'example.com')
    THEN string_split(url, 'example.com/')[-1] ELSE url END, '/') AS p FROM tidy)
SELECT page_id, CASE WHEN len(p) >= 2 THEN p[1] END AS owner,
  CASE WHEN len(p) >= 2 THEN replace(p[2], '.git', '') END AS name FROM parts""")
def url_parts(spark, sf_dir):
    found = parsing.owner_and_name(F.col("url"), "example.com")
    return (read_table(spark, sf_dir, "pages").select("page_id", found.alias("found"))
            .select("page_id", "found.owner", "found.name"))


@query("""WITH chosen AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN 'bug_fix' WHEN 'view' THEN 'documentation'
    WHEN 'click' THEN 'refactor' WHEN 'purchase' THEN 'test_addition' ELSE event_type END AS category FROM events)
SELECT event_id, category, label, typical_hours FROM chosen LEFT JOIN (VALUES
  ('bug_fix', 'Bug fix', '2–8h'), ('documentation', 'Documentation', '1–4h'),
  ('refactor', 'Refactor / cleanup', '4–16h'), ('small_feature', 'Small feature', '8–24h'),
  ('test_addition', 'Test addition', '2–6h'), ('config_change', 'Config change', '1–3h'))
  c(category, label, typical_hours) USING (category)""")
def category_lookup(spark, sf_dir):
    kind = F.col("event_type")
    chosen = (F.when(kind == "error", "bug_fix").when(kind == "view", "documentation")
              .when(kind == "click", "refactor").when(kind == "purchase", "test_addition").otherwise(kind))
    rows = read_table(spark, sf_dir, "events").select("event_id", chosen.alias("category"))
    return scoring.with_category(rows).select("event_id", "category", "label", "typical_hours")
