"""SQL of the stand-in views, shared by the SQL of the queries."""

from pacemark import fixed_values as fv
from pacemark.sources.standins import LABEL_WORDS

# the white space class in the notation of RE2
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def word_count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '[^{SPACE}]+')) AS BIGINT)"


def issues(name: str = "issues", end: str = "purchase") -> str:
    return f"""{name} AS (
  SELECT 'repo' || (e.user_id % 8) AS repo, e.event_id AS issue_number,
    epoch_us(e.ts) AS created_us,
    CASE WHEN e.value >= 100 THEN epoch_us(e.ts) + CAST(floor(e.value * 60e6) AS BIGINT) END AS assigned_us,
    min(epoch_us(b.ts)) AS merged_us, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k, e.value AS value
  FROM events e JOIN events b
    ON b.user_id = e.user_id AND b.ts > e.ts AND b.event_type = '{end}'
  WHERE e.event_type = 'error' GROUP BY ALL)"""


def pairs(name: str = "pairs", end: str = "purchase") -> str:
    return f"""{issues(name + '_issues', end)}, {name} AS (
  SELECT i.repo, i.issue_number, p.url AS issue_title,
    CASE WHEN i.value < 2 THEN NULL WHEN i.value < 5 THEN E' \\n\\t' ELSE d.text END AS issue_body,
    [{words(LABEL_WORDS)}[i.k % 10 + 1], d.lang] AS issue_labels,
    i.created_us, i.assigned_us, i.merged_us, i.k AS pr_number, 'change ' || i.k AS pr_title,
    CASE WHEN i.value >= 10 THEN d.lang END AS pr_body, i.k % 5 AS num_files_changed,
    list_transform(range(1, i.k % 5 + 1), lambda j: 'm' || ((i.issue_number + j) % 40) || '.py') AS files,
    (i.merged_us - coalesce(i.assigned_us, i.created_us)) / 3.6e9 AS duration_hours, i.value
  FROM {name}_issues i
  LEFT JOIN documents d ON d.doc_id = i.issue_number % (SELECT count(*) FROM documents)
  LEFT JOIN pages p ON p.page_id = i.issue_number % (SELECT count(*) FROM pages))"""


def holdout(repo: str = "repo", number: str = "issue_number") -> str:
    key = f"{repo} || '#' || {number} || '#{fv.SEED}'"
    return (f"CASE WHEN CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 100 < {fv.TEST_PERCENT} "
            "THEN 'test' ELSE 'train' END")


def fold(repo: str = "repo", number: str = "issue_number") -> str:
    key = f"{repo} || '#' || {number} || '#{fv.SEED}'"
    return f"CAST('0x' || substr(md5({key}), 9, 8) AS BIGINT) % {fv.FOLDS}"


BANDED = f"""{issues()}, banded AS (
  SELECT i.repo, i.issue_number, (i.merged_us - i.created_us) / 3.6e9 AS hours,
    least({word_count('d.text')} // 100, 9) AS band, {holdout('i.repo', 'i.issue_number')} AS split
  FROM issues i LEFT JOIN documents d ON d.doc_id = i.issue_number % (SELECT count(*) FROM documents))"""


def simple_predictions(rows: str, by: str = "") -> str:
    """The three estimators per ``by`` column over the CTE named by ``rows``."""
    b, on = (f"{by}, ", f"x.{by} = r.{by} AND ") if by else ("", "")
    where = f"WHERE x.{by} = r.{by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""train AS (SELECT * FROM {rows} WHERE split = 'train'),
by_repo AS (SELECT {b}repo, round(avg(hours), 2) AS a, round(quantile_cont(hours, 0.5), 2) AS b FROM train GROUP BY ALL),
by_band AS (SELECT {b}band, round(avg(hours), 2) AS c FROM train GROUP BY ALL),
overall AS (SELECT {b}round(avg(hours), 2) AS m FROM train {group}),
fitted AS (
  SELECT r.*, (SELECT m FROM overall x {where}) AS m, a, b, c FROM {rows} r
  LEFT JOIN by_repo x ON {on}x.repo = r.repo
  LEFT JOIN by_band y ON {on.replace('x.', 'y.')}y.band IS NOT DISTINCT FROM r.band),
predictions AS (
  SELECT {b}repo, issue_number, split, hours AS actual_hours, model, coalesce(p, m) AS predicted_hours
  FROM (SELECT *, 'A' AS model, a AS p FROM fitted UNION ALL SELECT *, 'B', b FROM fitted
        UNION ALL SELECT *, 'C', c FROM fitted)),
tested AS (
  SELECT *, abs(actual_hours - predicted_hours) AS abs_error,
    abs(actual_hours - predicted_hours) / greatest(actual_hours, 1e-6) AS rel_error
  FROM predictions WHERE split = 'test')"""


PREDICTIONS = f"""{BANDED}, bounded AS (SELECT * FROM banded WHERE hours BETWEEN 1 AND 2160),
{simple_predictions('bounded')}"""


def bucket(hours: str, buckets: list[tuple], rest: str | None) -> str:
    cases = " ".join(
        f"WHEN {hours} >= {low}" + (f" AND {hours} < {high}" if high is not None else "") + f" THEN '{label}'"
        for low, high, label in buckets)
    return f"CASE {cases}" + (f" ELSE '{rest}' END" if rest else " END")


def prediction_bucket(hours: str) -> str:
    return bucket(hours, fv.PREDICTION_BUCKETS, fv.PREDICTION_BUCKETS[-1][2])


def normal_p(z: str) -> str:
    """Two-sided normal p by Simpson's rule, since DuckDB has no error function."""
    return f"""greatest(0e0, 1e0 - 2e0 * abs({z}) / 2000 / 3 / sqrt(2e0 * pi()) * list_sum(list_transform(range(0, 2001),
    lambda i: (CASE WHEN i IN (0, 2000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)
      * exp(-0.5e0 * power(abs({z}) * i / 2000e0, 2)))))"""


def effect(delta: str) -> str:
    cases = " ".join(f"WHEN abs({delta}) < {bound} THEN '{label}'" for bound, label in fv.EFFECT_SIZES)
    return f"CASE {cases} ELSE '{fv.TOP_EFFECT_SIZE}' END"


def metrics(by: str) -> str:
    """CTEs ``plain`` and ``guess`` with all metrics per ``by``, over ``predictions`` and ``tested``."""
    using = f"USING ({by})"
    return f"""plain AS (
  SELECT {by}, count(*) AS n, avg(abs_error) AS mae, quantile_cont(abs_error, 0.5) AS mdae, avg(rel_error) AS mre,
    avg(CASE WHEN rel_error <= 0.25 THEN 1e0 ELSE 0e0 END) * 100 AS pred_25,
    avg(CASE WHEN rel_error <= 0.5 THEN 1e0 ELSE 0e0 END) * 100 AS pred_50,
    1 - avg(abs_error * abs_error) / nullif(var_pop(actual_hours), 0) AS r2
  FROM tested GROUP BY ALL),
distances AS (
  SELECT {by}, t.issue_number, avg(abs(t.actual_hours - r.actual_hours)) AS e,
    avg(power(t.actual_hours - r.actual_hours, 2)) AS e2
  FROM tested t JOIN (SELECT * FROM predictions WHERE split = 'train') r {using} GROUP BY ALL),
guess AS (SELECT {by}, avg(e) AS mae_p0, sqrt(sum(e2 - e * e)) / count(*) AS std_p0 FROM distances GROUP BY ALL),
measured AS (
  SELECT *, CASE WHEN mae_p0 = 0 THEN 0 ELSE (1 - mae / mae_p0) * 100 END AS sa,
    CASE WHEN mae_p0 = 0 OR std_p0 = 0 THEN 0 ELSE (mae_p0 - mae) / std_p0 END AS glass_delta
  FROM plain JOIN guess {using})"""


def paired(by: str = "") -> str:
    """CTEs ``paired`` (errors of two models) and ``signed`` (rank test) per ``by`` and models."""
    b = f"{by}, " if by else ""
    same = f"x.{by} = y.{by} AND " if by else ""
    xb = f"x.{by}, " if by else ""
    group = f"{b}model_1, model_2"
    return f"""paired AS (
  SELECT {xb}x.model AS model_1, y.model AS model_2, x.abs_error AS error_1, y.abs_error AS error_2
  FROM tested x JOIN tested y ON {same}x.repo = y.repo AND x.issue_number = y.issue_number AND x.model < y.model),
differences AS (SELECT *, error_1 - error_2 AS d FROM paired),
nonzero AS (SELECT {group}, d, abs(d) AS size FROM differences WHERE d <> 0),
ties AS (SELECT {group}, size, count(*) AS t FROM nonzero GROUP BY ALL),
tie_ranks AS (
  SELECT *, coalesce(sum(t) OVER (PARTITION BY {group} ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + (t + 1) / 2e0 AS r FROM ties),
signed_sums AS (
  SELECT {group}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus,
    CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus
  FROM nonzero JOIN tie_ranks USING ({group}, size) GROUP BY ALL),
tie_sums AS (SELECT {group}, sum(CAST(t AS DOUBLE) * t * t - t) AS tie FROM ties GROUP BY ALL),
zeros AS (SELECT {group}, count(*) FILTER (d = 0) AS zeros FROM differences GROUP BY ALL),
signed AS (
  SELECT {group}, CAST(n AS BIGINT) AS n, zeros, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
    (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - tie / 2) / 24) AS z
  FROM signed_sums JOIN tie_sums USING ({group}) JOIN zeros USING ({group}))"""


COMMIT_FILES = """commit_files AS (
  SELECT 'repo' || (o_custkey % 8) AS repo, o_orderkey AS commit_id, epoch_us(o_orderdate) AS at_us,
    's' || l_suppkey AS path, CAST(sum(l_quantity) AS BIGINT) AS added, count(*) AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""

ORDER_PAIRS = """order_pairs AS (
  SELECT 'repo' || (o_custkey % 8) AS repo, o_orderkey AS issue_number, epoch_us(o_orderdate) AS created_us,
    (epoch_us(max(l_shipdate)) - epoch_us(o_orderdate)) / 3.6e9 AS duration_hours
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate)"""


def edges(name: str, commits: str) -> str:
    return f"""{name}_small AS (
  SELECT repo, commit_id FROM {commits} GROUP BY ALL HAVING count(*) <= {fv.MAX_FILES_PER_COMMIT}),
{name} AS (
  SELECT repo, x.path AS source, y.path AS partner, count(*) AS n
  FROM {commits} x JOIN {commits} y USING (repo, commit_id)
  JOIN {name}_small USING (repo, commit_id) WHERE x.path <> y.path GROUP BY ALL)"""


def history(name: str, batch: str) -> str:
    """History features of the pairs in ``batch`` over ``commit_files``."""
    return f"""{name}_since AS (
  SELECT repo, min(created_us) - {fv.LOOKBACK_DAYS} * 86400000000 AS since FROM {batch} GROUP BY repo),
{name}_commits AS (
  SELECT c.* FROM commit_files c JOIN {name}_since USING (repo) WHERE at_us >= since),
{name}_own AS (
  SELECT b.repo, b.issue_number, b.created_us, c.path
  FROM {batch} b JOIN commit_files c ON c.repo = b.repo AND c.commit_id = b.issue_number),
{name}_files AS (
  SELECT repo, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted,
    count(*) AS commits, min(at_us) AS first_us
  FROM {name}_commits GROUP BY ALL),
{edges(name + '_edges', name + '_commits')},
{name}_churn AS (
  SELECT o.repo, o.issue_number, count(*) AS num_files,
    CAST(sum(coalesce(added, 0)) AS BIGINT) AS total_churn_added,
    CAST(sum(coalesce(deleted, 0)) AS BIGINT) AS total_churn_deleted,
    CAST(sum(coalesce(commits, 0)) AS BIGINT) AS total_churn_commits,
    avg(coalesce(greatest((created_us - first_us) / 86400e6, 0), 0)) AS avg_file_age_days,
    min(coalesce(greatest((created_us - first_us) / 86400e6, 0), 0)) AS min_file_age_days,
    max(coalesce(greatest((created_us - first_us) / 86400e6, 0), 0)) AS max_file_age_days,
    avg(coalesce(commits, 0)) AS avg_change_frequency, max(coalesce(commits, 0)) AS max_change_frequency
  FROM {name}_own o LEFT JOIN {name}_files f USING (repo, path) GROUP BY ALL),
{name}_partners AS (
  SELECT DISTINCT o.repo, o.issue_number, e.partner FROM {name}_own o
  JOIN {name}_edges e ON e.repo = o.repo AND e.source = o.path AND e.n >= {fv.MIN_SUPPORT}),
{name}_coupling AS (
  SELECT p.repo, p.issue_number, count(*) AS fan_in, count(*) FILTER (o.path IS NULL) AS fan_out
  FROM {name}_partners p LEFT JOIN {name}_own o
    ON o.repo = p.repo AND o.issue_number = p.issue_number AND o.path = p.partner GROUP BY ALL),
{name} AS (
  SELECT c.repo, c.issue_number, num_files, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
    total_churn_added, total_churn_deleted, total_churn_commits,
    round((total_churn_added + total_churn_deleted) / greatest(num_files, 1), 6) AS avg_churn_per_file,
    coalesce(fan_out, 0) AS change_impact_radius, round(avg_file_age_days, 6) AS avg_file_age_days,
    round(min_file_age_days, 6) AS min_file_age_days, round(max_file_age_days, 6) AS max_file_age_days,
    round(avg_change_frequency, 6) AS avg_change_frequency, max_change_frequency
  FROM {name}_churn c LEFT JOIN {name}_coupling USING (repo, issue_number))"""


def text_features(name: str, source: str, key: str, title: str, body: str) -> str:
    """CTE with the derived text features of each row of ``source``."""
    domains = " + ".join(f"CAST(list_has_any(terms, {words(ws)}) AS BIGINT)" for ws in fv.DOMAIN_KEYWORDS.values())
    patterns = ["#\\p{Nd}+", f"https?://[^{SPACE}]+", "[A-Z]+-\\p{Nd}+", "@[\\p{L}\\p{N}_]+"]
    refs = " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in patterns)
    return f"""{name}_texts AS (
  SELECT {key}, coalesce({title}, '') || ' ' || coalesce({body}, '') AS t FROM {source}),
{name}_terms AS (
  SELECT *, list_distinct(regexp_extract_all(lower(t), '[^{SPACE}]+')) AS terms, {word_count('t')} AS w FROM {name}_texts),
{name} AS (
  SELECT {key}, CAST(length(t) AS BIGINT) AS text_length, w AS word_count, CAST({refs} AS BIGINT) AS cross_ref_density,
    round(len(list_intersect(terms, {words(fv.VAGUE_TERMS)})) / greatest(w, 1), 6) AS ambiguity_index,
    {domains} AS technical_scope
  FROM {name}_terms)"""
