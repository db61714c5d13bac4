"""Linking and history features against plain Python on small fixtures."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.operators import cleaning, history, linking

DAY = dt.timedelta(days=1)
START = dt.datetime(2025, 1, 1)
PAIRS = "repo string, issue_number long, issue_created_at timestamp"
FILES = "repo string, issue_number long, path string"
COMMITS = "repo string, commit_id long, committed_at timestamp, path string, added long, deleted long"


def made_up(seed, hub=False):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(14)]
    pairs, files, commits = [], [], []
    for repo in ("r", "s"):
        for i in range(12):
            pairs.append((repo, i, START + rng.randint(0, 200) * DAY))
            for path in rng.sample(names + ["unknown"], rng.randint(0, 4)):
                files.append((repo, i, path))
        for c in range(60):
            at = START + rng.randint(-150, 250) * DAY
            touched = rng.sample(names, rng.randint(1, 6)) if c % 9 else names
            if hub and "f0" not in touched:
                touched.append("f0")
            commits += [(repo, c, at, p, rng.randint(0, 20), rng.randint(0, 9)) for p in touched]
    return pairs, files, commits


def expected(pairs, files, commits, lookback, support, max_files):
    out = {}
    for repo in {p[0] for p in pairs}:
        mine = [p for p in pairs if p[0] == repo]
        since = min(p[2] for p in mine) - lookback * DAY
        by_commit = defaultdict(list)
        for r, c, at, path, a, d in commits:
            if r == repo and at >= since:
                by_commit[c].append((at, path, a, d))
        churn, first, together = defaultdict(lambda: [0, 0, 0]), {}, defaultdict(Counter)
        for rows in by_commit.values():
            for at, path, a, d in rows:
                churn[path] = [churn[path][0] + a, churn[path][1] + d, churn[path][2] + 1]
                first[path] = min(first.get(path, at), at)
            if len(rows) <= max_files:
                for _, one, *_ in rows:
                    for _, two, *_ in rows:
                        if one != two:
                            together[one][two] += 1
        for _, number, created in mine:
            own = [f[2] for f in files if f[:2] == (repo, number)]
            partners = {p for f in own for p, n in together[f].items() if n >= support}
            sums = [sum(churn[f][k] if f in first else 0 for f in own) for k in range(3)]
            ages = [max((created - first[f]).total_seconds() / 86400, 0) if f in first else 0 for f in own] or [0]
            often = [churn[f][2] if f in first else 0 for f in own] or [0]
            out[repo, number] = (
                len(own), len(partners), len(partners - set(own)), *sums, (sums[0] + sums[1]) / max(len(own), 1),
                len(partners - set(own)), sum(ages) / len(ages), min(ages), max(ages), sum(often) / len(often), max(often))
    return out


@pytest.mark.parametrize("seed,files_ahead", [(1, 3), (2, 1), (3, 2), (4, 9)])
def test_features_match_plain_python(spark, monkeypatch, seed, files_ahead):
    monkeypatch.setattr(history.coupling, "__defaults__", (files_ahead,))
    pairs, files, commits = made_up(seed, hub=True)
    got = history.history_features(
        spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(files, FILES),
        spark.createDataFrame(commits, COMMITS), lookback_days=90, min_support=2, max_files=8)
    want = expected(pairs, files, commits, 90, 2, 8)
    rows = got.collect()
    assert len(rows) == len(want) == 24
    for r in rows:
        assert tuple(r[c] for c in fv.HISTORY_FEATURES) == pytest.approx(want[r.repo, r.issue_number])
        assert r.fan_out == r.change_impact_radius


@pytest.mark.parametrize("files_ahead", [1, 2, 5])
def test_coupling_of_common_files(spark, files_ahead):
    """Two files with many partners in a third of all pairs, one pair with very many files, repeated rows."""
    rng = random.Random(files_ahead)
    edges = {("r", a, f"p{i}") for a, n in (("h1", 400), ("h2", 300)) for i in rng.sample(range(500), n)}
    edges |= {("r", f"o{k}", p) for k in range(60) for p in rng.sample([f"p{i}" for i in range(500)] + ["h1", "o1", "o2"], 4)}
    edges |= {("s", "h1", "p1"), (None, "h1", "p2")}
    own = [("r", n, f) for n in range(60) for f in rng.sample([f"o{k}" for k in range(60)], 3) + (["h1", "h2"] if n % 3 == 0 else [])]
    own += [("r", 100, f"o{k}") for k in range(60)] + [("r", 100, "h2")] * 2 + [("r", 101, "alone"), ("s", 1, "h1"), ("t", 1, "h1")]
    want = {}
    for repo, number, _ in own:
        mine = {f for r, n, f in own if (r, n) == (repo, number)}
        partners = {p for r, f, p in edges if r == repo and f in mine}
        if partners:
            want[repo, number] = (len(partners), len(partners - mine))
    got = history.coupling(spark.createDataFrame(own, FILES), spark.createDataFrame(
        sorted(edges, key=repr), "repo string, source string, partner string").repartition(3), files_ahead)
    assert {(r.repo, r.issue_number): (r.fan_in, r.fan_out) for r in got.collect()} == want
    none = history.coupling(spark.createDataFrame([], FILES), spark.createDataFrame([], "repo string, source string, partner string"))
    assert none.collect() == []


def test_a_commit_of_any_size_is_a_short_list(spark):
    commits = spark.createDataFrame(
        [("r", 1, START, f"f{i}", 1, 0) for i in range(5000)] + [("r", c, START, p, 1, 0) for c in (2, 3) for p in "ab"]
        + [("r", None, START, p, 1, 0) for p in "ab"], COMMITS).repartition(4)
    edges = history.cochange_edges(commits, commits, max_files=2)
    assert rows_of(edges) == [("r", "a", "b", 3), ("r", "b", "a", 3)]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    # the limit is taken before commits are shuffled as well as after
    assert plan.count("WindowGroupLimit") >= 2


def test_edges_only_start_at_files_of_interest(spark):
    commits = spark.createDataFrame(
        [("r", c, START, p, 1, 1) for c in (1, 2) for p in ("a", "b", "c")] + [("r", 3, START, "a", 1, 1)], COMMITS)
    interest = spark.createDataFrame([("r", "a")], "repo string, path string")
    assert rows_of(history.cochange_edges(commits, interest)) == [("r", "a", "b", 2), ("r", "a", "c", 2)]
    assert rows_of(history.cochange_edges(commits, commits, min_support=3)) == []
    assert rows_of(history.cochange_edges(commits, commits, max_files=2)) == []


def test_mass_commits_count_for_churn_only(spark):
    commits = spark.createDataFrame([("r", 1, START, f"f{i}", 1, 0) for i in range(51)], COMMITS)
    assert history.file_history(commits).count() == 51
    assert history.cochange_edges(commits, commits).count() == 0


def test_pairs_without_files_get_zeros(spark):
    pairs = spark.createDataFrame([("r", 1, "", START), ("r", 2, None, START), ("r", 3, "a|b", START)],
                                  "repo string, issue_number long, pr_files_changed string, issue_created_at timestamp")
    files = history.files_of_pairs(pairs)
    assert rows_of(files) == [("r", 3, "a"), ("r", 3, "b")]
    commits = spark.createDataFrame([("r", 1, START, "a", 4, 2)], COMMITS)
    got = {r.issue_number: r for r in history.history_features(pairs, files, commits).collect()}
    assert all(got[n][c] == 0 for n in (1, 2) for c in fv.HISTORY_FEATURES)
    assert (got[3].num_files, got[3].total_churn_added, got[3].avg_churn_per_file) == (2, 4, 3.0)


def test_history_starts_a_lookback_before_the_first_pair(spark):
    pairs = spark.createDataFrame([("r", 1, START), ("s", 1, START + 365 * DAY)], PAIRS)
    commits = spark.createDataFrame(
        [(repo, i, START + shift * DAY, "a", 1, 1) for repo in "rst" for i, shift in enumerate((-91, -90, 0, 400))], COMMITS)
    assert rows_of(history.recent_commits(commits, pairs), "repo", "commit_id") == [
        ("r", 1), ("r", 2), ("r", 3), ("s", 3)]


def linked(spark):
    t = START
    issues = spark.createDataFrame(
        [("r", n, t, False) for n in range(1, 7)] + [("r", 9, t, True)],
        "repo string, issue_number long, issue_created_at timestamp, is_pull_request boolean")
    timeline = spark.createDataFrame([
        ("r", 1, 1, "cross-referenced", t, "r", 100, None),    # not merged
        ("r", 1, 2, "closed", t, None, None, 7),               # commit with two changes
        ("r", 1, 3, "cross-referenced", t, "r", 102, None),
        ("r", 2, 1, "cross-referenced", t, "other", 102, None),  # another repo's number
        ("r", 3, 1, "cross-referenced", t, "r", 102, None),
        ("r", 3, 2, "closed", t, None, None, 7),
        ("r", 3, 3, "assigned", t + 2 * DAY, None, None, None),
        ("r", 3, 4, "assigned", t + 1 * DAY, None, None, None),
        ("r", 9, 1, "cross-referenced", t, "r", 102, None),
    ], "repo string, issue_number long, event_order long, kind string, event_at timestamp, "
       "source_repo string, source_number long, commit_id long")
    pulls = spark.createDataFrame([
        ("r", 100, None, "open", "#4"), ("r", 101, t + 5 * DAY, "x", None), ("r", 102, t + 6 * DAY, "y", "see #2 and #22"),
        ("r", 103, t + 7 * DAY, "fixes #2, #5", ""), ("other", 104, t + 1 * DAY, "#6", "")],
        "repo string, pr_number long, pr_merged_at timestamp, pr_title string, pr_body string")
    commits = spark.createDataFrame([("r", 7, 100, 1), ("r", 7, 101, 2), ("r", 7, 102, 3)],
                                    "repo string, commit_id long, pr_number long, pull_order long")
    return issues, timeline, pulls, commits


def test_first_merged_change_in_timeline_order(spark):
    got = rows_of(linking.first_merged_change(*linked(spark)), "issue_number", "pr_number", "via")
    # 4 is only mentioned by an open change, 6 by another repo's, 9 is itself a change
    assert got == [(1, 101, "commit"), (2, 102, "mention"), (3, 102, "reference"), (5, 103, "mention")]


def test_duration_from_the_first_assignment(spark):
    got = {r.issue_number: r.duration_hours for r in linking.linked_pairs(*linked(spark)).collect()}
    assert got == {1: 120.0, 2: 144.0, 3: 120.0, 5: 168.0}


def test_linking_scans_the_timeline_once(spark, tmp_path):
    issues, timeline, pulls, commits = linked(spark)
    timeline.write.parquet(str(tmp_path / "timeline"))
    stored = spark.read.parquet(str(tmp_path / "timeline"))
    pairs = linking.linked_pairs(issues, stored, pulls, commits)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "event_order" in line for line in plan.splitlines()) == 1
    assert sorted(r.issue_number for r in pairs.collect()) == [1, 2, 3, 5]


def test_linking_of_odd_numbers_and_missing_values(spark):
    issues, timeline, pulls, commits = linked(spark)
    odd = spark.createDataFrame([
        ("r", 200, START + DAY, "closes #99999999999999999999999 and #0004", None), ("r", None, START + DAY, "#4", None),
        (None, 201, START + DAY, "#4", None)], pulls.schema)
    events = spark.createDataFrame([
        ("r", 6, 1, "cross-referenced", START, None, 102, None), ("r", 6, 2, "closed", START, None, None, None),
        ("r", 6, 3, "labeled", START, "r", 102, 7), (None, None, 1, "cross-referenced", START, None, None, None),
        # the same event twice
        ("r", 3, 1, "cross-referenced", START, "r", 102, None)], timeline.schema)
    got = rows_of(linking.first_merged_change(issues, timeline.union(events), pulls.union(odd), commits),
                  "issue_number", "pr_number", "via")
    assert got == [(1, 101, "commit"), (2, 102, "mention"), (3, 102, "reference"), (4, 200, "mention"), (5, 103, "mention")]
    none = linking.linked_pairs(issues, timeline.limit(0), pulls.limit(0), commits.limit(0))
    assert none.count() == 0


RAW = ("repo string, issue_number long, issue_title string, issue_body string, issue_labels array<string>, "
       "issue_created_at timestamp, pr_merged_at timestamp, num_files_changed long, duration_hours double, at long")


def raw(spark, **changes):
    base = dict(repo="r", issue_number=1, issue_title="t" * 20, issue_body="b" * 60, issue_labels=["bug"],
                issue_created_at=START, pr_merged_at=START + DAY, num_files_changed=1, duration_hours=24.0, at=1)
    rows = [{**base, "issue_number": i} for i in range(100, 112)] + [{**base, **c} for c in changes.values()]
    return spark.createDataFrame([tuple(r.values()) for r in rows], RAW)


def test_inclusion(spark):
    df = raw(spark, short=dict(issue_number=1, issue_title="x", issue_body=None),
             exact=dict(issue_number=2, issue_title="x" * 49, issue_body=""),
             label=dict(issue_number=3, issue_labels=["bug", "wontfix"]),
             case=dict(issue_number=4, issue_labels=["WontFix"]),
             none=dict(issue_number=5, issue_labels=None),
             fast=dict(issue_number=6, duration_hours=0.99), slow=dict(issue_number=7, duration_hours=2160.01),
             missing=dict(issue_number=8, duration_hours=None))
    kept = {n for (n,) in rows_of(cleaning.include_pairs(df), "issue_number")}
    assert kept == set(range(100, 112)) | {2, 4, 5}


def test_cleaning(spark):
    df = raw(spark, few=dict(repo="small"), blank=dict(issue_number=1, issue_body=" \n\t "),
             nofile=dict(issue_number=2, num_files_changed=0),
             again=dict(issue_number=100, at=0, pr_merged_at=START + 3 * DAY),
             backwards=dict(issue_number=3, pr_merged_at=START - DAY), null=dict(issue_number=4, issue_body=None))
    cleaned = cleaning.clean_pairs(df, ["at"])
    got = dict(rows_of(cleaned, "issue_number", "duration_hours"))
    assert got == {**{n: 24.0 for n in range(101, 112)}, 100: 72.0}
    summary = cleaning.cleaning_summary(df, cleaned).first()
    assert (summary.n_before, summary.n_after, summary.n_removed) == (18, 12, 6)
    assert cleaning.clean_pairs(df.where("issue_number < 109"), ["at"], recheck=True).count() == 0


def test_shares_come_largest_first(spark):
    shares = cleaning.repo_shares(raw(spark, few=dict(repo="small"))).collect()
    assert [(r.repo, r.n) for r in shares] == [("r", 12), ("small", 1)]
    assert sum(r.percent for r in shares) == pytest.approx(100)


def before(pairs, files, commits):
    out = Counter()
    for repo, number, path in files:
        created = next(p[2] for p in pairs if p[:2] == (repo, number))
        mine = [c for c in commits if c[0] == repo and c[3] == path and c[2] is not None and created is not None and c[2] < created]
        out[repo, number, path, sum(c[4] or 0 for c in mine), sum(c[5] or 0 for c in mine), len(mine),
            max((c[2] for c in mine), default=None)] += 1
    return out


@pytest.mark.parametrize("slot_days", [1, 7, 1000])
def test_history_before_the_pair(spark, slot_days):
    pairs, files, commits = made_up(3, hub=True)
    # a commit at the very time does not count; times and numbers may be missing; rows may repeat
    commits += [("r", 900, pairs[0][2], "f0", 7, 7), ("r", 901, None, "f0", 9, 9), ("r", 902, START - 400 * DAY, "f0", None, None)]
    pairs.append(("r", 99, None))
    files += [("r", 99, "f0"), ("r", 0, "f0"), ("r", 0, "f0")]
    own = spark.createDataFrame(files, FILES).join(spark.createDataFrame(pairs, PAIRS), ["repo", "issue_number"])
    past = history.history_before(own, spark.createDataFrame(commits, COMMITS).repartition(5), slot_days)
    got = Counter(tuple(r) for r in past.select("repo", "issue_number", "path", "added", "deleted", "commits", "last_modified").collect())
    assert got == before(pairs, files, commits)
    # a file in a third of all commits is spread over its slots
    hot = sum(c[3] == "f0" for c in commits)
    assert hot > len({c[:2] for c in commits}) / 3


def test_features_before_the_pair(spark):
    pairs = spark.createDataFrame([("r", 1, START), ("r", 2, START), ("r", 3, None)], PAIRS)
    files = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 3, "a")], FILES)
    commits = spark.createDataFrame([("r", 1, START - 2 * DAY, "a", 3, 1), ("r", 2, START - DAY / 2, "a", 1, 1),
                                     ("r", 3, START, "b", 5, 5), ("s", 4, START - DAY, "b", 5, 5)], COMMITS)
    got = {r.issue_number: r for r in history.features_before(pairs, files, commits).collect()}
    one = got[1]
    assert (one.num_files, one.churn_added_before, one.churn_deleted_before, one.commits_before, one.files_changed_before,
            one.max_change_frequency_before, one.days_since_change) == (2, 4, 2, 2, 1, 2, 0.5)
    assert (got[2].num_files, got[2].commits_before, got[2].days_since_change) == (0, 0, None)
    assert (got[3].num_files, got[3].commits_before) == (1, 0)
    assert history.features_before(pairs.limit(0), files, commits).collect() == []


def test_stream_of_history_before_moves_once(spark):
    own = spark.createDataFrame([("r", 1, "a")], "repo string, issue_number long, path string").withColumn(
        "issue_created_at", F.lit("2024-01-02").cast("timestamp"))
    commits = spark.createDataFrame([("r", "a", 1, 2)], "repo string, path string, added long, deleted long").withColumn(
        "committed_at", F.lit("2023-01-02").cast("timestamp"))
    past = history.history_before(own, commits)
    assert "Join" not in past._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.added, r.deleted, r.commits) for r in past.collect()] == [(1, 2, 1)]


def test_tasks_of_the_coupling_follow_the_rows(spark, monkeypatch):
    commits = spark.createDataFrame([("r", i, f"f{(i * k) % 90}") for i in range(100) for k in (1, 2, 3)],
                                    "repo string, commit_id long, path string")
    plain = {(a, b): n for a, b, n in rows_of(history.cochange_edges(commits, commits), "source", "partner", "n")}
    setting = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    before = {k: spark.conf.get(k) for k in setting}
    monkeypatch.setattr(history, "ROWS_PER_TASK", 10)
    try:
        for k, v in setting.items():
            spark.conf.set(k, v)
        edges = history.stored_edges(commits, commits)
        assert {k: spark.conf.get(k) for k in setting} == setting
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(edges.inputFiles()) > 8
    assert {(a, b): n for a, b, n in rows_of(edges, "source", "partner", "n")} == plain
