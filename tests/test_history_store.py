"""Stored daily sums against the history computed from all commits at once."""

import datetime as dt
import random

import pytest
from conftest import rows_of

from pacemark.operators import history
from pacemark.sources import history_store

DAY = dt.timedelta(days=1)
START = dt.datetime(2025, 1, 1)
PAIRS = "repo string, issue_number long, issue_created_at timestamp"
COMMITS = "repo string, commit_id long, committed_at timestamp, path string, added long, deleted long"


@pytest.fixture
def commits():
    rng = random.Random(5)
    rows = []
    for c in range(150):
        repo, at = rng.choice("rs"), START + rng.random() * 120 * DAY
        # one file is part of every third commit; some numbers are missing
        paths = rng.sample([f"f{i}" for i in range(1, 8)], 2) + ["f0"] * (c % 3 == 0)
        rows += [(repo, c, at, p, rng.choice([None, 1, 5]), rng.randint(0, 3)) for p in paths]
    return rows


def test_three_deliveries_equal_all_commits_at_once(spark, tmp_path, commits):
    store = str(tmp_path / "store")
    at = sorted(r[2] for r in commits)
    early, late = at[len(at) // 3], at[len(at) // 2]
    parts = [[r for r in commits if r[2] < early] + [("r", 999, None, "f0", 1, 1)],
             # part of the first delivery comes again
             [r for r in commits if r[2] >= late] + [r for r in commits if r[2] < early][:20],
             [r for r in commits if early <= r[2] < late]]
    for number, part in enumerate(parts):
        frame = spark.createDataFrame(part, COMMITS)
        history_store.add_delivery(store, number, frame.union(frame.limit(3)))
    history_store.add_delivery(store, 3, spark.createDataFrame([], COMMITS))
    # run again after a failure
    history_store.add_delivery(store, 2, spark.createDataFrame(parts[2], COMMITS))
    everything = spark.createDataFrame(commits, COMMITS)
    assert spark.read.parquet(store + "/commits").count() == len(commits)
    # bounds fall inside a day, differ by repo, and one repo has none
    pairs = spark.createDataFrame([("r", 1, START + 50.6 * DAY), ("r", 2, START + 80 * DAY), ("s", 1, START + 30.3 * DAY),
                                   ("t", 1, START)], PAIRS)
    for days in (0, 20, 400):
        want = history.file_history(history.recent_commits(everything, pairs, days))
        got = history_store.file_history_since(spark, store, history_store.bounds_of(pairs, days))
        assert rows_of(got) == rows_of(want.select(*got.columns)) != []


def test_a_delivery_touches_its_own_spans(spark, tmp_path, commits):
    store = str(tmp_path / "store")
    history_store.add_delivery(store, 0, spark.createDataFrame(commits, COMMITS))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    history_store.add_delivery(store, 1, spark.createDataFrame([("r", 1000, START + 3 * DAY, "f0", 2, 2)], COMMITS))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert before.items() <= after.items()
    added = {str(p.parent.relative_to(tmp_path / "store")) for p in after.keys() - before.keys()}
    span = ((START - dt.datetime(1970, 1, 1)).days + 3) // history_store.SPAN_DAYS
    assert added == {f"{t}/span={span}/delivery=1" for t in ("commits", "sums")}
