"""Readers, sinks, caches and streams on real files."""

import datetime as dt
import json
import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pacemark.session import ensure_checkpoint_dir, new_table_path, shared_folder
from pacemark.sources import readers, schemas, sinks, standins
from pacemark.streaming import ingest

START = dt.datetime(2025, 1, 1)


def pair_rows(spark, numbers=(1, 2), repo="r"):
    rows = [(repo, n, 'a "quoted", title', "line one\nline two, with comma", "bug|docs", START, None, 7, "t", None,
             START + dt.timedelta(days=2), "a.py|b.py", 2, 48.0) for n in numbers]
    return spark.createDataFrame(rows, schemas.ISSUE_PAIRS)


def test_pairs_survive_csv(spark, tmp_path):
    df = pair_rows(spark)
    sinks.write_csv(df, str(tmp_path / "issue_pr_pairs.csv"))
    back = readers.read_pairs(spark, str(tmp_path))
    assert back.schema == schemas.ISSUE_PAIRS and rows_of(back) == rows_of(df)


def test_features_fall_back_to_csv(spark, tmp_path):
    sinks.write_csv(spark.range(3).withColumn("x", F.col("id") / 2), str(tmp_path / "features.csv"))
    assert rows_of(readers.read_named(spark, str(tmp_path), "features"), "x") == [(0.0,), (0.5,), (1.0,)]


def test_parquet_is_preferred_and_nothing_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="issue_pr_pairs.csv"):
        readers.read_pairs(spark, str(tmp_path))
    pair_rows(spark, (1,)).write.csv(str(tmp_path / "issue_pr_pairs.csv"), header=True)
    pair_rows(spark, (1, 2)).write.parquet(str(tmp_path / "issue_pr_pairs.parquet"))
    assert readers.read_pairs(spark, str(tmp_path)).count() == 2


def test_partner_formats(spark, tmp_path):
    pair_rows(spark).write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "p.xlsx").write_text("x")
    assert readers.read_partner(spark, str(tmp_path / "p.parquet")).count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_partner(spark, str(tmp_path / "p.xlsx"))
    with pytest.raises(FileNotFoundError):
        readers.read_partner(spark, str(tmp_path / "none.csv"))


def test_validation_list(spark, tmp_path):
    path = tmp_path / "validation.json"
    path.write_text(json.dumps([{"repo": "a/b", "passes_all": True}, {"repo": "c/d", "passes_all": False}]))
    validation = readers.read_json(spark, str(path), schemas.VALIDATION)
    assert rows_of(readers.valid_repos(validation)) == [("a/b",)]
    path.write_text('[\n<<<<<<< HEAD\n{"repo": "a/b"}\n=======\n]')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_json(spark, str(path), schemas.VALIDATION).collect()


def test_checked_log(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps({"checked": [1, 2], "count": 2, "last_updated": "2025-01-01T10:00:00"}))
    log = readers.read_checked_log(spark, str(tmp_path / "log.json"), "r")
    assert rows_of(log, "repo", "issue_number") == [("r", 1), ("r", 2)]
    log.write.parquet(str(tmp_path / "keys"))
    new = spark.createDataFrame([("r", 2, START), ("r", 3, START), ("r", 3, START)], log.schema)
    sinks.append_checked(spark.read.parquet(str(tmp_path / "keys")), new, str(tmp_path / "keys"))
    assert rows_of(spark.read.parquet(str(tmp_path / "keys")), "issue_number") == [(1,), (2,), (3,)]


def test_partial_saves_replace_one_repo(spark, tmp_path):
    path = str(tmp_path / "partial")
    sinks.save_partial_pairs(pair_rows(spark, (1, 2), "r").unionByName(pair_rows(spark, (1,), "s")), path)
    sinks.save_partial_pairs(pair_rows(spark, (1, 2, 3), "s"), path)
    counts = {r.repo: r["count"] for r in spark.read.parquet(path).groupBy("repo").count().collect()}
    assert counts == {"r": 2, "s": 3}


def test_features_of_several_encoders(spark, tmp_path):
    path = str(tmp_path / "features")
    for name, n in (("one", 2), ("two", 3)):
        sinks.save_encoder_features(spark.range(n).withColumn("encoder", F.lit(name)), path)
    one = readers.read_features(spark, path, "one")
    assert one.columns == ["id"] and one.count() == 2
    assert "PartitionFilters: [isnotnull(encoder" in one._jdf.queryExecution().executedPlan().toString()


def test_versions_never_overwrite(spark, tmp_path):
    sinks.write_version(spark.range(3), str(tmp_path), 1)
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_version(spark.range(1), str(tmp_path), 1)


def test_feature_cache_computes_only_what_is_missing(spark, tmp_path):
    asked = []

    def compute(missing):
        asked.append(rows_of(missing, "issue_number"))
        return missing.select("repo", "issue_number", (F.col("issue_number") * 10).alias("x"))

    first = sinks.refresh_feature_cache(spark, str(tmp_path / "none"), str(tmp_path / "v1"), pair_rows(spark, (1, 2)), compute)
    assert rows_of(first, "repo", "issue_number", "x") == [("r", 1, 10), ("r", 2, 20)]
    second = sinks.refresh_feature_cache(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), pair_rows(spark, (2, 3)), compute)
    assert rows_of(second, "repo", "issue_number", "x") == [("r", 2, 20), ("r", 3, 30)]
    assert asked[1] == [(3,)] and spark.read.parquet(str(tmp_path / "v2")).count() == 3
    before = set((tmp_path / "v2").rglob("*.parquet"))
    third = sinks.refresh_feature_cache(spark, str(tmp_path / "v2"), str(tmp_path / "v2"), pair_rows(spark, (3, 4, 4)), compute)
    assert rows_of(third, "repo", "issue_number", "x") == [("r", 3, 30), ("r", 4, 40)]
    assert asked[2] == [(4,)] and before < set((tmp_path / "v2").rglob("*.parquet"))


def test_predictions_metrics_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, "A", "test", 0, 1.0, 2.0), ("r", 2, "A", "train", 0, 1.0, 2.0)], schemas.PREDICTIONS)
    sinks.write_predictions(df, str(tmp_path / "p"))
    tested = readers.read_predictions(spark, str(tmp_path / "p"), "test")
    assert rows_of(tested, "issue_number") == [(1,)]
    sinks.write_metrics(df.select("model", "actual_hours"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    sinks.write_report(df.select("model"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["model"]


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_table_path(spark, "x").startswith(shared_folder(spark))
    assert new_table_path(spark, "x") != new_table_path(spark, "x")
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_stream_ingest_over_several_batches(spark, tmp_path):
    schema = "repo string, issue_number long, at long, v string"
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("inbox", "target", "checkpoint"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        arrivals = ingest.read_arrivals(spark, inbox, schema, max_files=1)
        ingest.start_ingest(arrivals, target, checkpoint, ["repo", "issue_number"], ["at"]).awaitTermination()
        return rows_of(spark.read.parquet(target), "issue_number", "v")

    arrive([("r", 1, 2, "late copy"), ("r", 1, 1, "first"), ("r", 2, 1, "two")])
    assert run() == [(1, "first"), (2, "two")]
    arrive([("r", 1, 0, "seen before"), ("r", 3, 1, "three")])
    arrive([("r", 3, 0, "seen too"), ("r", 4, 1, "four")])
    assert run() == [(1, "first"), (2, "two"), (3, "three"), (4, "four")]
    assert run() == [(1, "first"), (2, "two"), (3, "three"), (4, "four")]


def test_a_repeated_batch_writes_the_same_rows(spark, tmp_path):
    target = str(tmp_path / "target")
    schema = "repo string, issue_number long, at long"
    one = spark.createDataFrame([("r", 1, 1)], schema)
    two = spark.createDataFrame([("r", 1, 9), ("r", 2, 1)], schema)
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        ingest.ingest_batch(batch, number, target, ["repo", "issue_number"], ["at"])
    assert rows_of(spark.read.parquet(target), "issue_number", "at") == [(1, 1), (2, 1)]


def test_a_batch_reads_only_the_parts_it_touches(spark, tmp_path):
    target = str(tmp_path / "target")
    schema = "repo string, issue_number long, at long"
    large = spark.createDataFrame([("r", i, 0) for i in range(400)], schema)
    ingest.ingest_batch(large, 0, target, ["repo", "issue_number"], ["at"])
    small = spark.createDataFrame([("r", 7, 1), ("r", 1000, 1), ("r", 1000, 2)], schema)
    part = ingest.key_part(["repo", "issue_number"])
    touched = sorted({r.p for r in small.select(part.alias("p")).collect()})
    seen = ingest.seen_keys(spark, target, 1, touched, ["repo", "issue_number"])
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*key_part[^\]]*" + str(touched[0]), plan)
    files = {r.f.split("key_part=")[1].split("/")[0] for r in seen.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files <= {str(p) for p in touched} and 0 < seen.count() < 400
    for _ in range(2):
        ingest.ingest_batch(small, 1, target, ["repo", "issue_number"], ["at"])
        held = spark.read.parquet(target)
        assert held.count() == 401 and rows_of(held.where("ingest_batch = 1"), "issue_number", "at") == [(1000, 1)]


def test_the_log_keeps_the_smallest_row_of_a_repeated_key(spark, tmp_path):
    schema = "repo string, issue_number long, at long, outcome string"
    path = str(tmp_path / "log")
    spark.createDataFrame([("r", 1, 0, "kept")], schema).write.parquet(path)
    new = spark.createDataFrame([("r", 2, 5, "kept"), ("r", 2, 3, "rejected"), ("r", 2, 3, "failed"), ("r", 1, 0, "failed")], schema)
    sinks.append_checked(spark.read.parquet(path), new.repartition(3), path)
    assert rows_of(spark.read.parquet(path), "issue_number", "at", "outcome") == [(1, 0, "kept"), (2, 3, "failed")]


def test_lines_are_dealt_by_order_once(spark, tmp_path):
    spark.sql("SELECT 1L AS l_orderkey, 2L AS l_suppkey, 3.0D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS o_orderkey, 5L AS o_custkey, timestamp'2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        commits = standins.commit_files(spark, str(tmp_path))
        # one for the lines and one for the orders
        assert commits._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert [(r.repo, r.path, r.added, r.deleted) for r in commits.collect()] == [("repo5", "s2", 3, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
