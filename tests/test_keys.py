"""Deduplication, merging, quotas, splits."""

from conftest import rows_of
from pyspark.sql import functions as F

from pacemark.operators import keys, splits

KEY = ["repo", "issue_number"]


def table(spark, rows):
    return spark.createDataFrame(rows, "repo string, issue_number long, at long, v string")


def test_keep_first_and_last(spark):
    df = table(spark, [("r", 1, 3, "c"), ("r", 1, 1, "a"), ("r", 1, 2, "b"), ("s", 1, 9, "z")])
    assert rows_of(keys.keep_first(df, KEY, ["at"]), "repo", "v") == [("r", "a"), ("s", "z")]
    assert rows_of(keys.keep_last(df, KEY, ["at"]), "repo", "v") == [("r", "c"), ("s", "z")]


def test_union_is_idempotent_and_held_rows_win(spark):
    held = table(spark, [("r", 1, 5, "held")])
    new = table(spark, [("r", 1, 1, "new"), ("r", 2, 1, "other")])
    once = keys.existing_wins(held, new, KEY, ["at"])
    assert rows_of(once, "issue_number", "v") == [(1, "held"), (2, "other")]
    assert rows_of(keys.existing_wins(once, new, KEY, ["at"])) == rows_of(once)
    assert rows_of(keys.newest_wins(held, new, KEY, ["at"]), "issue_number", "v") == [(1, "new"), (2, "other")]


def test_missing_columns_on_one_side(spark):
    held = table(spark, [("r", 1, 5, "held")]).drop("v")
    both = keys.existing_wins(held, table(spark, [("r", 2, 1, "n")]), KEY, ["at"])
    assert rows_of(both, "issue_number", "v") == [(1, None), (2, "n")]


def test_hot_key_is_cut_before_the_shuffle(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("repo"),
        F.lit(1).alias("issue_number"), F.col("id").alias("at"))
    kept = keys.keep_first(hot, KEY, ["at"])
    assert kept.where("repo = 'hot'").select("at").first().at == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_allow_list(spark):
    df = table(spark, [("r", 1, 1, "a"), ("s", 1, 1, "b")])
    allowed = df.select("repo").where("repo = 'r'")
    assert rows_of(keys.only_listed(df, allowed, ["repo"]), "repo") == [("r",)]
    assert keys.only_listed(df, allowed.where("false"), ["repo"]).count() == 2


def test_seen_keys(spark):
    log = spark.createDataFrame([("r", 1, "kept"), ("r", 2, "rejected"), ("r", 3, "failed")],
                                "repo string, issue_number long, outcome string")
    df = table(spark, [("r", i, 1, "x") for i in range(1, 5)])
    assert rows_of(keys.only_new(df, keys.settled(log), KEY), "issue_number") == [(3,), (4,)]
    assert keys.key_union(log, df, key=KEY).count() == 4


def test_quota(spark):
    held = table(spark, [("r", i, 1, "x") for i in range(3)])
    new = table(spark, [(repo, i, i, "x") for repo in "rs" for i in range(10, 20)])
    quota = keys.remaining_quota(new.select("repo").distinct(), held, target=5)
    assert rows_of(quota) == [("r", 3, 2), ("s", 0, 5)]
    taken = rows_of(keys.fill_quota(new, quota, "at", ["issue_number"], target=5), "repo", "issue_number")
    assert taken == [("r", 18), ("r", 19)] + [("s", i) for i in range(15, 20)]


def test_split_depends_on_the_key_only(spark):
    df = spark.range(2000).select(F.lit("r").alias("repo"), F.col("id").alias("issue_number"))
    marked = df.withColumn("split", splits.holdout(F.col("repo"), F.col("issue_number")))
    again = df.repartition(7).withColumn("split", splits.holdout(F.col("repo"), F.col("issue_number")))
    assert rows_of(marked) == rows_of(again)
    share = marked.where("split = 'test'").count() / 2000
    assert 0.17 < share < 0.23
    other = df.withColumn("split", splits.holdout(F.col("repo"), F.col("issue_number"), seed=7))
    assert rows_of(other) != rows_of(marked)


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(100).select(F.lit("r").alias("repo"), F.col("id").alias("issue_number"))
    first = rows_of(splits.sample(df, 10))
    assert len(first) == 10 and first == rows_of(splits.sample(df.repartition(5), 10))
    assert splits.sample(df, 1000).count() == 100
