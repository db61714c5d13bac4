"""Views over the given tables that have the shape of issue data.

The given tables hold no issues, so each operator runs on a stand-in. All of them
cover the whole table they come from.

* ``pairs``: an ``error`` event is an issue, the same user's next ``purchase`` the
  merge; texts, labels and vectors come from documents, pages and embeddings.
* ``order_pairs`` / ``pair_files`` / ``commit_files``: an order is an issue and a
  commit, its suppliers are the files it touches.
* ``predictions``: three simple estimators that SQL can recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacemark.functions import durations, text
from pacemark.operators import embeddings, history, quantiles, splits, text_features
from pacemark.session import dealt, new_table_path, written
from pacemark.sources import readers, sinks
from pacemark.sources.readers import read_table
from pacemark.sources.schemas import KEY

LABEL_WORDS = ["question", "bug", "feature", "docs", "wontfix",
               "enhancement", "api", "perf", "build", "duplicate"]


def _row_count(df: DataFrame):
    return df.agg(F.count("*").alias("n")).scalar()


def first_later_event(events: DataFrame, start: str, end: str) -> DataFrame:
    """Each ``start`` event with the time of the same user's next ``end`` event.

    A user may hold a third of all events, so the search runs per user and hour; when
    the hour has no later ``end`` event, the first one of the next hour with any counts.
    Only one row per user and hour is ever compared across hours.
    """
    rows = (events.where(F.col("event_type").isin(start, end))
            .withColumn("at", F.col("ts").cast("timestamp"))
            .withColumn("us", F.unix_micros("at"))
            .withColumn("hour", F.floor(F.col("us") / F.lit(3_600_000_000)))
            .withColumn("end_us", F.when(F.col("event_type") == end, F.col("us"))))
    # ordered backwards, so the frame "strictly later" is a running one
    backwards = (Window.partitionBy("user_id", "hour").orderBy((-F.col("us")).alias("back"))
                 .rangeBetween(Window.unboundedPreceding, -1))
    same_hour = rows.withColumn("same_hour", F.min("end_us").over(backwards)).where(
        F.col("event_type") == start)
    firsts = rows.groupBy("user_id", "hour").agg(F.min("end_us").alias("first_us"))
    later_hours = (Window.partitionBy("user_id").orderBy(F.col("hour").desc())
                   .rowsBetween(Window.unboundedPreceding, -1))
    next_hours = firsts.select("user_id", "hour", F.min("first_us").over(later_hours).alias("next_hour"))
    return (same_hour.join(next_hours, ["user_id", "hour"])
            .withColumn("end_at", F.timestamp_micros(F.coalesce("same_hour", "next_hour")))
            .drop("us", "hour", "end_us", "same_hour", "next_hour"))


def issue_events(spark: SparkSession, sf_dir: str, end: str = "purchase") -> DataFrame:
    """Issues without their texts: key, times, number of the event, files and value."""
    events = read_table(spark, sf_dir, "events")
    found = first_later_event(events, "error", end)
    k = F.get_json_object("props", "$.k").cast("long")
    late = F.col("value") >= 100
    return (found.withColumn("k", k).select(
        F.concat(F.lit("repo"), (F.col("user_id") % 8).cast("string")).alias("repo"),
        F.col("event_id").alias("issue_number"),
        F.col("at").alias("issue_created_at"),
        F.when(late, F.timestamp_micros(
            F.unix_micros("at") + F.floor(F.col("value") * F.lit(60e6)))).alias("issue_assigned_at"),
        F.col("end_at").alias("pr_merged_at"),
        "k", "value",
        (F.col("k") % 5).alias("num_files_changed"))
        .where("pr_merged_at is not null"))


def pairs(spark: SparkSession, sf_dir: str, end: str = "purchase") -> DataFrame:
    """Linked pairs with texts, labels and files."""
    documents = read_table(spark, sf_dir, "documents")
    pages = read_table(spark, sf_dir, "pages")
    rows = (issue_events(spark, sf_dir, end)
            .withColumn("doc_id", F.col("issue_number") % _row_count(documents))
            .withColumn("page_id", F.col("issue_number") % _row_count(pages))
            .join(documents.select("doc_id", "text", "lang"), "doc_id", "left")
            .join(pages.select("page_id", "url"), "page_id", "left"))
    words = F.array(*[F.lit(w) for w in LABEL_WORDS])
    n = F.col("num_files_changed")
    files = F.when(n > 0, F.transform(
        F.sequence(F.lit(1).cast("long"), n),
        lambda i: F.concat(F.lit("m"), ((F.col("issue_number") + i) % 40).cast("string"), F.lit(".py"))
    )).otherwise(F.array().cast("array<string>"))
    body = (F.when(F.col("value") < 2, F.lit(None))
            .when(F.col("value") < 5, F.lit(" \n\t")).otherwise(F.col("text")))
    return rows.select(
        "repo", "issue_number", F.col("url").alias("issue_title"), body.alias("issue_body"),
        F.array(F.element_at(words, (F.col("k") % 10 + 1).cast("int")), F.col("lang")).alias("issue_labels"),
        "issue_created_at", "issue_assigned_at", F.col("k").alias("pr_number"),
        F.concat(F.lit("change "), F.col("k").cast("string")).alias("pr_title"),
        F.when(F.col("value") >= 10, F.col("lang")).alias("pr_body"),
        "pr_merged_at", files.alias("pr_files_changed"), "num_files_changed",
        durations.duration_hours(F.col("issue_created_at"), F.col("issue_assigned_at"),
                                 F.col("pr_merged_at")).alias("duration_hours"))


def timed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and hours from creation to merge, the target of the estimators."""
    return issue_events(spark, sf_dir).select(
        "repo", "issue_number",
        durations.hours_between(F.col("issue_created_at"), F.col("pr_merged_at")).alias("hours"))


def word_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length band of each document: one per hundred words, the last open."""
    documents = read_table(spark, sf_dir, "documents")
    band = F.least(F.floor(text.word_count(F.col("text")) / F.lit(100)), F.lit(9)).cast("long")
    return documents.select("doc_id", band.alias("band"))


def banded_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = word_bands(spark, sf_dir)
    return (timed_issues(spark, sf_dir)
            .withColumn("doc_id", F.col("issue_number") % _row_count(documents))
            .join(documents, "doc_id", "left").drop("doc_id"))


def simple_predictions(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Predictions of three estimators learnt from the train split.

    A: mean of the repo, B: median of the repo, C: mean of the text length band;
    a group unseen in training gets the train mean. ``by`` fits them per group.
    """
    by = list(by or [])
    rows = rows.withColumn("split", splits.holdout(F.col("repo"), F.col("issue_number")))
    train = rows.where("split = 'train'")
    mean_repo = train.groupBy(*by, "repo").agg(F.round(F.avg("hours"), 2).alias("A"))
    median_repo = (quantiles.quantiles(train, [*by, "repo"], "hours", {"m": 0.5})
                   .select(*by, "repo", F.round("m", 2).alias("B")))
    mean_band = train.groupBy(*by, "band").agg(F.round(F.avg("hours"), 2).alias("C"))
    fitted = (rows.join(mean_repo, [*by, "repo"], "left")
              .join(median_repo, [*by, "repo"], "left")
              .join(mean_band, [*by, "band"], "left"))
    overall = train.groupBy(*by).agg(F.round(F.avg("hours"), 2).alias("_mean"))
    if by:
        fitted = fitted.join(overall, by, "left")
    else:
        fitted = fitted.withColumn("_mean", overall.scalar())
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(m, "_mean").alias("predicted_hours"))
                       for m in ("A", "B", "C")])
    return fitted.select(*by, "repo", "issue_number", "split", F.col("hours").alias("actual_hours"),
                         F.inline(models))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the three estimators, written once and read back for analysis."""
    rows = written(banded_issues(spark, sf_dir).where(durations.in_bounds(F.col("hours"))), "banded")
    path = new_table_path(spark, "predictions")
    sinks.write_predictions(simple_predictions(rows), path)
    return readers.read_predictions(spark, path)


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per order that has lines: created when ordered, merged when last shipped."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    shipped = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
               .agg(F.max("l_shipdate").alias("last_ship")))
    return (orders.join(shipped, orders.o_orderkey == shipped.l_orderkey)
            .select(F.concat(F.lit("repo"), (F.col("o_custkey") % 8).cast("string")).alias("repo"),
                    F.col("o_orderkey").alias("issue_number"),
                    F.col("o_orderdate").cast("timestamp").alias("issue_created_at"),
                    F.col("last_ship").cast("timestamp").alias("pr_merged_at"))
            .withColumn("duration_hours", durations.hours_between(
                F.col("issue_created_at"), F.col("pr_merged_at"))))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and supplier: an order as a commit, suppliers as files.

    Lines are dealt by order once, which serves the sums and the join; hardly two lines of an order name one supplier, so
    sums before that would save nothing.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    touched = (read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
               .repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey")
               .agg(F.sum("l_quantity").cast("long").alias("added"), F.count("*").alias("deleted")))
    return (touched.join(orders, touched.l_orderkey == orders.o_orderkey)
            .select(F.concat(F.lit("repo"), (F.col("o_custkey") % 8).cast("string")).alias("repo"),
                    F.col("o_orderkey").alias("commit_id"),
                    F.col("o_orderdate").cast("timestamp").alias("committed_at"),
                    F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"),
                    "added", "deleted"))


def stored_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commit_files`` written once, in files of about ``history.ROWS_PER_TASK`` rows, so that no task holds more of them as they grow."""
    with dealt(spark, read_table(spark, sf_dir, "lineitem").count(), history.ROWS_PER_TASK):
        return written(commit_files(spark, sf_dir), "commit_files")


def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each order pair, one per row."""
    return commit_files(spark, sf_dir).select("repo", F.col("commit_id").alias("issue_number"), "path")


def link_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Issues, timeline, changes and changes per commit, for linking.

    Orders are issues, their lines the timeline (kind by return flag), parts the
    changes; a part's size is the commit it belongs to.
    """
    orders = read_table(spark, sf_dir, "orders")
    lines = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part")
    repo = F.concat(F.lit("repo"), (F.col("o_custkey") % 8).cast("string"))
    issues = orders.select(
        repo.alias("repo"), F.col("o_orderkey").alias("issue_number"),
        F.col("o_orderdate").cast("timestamp").alias("issue_created_at"),
        (F.col("o_orderstatus") == "P").alias("is_pull_request"))
    kind = (F.when(F.col("l_returnflag") == "A", "cross-referenced")
            .when(F.col("l_returnflag") == "N", "closed").otherwise("assigned"))
    timeline = (lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == orders.o_orderkey)
                .select(repo.alias("repo"), F.col("l_orderkey").alias("issue_number"),
                        F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey").alias("event_order"),
                        kind.alias("kind"), F.col("l_shipdate").cast("timestamp").alias("event_at"),
                        F.concat(F.lit("repo"), (F.col("l_partkey") % 8).cast("string")).alias("source_repo"),
                        F.col("l_partkey").alias("source_number"),
                        F.col("l_quantity").cast("long").alias("commit_id")))
    part_repo = F.concat(F.lit("repo"), (F.col("p_partkey") % 8).cast("string"))
    merged = F.when(F.col("p_type") != "ECONOMY", F.timestamp_micros(
        F.lit(1_009_843_200_000_000) + F.col("p_size").cast("long") * F.lit(86_400_000_000)))
    pulls = parts.select(
        part_repo.alias("repo"), F.col("p_partkey").alias("pr_number"), merged.alias("pr_merged_at"),
        F.col("p_name").alias("pr_title"),
        F.concat(F.lit("closes #"), (F.col("p_partkey") * 7).cast("string")).alias("pr_body"))
    commit_pulls = parts.select(
        part_repo.alias("repo"), F.col("p_size").cast("long").alias("commit_id"),
        F.col("p_partkey").alias("pr_number"), F.col("p_retailprice").alias("pull_order"))
    return issues, timeline, pulls, commit_pulls


def repo_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed or open issues of the customer's nation."""
    orders = read_table(spark, sf_dir, "orders")
    customers = read_table(spark, sf_dir, "customer")
    nations = read_table(spark, sf_dir, "nation")
    return (orders.join(customers, orders.o_custkey == customers.c_custkey)
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("repo"), (F.col("o_orderstatus") == "F").alias("is_closed"),
                    F.col("o_custkey").alias("author"),
                    F.col("o_orderdate").cast("timestamp").alias("created_at")))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order pairs with history features, text features and a vector.

    Text features are computed once per document and vector scores once per vector;
    both then join the pairs by key. Pairs and commits are read by several steps and made once.
    """
    spine = written(order_pairs(spark, sf_dir), "order_pairs")
    commits = stored_commits(spark, sf_dir)
    own = commits.select("repo", F.col("commit_id").alias("issue_number"), "path")
    past = history.history_features(spine, own, commits)
    documents = read_table(spark, sf_dir, "documents")
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    texts = text_features.derived_features(documents, ["doc_id"], F.col("lang"), F.col("text"))
    scored = embeddings.complexity_scores(vectors, "embedding")
    return (spine.join(past, KEY, "left")
            .withColumn("doc_id", F.col("issue_number") % _row_count(documents))
            .withColumn("vec_id", F.col("issue_number") % _row_count(vectors))
            .join(texts, "doc_id", "left").join(scored, "vec_id", "left")
            .drop("doc_id", "vec_id"))
