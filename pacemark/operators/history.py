"""Features of the files a pair touches, from the commits that touched them.

Files come one per row, never as lists per pair, so a pair with very many files is
spread like any other data. The one list that is built holds the files of a commit
of at most ``MAX_FILES_PER_COMMIT`` files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations
from pacemark.functions.parsing import split_list
from pacemark.operators.unions import stacked
from pacemark.session import dealt, written
from pacemark.sources.schemas import KEY

#: Files of a pair, those with most partners first, whose partners are counted once per set of files. Costs only.
FILES_AHEAD = 2
#: Rows of commits and files that a task of the coupling gets.
ROWS_PER_TASK = 500_000


def files_of_pairs(pairs: DataFrame, column: str = "pr_files_changed") -> DataFrame:
    """One row per pair and file from a delimited list column."""
    return pairs.select(*KEY, F.explode(split_list(F.col(column))).alias("path"))


def recent_commits(commit_files: DataFrame, pairs: DataFrame,
                   lookback_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """Commits of the pairs' repos, from the repo's first pair less the lookback on.

    There is no upper bound: later changes count as well. The smallest of all bounds
    is a scalar that reaches the scan; the bound of each repo follows by join. The
    bounds are written first, so the planner knows their size and broadcasts them
    unless there are very many repos.
    """
    lookback = F.make_dt_interval(F.lit(lookback_days))
    bounds = written(pairs.groupBy("repo").agg(
        (F.min("issue_created_at") - lookback).alias("_since")), "bounds")
    earliest = bounds.agg(F.min("_since").alias("since")).scalar()
    return (commit_files.where(F.col("committed_at") >= earliest)
            .join(bounds, "repo")
            .where(F.col("committed_at") >= F.col("_since")).drop("_since"))


def file_history(commit_files: DataFrame) -> DataFrame:
    """Churn, number of changes and first and last change of each file."""
    return commit_files.groupBy("repo", "path").agg(
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted"),
        F.count("*").alias("commits"),
        F.min("committed_at").alias("first_seen"), F.max("committed_at").alias("last_modified"))


def cochange_edges(commit_files: DataFrame, interest: DataFrame, min_support: int = 1,
                   max_files: int = fv.MAX_FILES_PER_COMMIT) -> DataFrame:
    """How often a file of interest changed together with another file, directed.

    Commits of more than ``max_files`` files say nothing about coupling. Every task passes on no more
    than ``max_files + 1`` files of a commit, so a commit of any size is a short list, and one that is
    too long is known by its length: commits are shuffled once, and the expansion is linear in their
    number. Each unordered pair is counted once, with partial sums, and turned into its two directions
    only after the count. The files of interest are written first: the planner then knows their size,
    and commits are not shuffled to meet a small table. Rows without a commit are one commit.
    """
    wanted = written(interest.select("repo", "path").distinct(), "interest")
    marked = commit_files.select("repo", "commit_id", "path").join(
        wanted.withColumn("wanted", F.lit(True)), ["repo", "path"], "left")
    place = F.row_number().over(Window.partitionBy("repo", "commit_id").orderBy("path"))
    lists = (marked.withColumn("place", place).where(F.col("place") <= max_files + 1)
             .groupBy("repo", "commit_id")
             .agg(F.sort_array(F.collect_list(F.struct(
                 "path", F.coalesce("wanted", F.lit(False)).alias("wanted")))).alias("files"))
             .where((F.size("files") <= max_files) & F.exists("files", lambda f: f["wanted"])))
    pairs = (lists.select("repo", "files", F.posexplode("files").alias("i", "one"))
             .select("repo", "one", F.explode(
                 F.slice("files", F.col("i") + 2, F.size("files"))).alias("two"))
             .where("(one.wanted or two.wanted) and one.path <> two.path"))
    counted = (pairs.groupBy("repo", F.col("one.path").alias("a"), F.col("two.path").alias("b"))
               .agg(F.count("*").alias("n"), F.max("one.wanted").alias("a_wanted"),
                    F.max("two.wanted").alias("b_wanted"))
               .where(F.col("n") >= min_support))
    return counted.select("repo", "n", F.inline(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("partner"), F.col("a_wanted").alias("wanted")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("partner"), F.col("b_wanted").alias("wanted")),
    ))).where("wanted").select("repo", "source", "partner", "n")


def stored_edges(commit_files: DataFrame, interest: DataFrame, min_support: int = 1,
                 max_files: int = fv.MAX_FILES_PER_COMMIT) -> DataFrame:
    """``cochange_edges`` written by tasks that follow the number of rows, so that neither lists nor counts of a task grow with it."""
    with dealt(commit_files.sparkSession, commit_files.count(), ROWS_PER_TASK):
        return written(cochange_edges(commit_files, interest, min_support, max_files), "edges")


def _roles(own_files: DataFrame, listed: DataFrame) -> DataFrame:
    """Every path a pair touches or lists as a partner, once, with what it is to the pair."""
    return (stacked(own_files.withColumns({"is_own": F.lit(1), "is_listed": F.lit(0)}),
                    listed.withColumns({"is_own": F.lit(0), "is_listed": F.lit(1)}))
            .groupBy(*KEY, "path")
            .agg(F.max("is_own").alias("is_own"), F.max("is_listed").alias("is_listed")))


def _new_partners(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """Per ``prefix`` of a head, of two files or more: partners of its last file that no earlier file has, as ``n``."""
    prefixes = (heads.select("repo", "head").distinct()
                .select("repo", F.explode(F.transform(
                    F.sequence(F.lit(1), F.size("head")), lambda n: F.slice("head", 1, n))).alias("prefix"))
                .where(F.size("prefix") > 1).distinct())
    asked = (prefixes.withColumn("source", F.element_at("prefix", -1)).join(edges, ["repo", "source"])
             .select("repo", "prefix", "partner", F.explode(F.slice(
                 "prefix", F.lit(1), F.size("prefix") - 1)).alias("source")))
    found = (asked.join(edges.withColumn("is_known", F.lit(1)), ["repo", "source", "partner"], "left")
             .groupBy("repo", "prefix", "partner").agg(F.max("is_known").alias("is_known")))
    return found.where("is_known is null").groupBy("repo", "prefix").agg(F.count("*").alias("n"))


def coupling(own_files: DataFrame, edges: DataFrame, files_ahead: int = FILES_AHEAD) -> DataFrame:
    """Distinct partners of a pair's files: all of them (``fan_in``), and those that are not its own (``fan_out``).

    ``own_files`` has the key and a ``path``, ``edges`` a ``source`` and its ``partner``, each once. Repeated
    files count once; pairs none of whose files has a partner are not in the result.

    The files of a pair are taken by falling number of partners. The partners of the first are never
    listed, their number is known. What each of the next adds depends on the files before it alone; it is
    counted once for every set of files that occurs, by listing the smaller neighbourhood and asking for
    each of its members whether a larger one has it. So files that many pairs touch, alone or together,
    cost what their sets cost and not what their pairs do. Only files after the first ``files_ahead``
    have their partners listed for every pair. Heads hold ``files_ahead`` paths at most, and a task passes on no
    more of a pair, whatever number of files it has.
    """
    own = own_files.select(*KEY, "path")
    degrees = edges.groupBy("repo", F.col("source").alias("path")).agg(F.count("*").alias("degree"))
    known = own.distinct().join(degrees, ["repo", "path"])
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("degree"), "path"))
    # read by every step below
    heads = written(
        known.withColumn("place", place).where(F.col("place") <= files_ahead)
        .groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("place", "path", "degree"))).alias("files"))
        .select(*KEY, F.col("files.path").alias("head"), F.col("files")[0]["degree"].alias("degree")), "heads")

    added = (heads.select(*KEY, F.explode(F.transform(
        F.sequence(F.lit(1), F.size("head")), lambda n: F.slice("head", 1, n))).alias("prefix"))
        .join(_new_partners(heads, edges), ["repo", "prefix"]).groupBy(*KEY).agg(F.sum("n").alias("n_added")))

    listed = (known.join(heads, KEY).where(~F.array_contains("head", F.col("path")))
              .select(*KEY, F.col("path").alias("source")).join(edges, ["repo", "source"])
              .select(*KEY, F.col("partner").alias("path")))
    asked = (_roles(own, listed).join(heads.select(*KEY, F.explode("head").alias("source")), KEY)
             .join(edges.select("repo", "source", F.col("partner").alias("path"), F.lit(1).alias("is_ahead")),
                   ["repo", "source", "path"], "left")
             .groupBy(*KEY, "path").agg(F.max("is_own").alias("is_own"), F.max("is_listed").alias("is_listed"),
                                        F.coalesce(F.max("is_ahead"), F.lit(0)).alias("is_ahead")))
    beyond = asked.groupBy(*KEY).agg(
        F.sum(F.col("is_listed") * (1 - F.col("is_ahead"))).alias("n_beyond"),
        F.sum(F.col("is_own") * F.greatest("is_listed", "is_ahead")).alias("n_own"))
    fan_in = F.col("degree") + F.coalesce("n_added", F.lit(0)) + F.col("n_beyond")
    return (heads.select(*KEY, "degree").join(added, KEY, "left").join(beyond, KEY)
            .select(*KEY, fan_in.alias("fan_in"), (fan_in - F.col("n_own")).alias("fan_out")))


def history_features(pairs: DataFrame, pair_files: DataFrame, commit_files: DataFrame,
                     lookback_days: int = fv.LOOKBACK_DAYS, min_support: int = fv.MIN_SUPPORT,
                     max_files: int = fv.MAX_FILES_PER_COMMIT) -> DataFrame:
    """The thirteen history features of each pair; zeros when it touches no file.

    ``pairs`` is one batch: the history starts a lookback before its first pair.
    The impact radius is the same set as fan-out, so it is computed once.
    """
    spine = pairs.select(*KEY, "issue_created_at")
    own = written(pair_files.join(spine, KEY), "own_files")
    # file history and coupling both read them
    commits = written(recent_commits(commit_files, spine, lookback_days), "recent_commits")
    known = own.join(file_history(commits), ["repo", "path"], "left")
    age = durations.age_days(F.col("first_seen"), F.col("issue_created_at"))
    changes = F.coalesce("commits", F.lit(0))
    churn = known.groupBy(*KEY).agg(
        F.count("*").alias("num_files"),
        F.sum(F.coalesce("added", F.lit(0))).alias("total_churn_added"),
        F.sum(F.coalesce("deleted", F.lit(0))).alias("total_churn_deleted"),
        F.sum(changes).alias("total_churn_commits"),
        F.avg(age).alias("avg_file_age_days"), F.min(age).alias("min_file_age_days"),
        F.max(age).alias("max_file_age_days"),
        F.avg(changes).alias("avg_change_frequency"), F.max(changes).alias("max_change_frequency"))
    # the coupling reads the edges several times
    edges = stored_edges(commits, own, min_support, max_files).select("repo", "source", "partner")
    both = churn.join(coupling(own.select(*KEY, "path"), edges), KEY, "left")
    touched = F.col("total_churn_added") + F.col("total_churn_deleted")
    features = both.withColumns({
        "change_impact_radius": F.col("fan_out"),
        "avg_churn_per_file": touched / F.greatest("num_files", F.lit(1))})
    return (spine.select(*KEY).join(features, KEY, "left")
            .fillna(0, fv.HISTORY_FEATURES).select(*KEY, *fv.HISTORY_FEATURES))


#: Width of the time slots of the as-of history.
SLOT_DAYS = 7


def history_before(own_files: DataFrame, commit_files: DataFrame, slot_days: int = SLOT_DAYS) -> DataFrame:
    """Churn of each pair's file before the pair was created: only commits with ``committed_at < issue_created_at`` count.

    ``own_files`` has the key, ``issue_created_at`` and one ``path`` per row. Per row: key, path, ``added``, ``deleted``,
    ``commits`` and ``last_modified`` of the file until then; zeros and null where nothing happened before. Rows that repeat
    a key and path come out once each. A pair without a time of creation has no history; commits without a time never count.

    An as-of join: pairs and commits of a file are one stream ordered by time, and a pair takes the running sums. The
    stream is cut into time slots, so that a file in a third of all commits is spread over as many tasks as it has slots:
    sums run inside a slot, and what earlier slots add up to comes from one row per file and slot.
    """
    slot = F.floor(F.unix_micros("at") / F.lit(slot_days * 86_400_000_000))
    changes = commit_files.where(F.col("committed_at").isNotNull()).select(
        "repo", "path", F.col("committed_at").alias("at"), F.lit(1).alias("is_pair"),
        F.lit(None).cast(own_files.schema["issue_number"].dataType).alias("issue_number"),
        F.coalesce(F.col("added").cast("long"), F.lit(0)).alias("added"),
        F.coalesce(F.col("deleted").cast("long"), F.lit(0)).alias("deleted"), F.lit(1).cast("long").alias("commits"))
    zero = F.lit(0).cast("long")
    asked = own_files.select("repo", "path", F.col("issue_created_at").alias("at"), F.lit(0).alias("is_pair"), "issue_number",
                             zero.alias("added"), zero.alias("deleted"), zero.alias("commits"))
    # of equal times pairs come first, so that a commit at the very time does not count
    stream = stacked(changes, asked).withColumn("slot", slot)
    sums = ["added", "deleted", "commits"]
    last = F.max(F.when(F.col("is_pair") == 1, F.col("at")))
    # pairs ask all earlier slots of a file at once: one row per file and slot, wherever anything happened
    earlier = Window.partitionBy("repo", "path").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = stream.groupBy("repo", "path", "slot").agg(*[F.sum(c).alias(c) for c in sums], last.alias("last"),
                                                          F.max(F.col("is_pair") == 0).alias("asked"))
    before = per_slot.select("repo", "path", "slot", "asked", F.max("last").over(earlier).alias("at"),
                             *[F.sum(c).over(earlier).alias(c) for c in sums]).where("asked").drop("asked")
    # what came before is the first row of a slot, like one commit at the last time before it: no join, the stream moves once
    carried = before.withColumns({"is_pair": F.lit(1), "issue_number": F.lit(None).cast(own_files.schema["issue_number"].dataType),
                                  **{c: F.coalesce(c, zero) for c in sums}})
    inside = Window.partitionBy("repo", "path", "slot").orderBy("at", "is_pair").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    running = stacked(stream, carried).select(
        "repo", "issue_number", "path", "is_pair", *[F.sum(c).over(inside).alias(c) for c in sums], last.over(inside).alias("last_modified"))
    return running.where("is_pair = 0").drop("is_pair")


def features_before(pairs: DataFrame, pair_files: DataFrame, commit_files: DataFrame, slot_days: int = SLOT_DAYS) -> DataFrame:
    """The churn features of each pair as they were known when it was created; zeros when it touches no file.

    Unlike ``history_features`` nothing after the creation enters. Ages count from the last change before.
    """
    spine = pairs.select(*KEY, "issue_created_at")
    past = history_before(pair_files.join(spine, KEY), commit_files, slot_days)
    counted = past.groupBy(*KEY).agg(
        F.count("*").alias("num_files"), F.sum("added").alias("churn_added_before"),
        F.sum("deleted").alias("churn_deleted_before"), F.sum("commits").alias("commits_before"),
        F.max("commits").alias("max_change_frequency_before"), F.count("last_modified").alias("files_changed_before"),
        F.max("last_modified").alias("last_change_before"))
    numbers = [c for c in counted.columns if c not in (*KEY, "last_change_before")]
    return spine.join(counted, KEY, "left").fillna(0, numbers).withColumn(
        "days_since_change", durations.hours_between(F.col("last_change_before"), F.col("issue_created_at")) / 24).drop(
        "issue_created_at", "last_change_before")
