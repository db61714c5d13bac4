"""Which merged change closed an issue, and when somebody was first assigned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.functions import durations
from pacemark.operators.unions import stacked
from pacemark.sources.schemas import KEY


def first_assigned(timeline: DataFrame) -> DataFrame:
    """Time of the first "assigned" event of each issue."""
    return (timeline.where("kind = 'assigned'").groupBy(*KEY)
            .agg(F.min("event_at").alias("issue_assigned_at")))


def _targets(pulls: DataFrame, commit_pulls: DataFrame) -> DataFrame:
    """What an event may lead to: ``repo``, the kind of link ``via``, what it names (``ref``) and the merged change."""
    merged = pulls.where("pr_merged_at is not null").select("repo", "pr_number")
    references = merged.select("repo", F.lit("reference").alias("via"), F.col("pr_number").cast("string").alias("ref"), "pr_number")
    commits = (commit_pulls.join(merged, ["repo", "pr_number"], "left_semi")
               .groupBy("repo", F.lit("commit").alias("via"), F.col("commit_id").cast("string").alias("ref"))
               .agg(F.min_by("pr_number", F.struct("pull_order", "pr_number")).alias("pr_number")))
    return stacked(references, commits)


def _mentioned(pulls: DataFrame) -> DataFrame:
    """Issue numbers that merged changes mention; one that is no long belongs to no issue."""
    mention = F.concat_ws(" ", "pr_title", "pr_body")
    numbers = F.explode(F.array_distinct(F.regexp_extract_all(mention, F.lit(r"#(\d+)\b"), F.lit(1))))
    return (pulls.where("pr_merged_at is not null").select("repo", "pr_number", numbers.alias("number"))
            .select("repo", "pr_number", F.col("number").try_cast("long").alias("issue_number")).where("issue_number is not null"))


def _outcomes(timeline: DataFrame, pulls: DataFrame, commit_pulls: DataFrame) -> DataFrame:
    """Per issue number: ``best``, the change that decides (if any), and ``issue_assigned_at``.

    The timeline is scanned once. Every event asks one table for what it names; those that name nothing ask
    for something that is not there, each under its own issue, so that they stay spread. One aggregation with
    partial sums per task then finds the first event that led anywhere, the mention to fall back on and the
    first assignment.
    """
    via = (F.when((F.col("kind") == "cross-referenced") & (F.col("source_repo") == F.col("repo")), "reference")
           .when((F.col("kind") == "closed") & F.col("commit_id").isNotNull(), "commit").otherwise("none"))
    ref = (F.when(F.col("via") == "reference", F.col("source_number").cast("string"))
           .when(F.col("via") == "commit", F.col("commit_id").cast("string")).otherwise(F.col("issue_number").cast("string")))
    events = (timeline.where(F.col("kind").isin("assigned", "cross-referenced", "closed"))
              .withColumn("via", via).withColumn("ref", ref)
              .select(*KEY, "event_order", "via", "ref", F.when(F.col("kind") == "assigned", F.col("event_at")).alias("assigned_at"))
              .where("via <> 'none' or assigned_at is not null"))
    led = events.join(_targets(pulls, commit_pulls), ["repo", "via", "ref"], "left").drop("ref").withColumn("late", F.lit(0))
    by_text = _mentioned(pulls).withColumns({
        "event_order": F.lit(None), "via": F.lit("mention"), "assigned_at": F.lit(None), "late": F.lit(1)})
    best = F.min(F.when(F.col("pr_number").isNotNull(), F.struct("late", "event_order", "pr_number", "via")))
    return stacked(led, by_text).groupBy(*KEY).agg(best.alias("best"), F.min("assigned_at").alias("issue_assigned_at"))


def first_merged_change(issues: DataFrame, timeline: DataFrame, pulls: DataFrame,
                        commit_pulls: DataFrame) -> DataFrame:
    """The change linked to each issue: key, ``pr_number`` and the kind of link.

    The first event in timeline order that leads to a merged change of the same repo
    decides, be it a cross reference or a closing commit (then the first merged change
    of that commit). Only issues without any fall back to the first merged change that
    mentions ``#number``.
    """
    found = _outcomes(timeline, pulls, commit_pulls).where("best is not null")
    return (found.join(issues.where(~F.col("is_pull_request")).select(*KEY), KEY, "left_semi")
            .select(*KEY, "best.pr_number", "best.via"))


def linked_pairs(issues: DataFrame, timeline: DataFrame, pulls: DataFrame,
                 commit_pulls: DataFrame) -> DataFrame:
    """Issues with their merged change and the hours from assignment or creation to the merge."""
    found = _outcomes(timeline, pulls, commit_pulls).where("best is not null").select(
        *KEY, "best.pr_number", "best.via", "issue_assigned_at")
    return (issues.where(~F.col("is_pull_request")).join(found, KEY)
            .join(pulls, ["repo", "pr_number"])
            .withColumn("duration_hours", durations.duration_hours(
                F.col("issue_created_at"), F.col("issue_assigned_at"), F.col("pr_merged_at"))))
