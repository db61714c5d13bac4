"""Inclusion filters and the cleaning run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations, text
from pacemark.operators import keys
from pacemark.session import written
from pacemark.sources.schemas import KEY


def include_pairs(pairs: DataFrame, min_text: int = fv.MIN_TEXT_LENGTH,
                  min_hours: float = fv.MIN_DURATION_HOURS, max_days: float = fv.MAX_DURATION_DAYS,
                  excluded_labels: list[str] | None = None) -> DataFrame:
    """Pairs with enough text, a duration in bounds and none of the excluded labels."""
    excluded = F.array(*[F.lit(w) for w in (excluded_labels or fv.EXCLUDED_LABELS)])
    long_enough = F.length(text.requirement_text(F.col("issue_title"), F.col("issue_body"))) >= min_text
    labels = F.coalesce("issue_labels", F.array().cast("array<string>"))
    return pairs.where(durations.in_bounds(F.col("duration_hours"), min_hours, max_days)
                       & ~F.arrays_overlap(labels, excluded) & long_enough)


def drop_small_repos(pairs: DataFrame, min_rows: int = fv.MIN_REPO_ROWS) -> DataFrame:
    """Drop repos with fewer rows than ``min_rows``, by the rows given here.

    Repos are counted with partial sums, not in a window, so a repo that holds most
    rows is no burden; the small repos, written first so that their size is known,
    are then removed.
    """
    small = pairs.groupBy("repo").agg(F.count("*").alias("_n")).where(F.col("_n") < min_rows)
    return pairs.join(written(small.select("repo"), "small_repos"), "repo", "left_anti")


def clean_pairs(pairs: DataFrame, order: list[str], min_rows: int = fv.MIN_REPO_ROWS,
                recheck: bool = False) -> DataFrame:
    """The cleaning run, in its fixed order.

    Small repos are judged before anything else is dropped; ``recheck`` judges them
    again at the end. Durations are measured from creation for every row.
    """
    kept = drop_small_repos(pairs, min_rows).where(
        ~text.is_blank(F.col("issue_body")) & (F.col("num_files_changed") > 0))
    timed = kept.withColumn("duration_hours", durations.hours_between(
        F.col("issue_created_at"), F.col("pr_merged_at")))
    unique = keys.keep_first(timed, KEY, order)
    positive = unique.where("duration_hours > 0")
    return drop_small_repos(positive, min_rows) if recheck else positive


def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after cleaning, and the share that went."""
    kept = after.agg(F.count("*").alias("n")).scalar()
    return before.agg(F.count("*").alias("n_before")).select(
        "n_before", kept.alias("n_after"), (F.col("n_before") - kept).alias("n_removed"),
        ((F.col("n_before") - kept) / F.nullif(F.col("n_before"), F.lit(0)) * 100).alias("removed_percent"))


def repo_shares(pairs: DataFrame) -> DataFrame:
    """Rows per repo and their share, most rows first."""
    total = pairs.agg(F.count("*").alias("n")).scalar()
    return (pairs.groupBy("repo").agg(F.count("*").alias("n"))
            .withColumn("percent", F.col("n") / total * 100)
            .orderBy(F.desc("n"), "repo"))
