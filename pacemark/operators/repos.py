"""Which repositories are worth studying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations


def inclusion_statistics(activity: DataFrame, min_contributors: int = fv.MIN_CONTRIBUTORS) -> DataFrame:
    """Closed issues, contributors (counted one past the minimum) and start of each repo.

    ``activity`` has repo, is_closed, author and created_at.
    """
    return activity.groupBy("repo").agg(
        F.count_if(F.col("is_closed")).alias("total_closed_issues"),
        F.least(F.count_distinct("author"), F.lit(min_contributors + 1)).alias("contributor_count"),
        F.min("created_at").alias("started_at"))


def inclusion_flags(statistics: DataFrame, today: Column, min_closed: int = fv.MIN_CLOSED_ISSUES,
                    min_contributors: int = fv.MIN_CONTRIBUTORS, min_years: float = fv.MIN_YEARS) -> DataFrame:
    """Each criterion and their conjunction; the age is only rounded for display."""
    years = durations.age_years(F.col("started_at"), today)
    issues = F.col("total_closed_issues") >= min_closed
    people = F.col("contributor_count") >= min_contributors
    age = years >= min_years
    return statistics.select(
        "repo", "total_closed_issues", "contributor_count", F.round(years, 1).alias("age_years"),
        issues.alias("meets_issue_threshold"), people.alias("meets_contributor_threshold"),
        age.alias("meets_age_threshold"), (issues & people & age).alias("passes_all"))
