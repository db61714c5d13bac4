"""Declared schemas of the tables that are kept."""

from pyspark.sql import types as T

KEY = ["repo", "issue_number"]

ISSUE_PAIRS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("issue_number", T.LongType()),
    T.StructField("issue_title", T.StringType()),
    T.StructField("issue_body", T.StringType()),
    T.StructField("issue_labels", T.StringType()),
    T.StructField("issue_created_at", T.TimestampType()),
    T.StructField("issue_assigned_at", T.TimestampType()),
    T.StructField("pr_number", T.LongType()),
    T.StructField("pr_title", T.StringType()),
    T.StructField("pr_body", T.StringType()),
    T.StructField("pr_merged_at", T.TimestampType()),
    T.StructField("pr_files_changed", T.StringType()),
    T.StructField("num_files_changed", T.LongType()),
    T.StructField("duration_hours", T.DoubleType()),
])

PREDICTIONS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("issue_number", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("fold", T.LongType()),
    T.StructField("actual_hours", T.DoubleType()),
    T.StructField("predicted_hours", T.DoubleType()),
])

VALIDATION = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("total_closed_issues", T.LongType()),
    T.StructField("contributor_count", T.LongType()),
    T.StructField("age_years", T.DoubleType()),
    T.StructField("license", T.StringType()),
    T.StructField("meets_issue_threshold", T.BooleanType()),
    T.StructField("meets_contributor_threshold", T.BooleanType()),
    T.StructField("meets_age_threshold", T.BooleanType()),
    T.StructField("passes_all", T.BooleanType()),
])

CHECKED_LOG = T.StructType([
    T.StructField("checked", T.ArrayType(T.LongType())),
    T.StructField("count", T.LongType()),
    T.StructField("last_updated", T.StringType()),
])
