"""Sinks. Nothing overwrites the path it reads; per-repo and per-encoder parts are
replaced one partition at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pacemark.operators import keys
from pacemark.sources.readers import CSV, path_exists
from pacemark.sources.schemas import KEY


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    if partition_by:
        gathered(df, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def gathered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one folder together, so that a task writes few files; adaptive execution splits large folders."""
    return df.hint("rebalance", *columns)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``readers`` reads back unchanged, line breaks in texts included."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Write a cleaned table next to the one it was read from; earlier versions stay."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions ``df`` has rows for, in one commit."""
    (gathered(df, [column]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))


def save_partial_pairs(pairs: DataFrame, path: str) -> None:
    """Progress of one or more repositories; a rerun replaces just those."""
    replace_partitions(pairs, path, "repo")


def save_encoder_features(features: DataFrame, path: str) -> None:
    """Features of one or more encoders side by side; readers pick by value."""
    replace_partitions(features, path, "encoder")


def write_predictions(predictions: DataFrame, path: str) -> None:
    write_table(predictions, path, ["model", "split"])


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_checked(log: DataFrame, new: DataFrame, path: str) -> None:
    """Add keys to the log of seen items, each once; keys it already holds are not repeated.

    Of several rows of a new key the smallest in its other columns, in their order, is kept.
    """
    order = [c for c in new.columns if c not in KEY]
    keys.keep_first(keys.only_new(new, log, KEY), KEY, order or KEY).write.mode("append").parquet(path)


def refresh_feature_cache(spark: SparkSession, cache_path: str, target_path: str,
                          pairs: DataFrame, compute) -> DataFrame:
    """Compute features for pairs the cache lacks and keep them.

    ``compute`` gets the missing pairs, each once. With one path for both, their rows are added to the
    cache and nothing else is written. With two, cache plus new rows go to ``target_path`` and the old
    cache stays as it is. Returned are the rows for ``pairs``.
    """
    if path_exists(spark, cache_path):
        cached = spark.read.parquet(cache_path)
        if target_path == cache_path:
            fresh = compute(keys.only_new(pairs, cached, KEY).dropDuplicates(KEY))
            gathered(fresh, ["repo"]).write.mode("append").partitionBy("repo").parquet(target_path)
            return spark.read.parquet(target_path).join(pairs.select(*KEY).distinct(), KEY, "left_semi")
        merged = keys.newest_wins(cached, compute(keys.only_new(pairs, cached, KEY)), KEY)
    else:
        merged = compute(pairs)
    write_table(merged, target_path, ["repo"])
    return spark.read.parquet(target_path).join(pairs.select(*KEY).distinct(), KEY, "left_semi")
