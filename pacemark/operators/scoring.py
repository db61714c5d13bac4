"""Estimates for new rows from saved models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations
from pacemark.operators import embeddings, history, learning, text_features
from pacemark.operators.unions import stacked
from pacemark.session import written
from pacemark.sources.readers import path_exists
from pacemark.sources.schemas import KEY
from pacemark.sources.sinks import write_metrics


def save_bundle(trained: learning.Trained, folder: str) -> str:
    """Scaler, reducer, assembler and trees as one pipeline; beside it what it was fitted with and its metrics.

    The second table has one row per split: model, split, metrics, ``feature_names`` and ``params`` (JSON).
    """
    return save_bundles([trained], folder)[0]


def save_bundles(trained: list[learning.Trained], folder: str) -> list[str]:
    """``save_bundle`` of several models of different names; the metrics of all are made together."""
    measured = written(learning.split_metrics({t.name: t for t in trained}), "split_metrics")
    paths = [f"{folder}/model_{t.name.lower()}" for t in trained]
    for t, path in zip(trained, paths):
        t.model.write().overwrite().save(path)
        about = measured.where(F.col("model") == t.name).withColumns({
            "feature_names": F.array(*[F.lit(n) for n in t.feature_names]),
            "params": F.lit(json.dumps(t.params, sort_keys=True))})
        write_metrics(about, f"{path}_about")
    return paths


class Bundles:
    """Saved models of a folder, each loaded when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder, self._loaded = spark, folder, {}

    def available(self, name: str) -> bool:
        return path_exists(self._spark, f"{self._folder}/model_{name.lower()}")

    def about(self, name: str) -> DataFrame | None:
        """Metrics of both splits, feature names and settings of a saved model."""
        return self._spark.read.json(f"{self._folder}/model_{name.lower()}_about") if self.available(name) else None

    def get(self, name: str) -> PipelineModel | None:
        if name not in self._loaded and self.available(name):
            self._loaded[name] = PipelineModel.load(f"{self._folder}/model_{name.lower()}")
        return self._loaded.get(name)


def without_history(rows: DataFrame, has_history: str = "has_history") -> DataFrame:
    """Zero history features, but the number of files, where a row's repo is unknown."""
    known = F.col(has_history)
    kept = {c: F.when(known, F.col(c)).otherwise(F.lit(0)) for c in fv.HISTORY_FEATURES if c != "num_files"}
    return rows.withColumns(kept).withColumn("used_real_features", known)


def raw_features(new: DataFrame, vectors: DataFrame, center: DataFrame, commit_files: DataFrame,
                 vector: str = "embedding") -> DataFrame:
    """Rows ready for ``estimate_all`` from title, body, list of files and repo.

    ``new`` has the key, ``issue_title``, ``issue_body``, ``pr_files_changed`` and ``issue_created_at``;
    ``vectors`` a vector per key; ``center`` is the centroid of the training vectors. Rows of repos without
    commits get zeros for their history, rows without a vector are left out.
    """
    texts = text_features.derived_features(new, KEY, F.col("issue_title"), F.col("issue_body"))
    scored = embeddings.complexity_scores(vectors.select(*KEY, vector), vector, center)
    past = history.history_features(new, history.files_of_pairs(new), commit_files)
    repos = commit_files.select("repo").distinct().withColumn("has_history", F.lit(True))
    rows = (texts.join(scored, KEY).join(past, KEY).join(repos, "repo", "left")
            .withColumn("has_history", F.coalesce("has_history", F.lit(False))))
    return without_history(embeddings.with_vector(rows, vector))


def estimate(rows: DataFrame, model: PipelineModel | None, names: list[str], name: str) -> DataFrame:
    """Hours and tier per row; a model that was never trained gives null and the reason."""
    if model is None:
        return rows.select(*KEY, F.lit(name).alias("model"), F.lit(None).cast("double").alias("hours"),
                           F.lit(None).cast("string").alias("effort_tier"),
                           F.lit("Model not trained yet").alias("error"))
    scored = model.transform(learning.aligned(rows, names))
    hours = durations.hours_from_log(F.col("log_prediction"))
    return scored.select(*KEY, F.lit(name).alias("model"), hours.alias("hours"),
                         durations.effort_tier(hours).alias("effort_tier"),
                         F.lit(None).cast("string").alias("error"))


def estimate_all(rows: DataFrame, bundles: Bundles, method: str = "pca") -> DataFrame:
    """Estimates of models A, B and C for each row."""
    parts = [estimate(rows, bundles.get(name), columns, name)
             for name, (columns, _) in learning.variants(method).items()]
    return stacked(*parts)


def with_category(rows: DataFrame, category: str = "category") -> DataFrame:
    """Label and typical hours of a task category; the categories are a fixed short list."""
    spark = rows.sparkSession
    table = spark.createDataFrame(fv.TASK_CATEGORIES, f"{category} string, label string, typical_hours string")
    return rows.join(F.broadcast(table), category, "left")
