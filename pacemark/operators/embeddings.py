"""Text vectors: distance from the centroid and the three ways to shorten them.

Vectors are one array column. Fitting only ever brings statistics of the size of
the vector to the driver, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (PCA, ElementwiseProduct, HashingTF, IDF, StandardScaler,
                                RegexTokenizer, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.pipeline import Transformer
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroid(vectors: DataFrame, column: str) -> DataFrame:
    """The element-wise mean vector, as one array in one row."""
    vector = array_to_vector(F.col(column).cast("array<double>"))
    return vectors.select(Summarizer.mean(vector).alias("mean")).select(
        vector_to_array("mean").alias("centroid"))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def complexity_scores(vectors: DataFrame, column: str, center: DataFrame | None = None) -> DataFrame:
    """One minus the cosine to the centroid; a zero vector scores 1.

    The centroid is that of ``vectors`` unless one from training is given. It is a
    single short array and enters as a scalar.
    """
    center = center if center is not None else centroid(vectors, column)
    c = F.col("centroid")
    known = center.select(F.struct(c.alias("at"), F.sqrt(_dot(c, c)).alias("size"))).scalar()
    rows = vectors.withColumn("_center", known)
    norm = F.sqrt(_dot(F.col(column), F.col(column))) * F.col("_center.size")
    cosine = _dot(F.col(column), F.col("_center.at")) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return rows.withColumn("complexity_score", 1 - cosine).drop("_center")


def hashed_text_vectors(texts: DataFrame, column: str, size: int = 256) -> PipelineModel:
    """A vector per text when none comes with the data: hashed word counts, weighted."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=column, outputCol="_words", pattern="\\s+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size),
        IDF(inputCol="_counts", outputCol="embedding_vector")]).fit(texts)


def with_vector(df: DataFrame, column: str = "embedding", output: str = "embedding_vector") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(column).cast("array<double>")))


def population_scaler(train: DataFrame, column: str, output: str) -> PipelineModel:
    """Centre and scale by the population deviation, fitted on the train rows only.

    Spark divides by the sample deviation; one constant factor makes up for it.
    """
    sample = StandardScaler(inputCol=column, outputCol=f"{output}_sample", withMean=True, withStd=True)
    model = sample.fit(train)
    n = train.count()
    width = len(model.mean)
    factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    rescale = ElementwiseProduct(scalingVec=Vectors.dense([factor] * width),
                                 inputCol=f"{output}_sample", outputCol=output)
    return PipelineModel([model, rescale])


@dataclass
class CorrelationSummary:
    """Correlations of the vector elements with each other and with the target."""

    among: np.ndarray
    with_target: np.ndarray
    n: int


def correlations(train: DataFrame, column: str, target: str) -> CorrelationSummary:
    """One distributed pass; a constant element correlates with nothing."""
    joint = VectorAssembler(inputCols=[column, target], outputCol="_joint").transform(train)
    matrix = np.nan_to_num(Correlation.corr(joint, "_joint").head()[0].toArray())
    return CorrelationSummary(matrix[:-1, :-1], matrix[:-1, -1], train.count())


def f_scores(vectors: DataFrame, column: str, target: str) -> DataFrame:
    """F statistic of each vector element against the target, from five sums per element."""
    y = F.col(target).cast("double")
    long = vectors.where(y.isNotNull()).select(
        y.alias("y"), F.posexplode(F.col(column)).alias("element", "x0")).withColumn(
        "x", F.col("x0").cast("double"))
    r = F.corr("x", "y")
    left = F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))
    score = F.col("r") * F.col("r") / left * (F.col("n") - 2)
    # a perfect correlation leaves nothing to divide by
    return long.groupBy("element").agg(F.count("*").alias("n"), r.alias("r")).select(
        "element", "n", F.when(F.abs("r") >= 1, F.lit(float("inf"))).otherwise(score).alias("f_score"))


def top_elements(summary: CorrelationSummary, k: int) -> list[int]:
    """Indices of the ``k`` elements with the largest F, in index order."""
    r2 = summary.with_target ** 2
    score = r2 / np.maximum(1 - r2, 1e-300)
    return sorted(int(i) for i in np.argsort(-score, kind="stable")[:k])


def pls_rotation(summary: CorrelationSummary, k: int) -> np.ndarray:
    """Rotation of partial least squares with one target, from correlations alone.

    With standardised columns the correlations are the cross products, so the
    components follow without another pass over the rows.
    """
    among, left = summary.among, summary.with_target.copy()
    loadings, rotation = [], []
    for _ in range(k):
        size = np.linalg.norm(left)
        if size < 1e-12:
            break
        w = left / size
        r = w.copy()
        for p, earlier in zip(loadings, rotation):
            r -= (p @ w) * earlier
        spread = r @ among @ r
        if spread < 1e-12:
            break
        p = among @ r / spread
        left = left - p * (r @ left)
        loadings.append(p)
        rotation.append(r)
    return np.array(rotation).T if rotation else np.zeros((len(left), 0))


class Projection(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vector times a fixed matrix, applied to Arrow batches."""

    matrix = Param(Params._dummy(), "matrix", "rows of the matrix, one per input element")

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None,
                 matrix: list | None = None) -> None:
        super().__init__()
        if inputCol is not None:
            self._set(inputCol=inputCol, outputCol=outputCol, matrix=matrix)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = np.array(self.getOrDefault(self.matrix))

        @F.pandas_udf("array<double>")
        def project(batch: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(batch.to_numpy()) @ weights)) if len(batch) else batch

        projected = project(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(projected))


def component_count(n_rows: int, width: int, wanted: int = 50) -> int:
    """As many components as wanted, but no more than rows / 5 or elements."""
    return max(1, min(wanted, n_rows // 5, width, n_rows))


def fit_reducer(train: DataFrame, method: str, k: int | None, hours: str, log_hours: str,
                column: str = "embedding_vector", output: str = "reduced") -> PipelineModel:
    """Scaler plus reducer, fitted on the train rows: ``pca``, ``pls``, ``topk`` or ``none``.

    Elements for ``topk`` are judged on raw hours, components of ``pls`` on log hours.
    """
    if method == "none":
        return PipelineModel([VectorAssembler(inputCols=[column], outputCol=output)])
    scaler = population_scaler(train, column, "_scaled")
    scaled = scaler.transform(train)
    width = len(scaler.stages[0].mean)
    k = min(k, width) if k else component_count(train.count(), width)
    if method == "pca":
        last = PCA(k=k, inputCol="_scaled", outputCol=output).fit(scaled)
    elif method == "topk":
        chosen = top_elements(correlations(scaled, "_scaled", hours), k)
        last = VectorSlicer(inputCol="_scaled", outputCol=output, indices=chosen)
    elif method == "pls":
        summary = correlations(scaled, "_scaled", log_hours)
        n = summary.n
        rotation = pls_rotation(summary, k) * np.sqrt((n - 1) / n)
        last = Projection("_scaled", output, rotation.tolist())
    else:
        raise ValueError(f"unknown method: {method}")
    return PipelineModel([scaler, last])
