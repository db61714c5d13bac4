"""Estimates for rows as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pacemark.operators.scoring import estimate


def start_estimates(arrivals: DataFrame, model: PipelineModel, names: list[str], name: str,
                    target: str, checkpoint: str) -> StreamingQuery:
    """Score arriving rows and append them; nothing is kept between batches.

    The centroid behind the complexity score is the one of training, so a row's
    features do not depend on what arrives with it.
    """
    scored = estimate(arrivals, model, names, name)
    return (scored.writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
