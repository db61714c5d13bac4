"""Incremental ingest: rows arrive in batches, rows already held win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pacemark.operators import keys
from pacemark.session import written
from pacemark.sources.readers import path_exists
from pacemark.sources.sinks import gathered

#: Parts of a target; as fixed as the table, since they name its folders.
PARTS = 64


def read_arrivals(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that land under ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def key_part(key: list[str], parts: int = PARTS) -> Column:
    """The part of the target that holds a key."""
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def seen_keys(spark: SparkSession, target: str, number: int, touched: list[int], key: list[str]) -> DataFrame:
    """Keys that batches before ``number`` brought to the touched parts; no other part is read."""
    return (spark.read.parquet(target).where(F.col("key_part").isin(touched) & (F.col("ingest_batch") < number))
            .select("key_part", *key))


def ingest_batch(batch: DataFrame, number: int, target: str, key: list[str], order: list[str], parts: int = PARTS) -> None:
    """Write the rows of one batch whose key no earlier batch brought.

    The target is laid out by a hash of the key, and a batch reads only the parts that its keys fall in, so a small
    delivery to a large table reads little of it. In each part a batch owns one partition and overwrites only that,
    and only earlier partitions count as seen: a batch that is run again after a failure writes the same rows once.
    """
    spark = batch.sparkSession
    first = written(keys.keep_first(batch, key, order).withColumn("key_part", key_part(key, parts)), "arrived")
    if path_exists(spark, target):
        # no more than ``parts`` numbers
        touched = [r["key_part"] for r in first.select("key_part").distinct().collect()]
        first = keys.only_new(first, seen_keys(spark, target, number, touched, key), ["key_part", *key])
    (gathered(first.withColumn("ingest_batch", F.lit(number)), ["key_part"]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("key_part", "ingest_batch").parquet(target))


def start_ingest(arrivals: DataFrame, target: str, checkpoint: str, key: list[str],
                 order: list[str]) -> StreamingQuery:
    """Ingest what has arrived, then stop; the checkpoint remembers which files are done.

    The keys already seen live in the target table and not in stream state, which
    would grow without bound.
    """
    return (arrivals.writeStream
            .foreachBatch(lambda batch, number: ingest_batch(batch, number, target, key, order))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
