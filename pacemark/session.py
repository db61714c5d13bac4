"""Session helpers: a local session for tests and bench, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "pacemark") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # there are only as many partitions as cores, so none are worth merging
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Session settings the results depend on.

    Naive times mean UTC. Spark 4.1 may plan on a union being partitioned like its
    inputs, which stops being true when adaptive execution re-plans one of them; rows
    of one key could then meet in different tasks.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local run without
    that setting falls back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pacemark-"))
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make reliable ``checkpoint()`` usable, in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has written to yet."""
    return f"{shared_folder(spark)}/pacemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For tables that several branches of a plan scan: they are computed once, later
    scans prune columns and push filters, and a lost executor costs a rescan only.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def dealt(spark: SparkSession, rows: int, rows_per_task: int) -> Iterator[None]:
    """What is written inside is shuffled to tasks that follow ``rows``, at least one a core.

    Adaptive execution merges shuffled partitions by their compressed bytes, so that what a task holds in memory would grow
    with the input until they are large.
    """
    wanted = {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))),
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
