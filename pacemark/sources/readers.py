"""Scans. CSV is read with a declared schema, since texts hold line breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pacemark.sources import schemas

# white space at the ends of a text and microseconds of a time survive the round trip
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
       "ignoreTrailingWhiteSpace": False, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**CSV, multiLine=True).schema(schema).csv(path)


def read_named(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """``name`` as Parquet, else as CSV, else an error that says what was looked for."""
    parquet, csv = f"{folder}/{name}.parquet", f"{folder}/{name}.csv"
    if path_exists(spark, parquet):
        return spark.read.parquet(parquet)
    if path_exists(spark, csv):
        if schema is None:
            return spark.read.options(**CSV, multiLine=True, inferSchema=True).csv(csv)
        return read_csv(spark, csv, schema)
    raise FileNotFoundError(f"neither {parquet} nor {csv} exists")


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return read_named(spark, folder, "issue_pr_pairs", schemas.ISSUE_PAIRS)


def read_partner(spark: SparkSession, path: str) -> DataFrame:
    """Somebody else's pairs; the suffix decides the format, others are refused."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return read_csv(spark, path, schemas.ISSUE_PAIRS)
    raise ValueError(f"unsupported format: {path}")


def read_features(spark: SparkSession, path: str, encoder: str | None = None) -> DataFrame:
    """A feature table; with ``encoder`` only that partition is scanned."""
    table = spark.read.parquet(path)
    return table if encoder is None else table.where(F.col("encoder") == encoder).drop("encoder")


def read_predictions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if split is None else table.where(F.col("split") == split)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON document or list; malformed input is an error, not empty rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def valid_repos(validation: DataFrame) -> DataFrame:
    """The allow-list a validation result amounts to."""
    return validation.where("passes_all").select("repo").distinct()


def read_checked_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """A per-repo log of seen item numbers as a key table."""
    log = read_json(spark, path, schemas.CHECKED_LOG)
    return log.select(
        F.lit(repo).alias("repo"),
        F.explode("checked").alias("issue_number"),
        F.to_timestamp("last_updated").alias("checked_at"))
