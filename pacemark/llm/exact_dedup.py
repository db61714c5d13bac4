"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

* Every text is normalised (each run of white space becomes one space; null counts as empty)
  and hashed. Entries (row key, hash, digest) are written to the shared folder.
* The directory maps the leading bits of a hash to a bucket. A bucket with more distinct hashes
  than it may hold is split on its next bit; the directory doubles while a bucket's depth
  exceeds its own. Copies are one hash, so a hot text never splits a bucket.
* Owners group (hash, text): equal hashes with different bytes become links of a chain,
  ordered by their smallest key. Copies are counted in the map tasks before they are shuffled.
* The index (bucket, hash, chain position, digest, smallest key, size) is written in key ranges.

Results do not depend on the bucket size or on the number of hash bits. Rows without a key take
part in their group, but a group keeps its smallest present key; in a group without one all keys
are null. Rows with the same key and equal text count as copies and are all marked kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.session import new_table_path, written

#: Distinct hashes a bucket may hold.
BUCKET_HASHES = 50_000
#: Depth beyond which a bucket is not split: its hashes would differ in nothing else.
MOST_BITS = 40


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " ")


def leading_bits(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit hash as a number."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(h, 64 - depth)


def _hash(bits: int) -> Column:
    h = F.xxhash64("norm")
    return h if bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


@dataclass
class Index:
    """``directory``: slot, bucket, depth; ``entries``: one row per row; ``nodes``: one row per distinct text."""

    directory: DataFrame
    global_depth: int
    entries: DataFrame
    nodes: DataFrame


def build_directory(hashes: DataFrame, bucket_hashes: int = BUCKET_HASHES) -> tuple[DataFrame, int]:
    """Split overfull buckets until none is; ``hashes`` has one row per distinct hash ``h``.

    A bucket is named by its depth and its leading bits. Each round counts only what is still
    open; the directory has ``2 ** global depth`` slots, several of which may share a bucket.
    """
    spark = hashes.sparkSession
    total = hashes.count()
    depth = max(0, (max(1, total) // max(1, bucket_hashes)).bit_length() - 1)
    closed: list[DataFrame] = []
    open_hashes = hashes
    while True:
        counts = open_hashes.groupBy(leading_bits(F.col("h"), depth).alias("prefix")).agg(F.count("*").alias("n"))
        counts = written(counts, "directory-round")
        over = counts.where((F.col("n") > bucket_hashes) & F.lit(depth < MOST_BITS)).select("prefix")
        done = counts.join(over, "prefix", "left_anti") if depth < MOST_BITS else counts
        closed.append(done.select("prefix", F.lit(depth).alias("depth"), "n"))
        if not over.take(1):
            break
        open_hashes = (open_hashes.withColumn("prefix", leading_bits(F.col("h"), depth))
                       .join(over, "prefix", "left_semi").drop("prefix"))
        depth += 1
    buckets = closed[0]
    for more in closed[1:]:
        buckets = buckets.unionByName(more)
    # a bucket of a smaller depth has several slots in the doubled directory
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("depth"))
    slots = buckets.select(
        F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("slot"),
        F.concat_ws("/", "depth", "prefix").alias("bucket"), "depth", F.col("n").alias("n_hashes"))
    path = new_table_path(spark, "directory")
    slots.write.parquet(path)
    return spark.read.parquet(path), depth


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_hashes: int = BUCKET_HASHES,
                hash_bits: int = 64) -> Index:
    """The index over all rows of ``docs``. ``hash_bits`` below 64 provokes collisions, for tests."""
    plain = docs.select(F.col(key).alias("row_key"), normalised(F.col(text)).alias("norm"))
    plain = plain.withColumn("h", _hash(hash_bits))
    entries = written(plain.select("row_key", "h", F.unhex(F.sha2("norm", 256)).alias("digest")), "entries")
    directory, depth = build_directory(entries.groupBy("h").agg(F.count("*").alias("n")).select("h"), bucket_hashes)
    texts = plain.groupBy("h", "norm").agg(F.min("row_key").alias("keep_key"), F.count("*").alias("size"))
    nodes = (texts.select("h", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_key", "size")
             .withColumn("slot", leading_bits(F.col("h"), depth)).join(directory.select("slot", "bucket"), "slot").drop("slot"))
    # owners write key ranges; a chain is as long as the number of different texts with one hash
    ranges = nodes.repartitionByRange("h").sortWithinPartitions("h", F.col("keep_key").asc_nulls_last())
    return Index(directory, depth, entries, written(ranges, "index"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_hashes: int = BUCKET_HASHES,
                 hash_bits: int = 64) -> DataFrame:
    """Per row: its key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    index = build_index(docs, key, text, bucket_hashes, hash_bits)
    # texts without copies keep themselves, so only groups are looked up; their rows are few columns wide
    groups = index.nodes.where("size > 1").select("h", "digest", "keep_key", "size")
    found = index.entries.join(groups, ["h", "digest"], "left")
    in_group = F.col("size").isNotNull()
    keep = F.when(in_group, F.col("keep_key")).otherwise(F.col("row_key"))
    return found.select(
        F.col("row_key").alias(key), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("row_key").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def chains(index: Index) -> DataFrame:
    """Hashes that several different texts share: their number, by bucket."""
    return index.nodes.groupBy("bucket", "h").agg(F.count("*").alias("length")).where("length > 1")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, whatever their names, of the rows that stay. Rows without a key, or with a key that
    occurs twice, stay only if their own text is the kept one."""
    copies = exact_groups(docs, key, text).where(~F.col("kept")).select(F.col(key).alias("copy"), "text_sha256")
    gone = written(copies, "copies").distinct()
    same = docs[key].eqNullSafe(gone["copy"]) & (F.sha2(normalised(docs[text]), 256) == gone["text_sha256"])
    return docs.join(gone, same, "left_anti")
