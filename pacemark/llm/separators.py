"""Token counts from flat token files: where documents end, without an index.

A flat stream holds token ids of one document after the other, each followed by an end id, and is
kept as blocks of ``block_ids`` ids that take no notice of documents. A scan of a block finds its
end ids with one vector comparison and reports their places and what lies after the last. A prefix scan over these summaries, one small row per block, gives every block
the number of documents before it and the ids of the document it begins in. So a document that
spans any number of blocks is counted once, by the block that holds its end.

Ids behind the last end id of a stream are an unfinished document; they are reported with
``finished`` false. Null and empty texts are streams entries of the end id alone, with 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pacemark.llm.tokens import DEFAULT_VOCABULARY, encoder
from pacemark.session import new_table_path, written

#: The end-of-text id of the vocabulary; no text contains it.
END_ID = 50256
BLOCK_IDS = 1 << 16
#: Prefix sums restart after so many blocks of a stream; runs are stitched by a second, smaller scan.
RUN_BLOCKS = 4096


def _width(end_id: int) -> str:
    return "<u2" if end_id < 1 << 16 else "<u4"


def write_streams(docs: DataFrame, path: str, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY,
                  end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Tokenise texts into flat streams, one per task, as blocks: ``stream``, ``block``, ``ids`` (2 bytes each)."""
    plain = docs.select(F.col(text).cast("string").alias("text"))
    width = _width(end_id)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        stream, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        size = 0

        def out(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([stream], pa.int64()), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary())],
                names=["stream", "block", "ids"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(lo, 256).to_pylist():
                    ids = np.append(encode(text), np.uint32(end_id)).astype(width)
                    held.append(ids)
                    size += len(ids)
                    if size >= block_ids:
                        joined = np.concatenate(held)
                        whole = len(joined) // block_ids
                        for i in range(whole):
                            yield out(joined[i * block_ids:(i + 1) * block_ids])
                            block += 1
                        held = [joined[whole * block_ids:]]
                        size = len(held[0])
        if size:
            yield out(np.concatenate(held))

    plain.mapInArrow(rows, "stream long, block long, ids binary").write.option("compression", "zstd").parquet(path)


def _summaries(blocks: DataFrame, end_id: int) -> DataFrame:
    """Per block: ids, ``at`` (places of end ids), their number, and the ids after the last (all where there is none)."""
    width = _width(end_id)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids in enumerate(batch.column(2)):
                got = np.frombuffer(ids.as_py() or b"", dtype=width)
                at = np.flatnonzero(got == end_id)
                tail = len(got) - 1 - int(at[-1]) if len(at) else len(got)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(got)], pa.int64()),
                     pa.array([len(at)], pa.int64()), pa.array([tail], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                    names=["stream", "block", "n", "ends", "tail", "at"])

    return blocks.select("stream", "block", "ids").mapInArrow(
        rows, "stream long, block long, n long, ends long, tail long, at array<long>")


def prefix_scan(summaries: DataFrame, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Per block: ``before_ids``, ``before_ends`` and ``open_ids`` (ids of the document it begins in).

    Blocks are scanned in runs of bounded length; the totals of the runs are scanned in turn.
    """
    blocks = summaries.withColumn("run", F.floor(F.col("block") / run_blocks).cast("long"))
    inside = W.partitionBy("stream", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # position right behind the last end id so far, counted from the start of the run
    local = blocks.withColumns({"ids_here": F.coalesce(F.sum("n").over(inside), F.lit(0)),
                                "ends_here": F.coalesce(F.sum("ends").over(inside), F.lit(0))})
    local = local.withColumn("cut", F.when(F.col("ends") > 0, F.col("ids_here") + F.col("n") - F.col("tail")))
    local = local.withColumn("cut_here", F.max("cut").over(inside))
    runs = local.groupBy("stream", "run").agg(F.sum("n").alias("run_n"), F.sum("ends").alias("run_ends"),
                                              F.max("cut").alias("run_cut"))
    earlier = W.partitionBy("stream").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns({"run_ids": F.coalesce(F.sum("run_n").over(earlier), F.lit(0)),
                             "run_before": F.coalesce(F.sum("run_ends").over(earlier), F.lit(0))})
    runs = runs.withColumn("run_start", F.coalesce(
        F.max(F.col("run_ids") + F.col("run_cut")).over(earlier), F.lit(0))).select(
        "stream", "run", "run_ids", "run_before", "run_start")
    both = local.join(runs, ["stream", "run"])
    before = F.col("run_ids") + F.col("ids_here")
    begin = F.coalesce(F.col("run_ids") + F.col("cut_here"), F.col("run_start"))
    return both.select("stream", "block", "n", "ends", "tail", before.alias("before_ids"),
                       (F.col("run_before") + F.col("ends_here")).alias("before_ends"), (before - begin).alias("open_ids"))


def token_counts(blocks: DataFrame, end_id: int = END_ID, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Per document: ``stream``, ``ordinal``, ``start`` (id in the stream), ``n_tokens``, ``finished``."""
    found = written(_summaries(blocks, end_id), "block-ends")
    scanned = written(prefix_scan(found.drop("at"), run_blocks), "block-prefixes")
    # the places of end ids are one number per document; the ids themselves are read once only
    joined = found.select("stream", "block", "at").where(F.size("at") > 0).join(
        scanned.select("stream", "block", "before_ids", "before_ends", "open_ids"), ["stream", "block"])
    starts = F.transform("at", lambda p, i: F.when(i == 0, -F.col("open_ids")).otherwise(F.element_at("at", F.greatest(i, F.lit(1))) + 1))
    spans = joined.withColumn("starts", starts).select(
        "stream", "before_ids", "before_ends", F.posexplode(F.arrays_zip("at", "starts")).alias("i", "span"))
    done = spans.select("stream", (F.col("before_ends") + F.col("i")).alias("ordinal"),
                        (F.col("before_ids") + F.col("span.starts")).alias("start"),
                        (F.col("span.at") - F.col("span.starts")).alias("n_tokens"), F.lit(True).alias("finished"))
    # a whole stream's end: its last block, whose tail no later block finishes
    last = scanned.groupBy("stream").agg(F.max(F.struct("block", "n", "ends", "tail", "before_ids", "before_ends", "open_ids")).alias("b"))
    tail = F.col("b.tail") + F.when(F.col("b.ends") == 0, F.col("b.open_ids")).otherwise(F.lit(0))
    rest = last.select("stream", (F.col("b.before_ends") + F.col("b.ends")).alias("ordinal"),
                       (F.col("b.before_ids") + F.col("b.n") - tail).alias("start"), tail.alias("n_tokens"),
                       F.lit(False).alias("finished")).where("n_tokens > 0")
    return done.union(rest)


def document_token_counts(docs: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY,
                          end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the documents as flat streams to the shared folder and count them from there."""
    path = new_table_path(docs.sparkSession, "token-streams")
    write_streams(docs, path, text, vocabulary, end_id, block_ids)
    return token_counts(docs.sparkSession.read.parquet(path), end_id)
