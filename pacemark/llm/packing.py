"""Lexical retrieval packing: documents that share rare tokens fill a window together.

* Every document becomes its token ids and an end id. Whole windows are cut off its front and are
  sequences by themselves; only the rest (shorter than a window) is packed.
* Rests are dealt evenly over shards of about ``shard_rests`` rows, whose number grows with the
  input. Token document frequencies, their number and mean length are counted over all rests.
* Each shard holds a BM25 inverted index over its rests. A seed (the first unused rest) asks it with all its
  tokens for unused neighbours; all that fit enter in order of their score, and the best of what is
  left is cut to fill the window to the last id. Only when no unused rest shares a token with the seed,
  the next unused rest follows. A seed asks no other shard. So only the last sequence of a shard can be padded.

Null and empty texts are the end id alone. Rows with the same key, or none, are packed one by one.
Ties of scores go to the earlier rest; rests are ordered by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.llm.tokens import DEFAULT_VOCABULARY, encoder
from pacemark.session import written

WINDOW, END_ID, SHARD_RESTS = 1024, 0, 2048
#: BM25: saturation and length share.
K1, B = 1.2, 0.75
#: Tokens in more than this part of a shard's rests have a row of all rests instead of a posting list.
DENSE = 1 / 32
#: First sequence number of packed rests; whole windows are numbered from below.
_PACKED = 1 << 62


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, key: str, text: str, window: int, vocabulary: str, end_id: int, keep_ids: bool) -> DataFrame:
    """Per row: ``row_key``, ``row`` (unique), ``tokens``, ``base`` (its first sequence), ``crcs`` of its whole
    windows, ``start`` and ``rest`` (ids, 32 bits each) and, if wanted, ``front`` (ids of whole windows)."""
    plain = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    kind = dict(plain.dtypes)["row_key"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        task = TaskContext.get().partitionId() << 38
        row, sequence = task, task
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                made: list[list] = [[] for _ in range(7)]
                for text in part.column(1).to_pylist():
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // window
                    crcs = [_crc(ids[i * window:(i + 1) * window]) for i in range(whole)]
                    values = (row, len(ids), sequence, crcs, whole * window, ids[whole * window:].tobytes(),
                              ids[:whole * window].tobytes() if keep_ids else None)
                    for column, value in zip(made, values):
                        column.append(value)
                    row, sequence = row + 1, sequence + whole
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, type=t) for c, t in zip(made, kinds))],
                    names=["row_key", "row", "tokens", "base", "crcs", "start", "rest", "front"])

    return plain.mapInArrow(rows, f"row_key {kind}, row long, tokens long, base long, crcs array<long>, start long, "
                                  "rest binary, front binary")


def _frequencies(rests: DataFrame) -> DataFrame:
    """``token``, ``n``: rests that hold it; token -1 counts rests, token -2 their ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, total = np.zeros(1 << 16, dtype=np.int64), 0, 0
        for batch in batches:
            for rest in batch.column(0).to_pylist():
                ids = np.unique(np.frombuffer(rest, dtype="<u4"))
                if len(ids) and ids[-1] >= len(counts):
                    counts = np.append(counts, np.zeros(int(ids[-1]) + 1, dtype=np.int64))
                counts[ids] += 1
                n, total = n + 1, total + len(rest) // 4
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2])), pa.array(np.append(counts[seen], [n, total]))], names=["token", "n"])

    return rests.select("rest").mapInArrow(rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Shard:
    """BM25 index over the rests of one shard."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        self.rests, self.idf = rests, idf
        lengths = np.array([len(r) for r in rests])
        owner = np.repeat(np.arange(len(rests), dtype=np.int64), lengths)
        pairs, count = np.unique(np.concatenate(rests).astype(np.int64) * len(rests) + owner, return_counts=True)
        token, self.doc = pairs // len(rests), pairs % len(rests)
        weight = count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[self.doc] / mean))
        self.weight = weight * idf[token]
        self.tokens, self.first = np.unique(token, return_index=True)
        self.first = np.append(self.first, len(token))
        # the tokens of each rest, ascending, by their places in ``tokens``; small numbers sort by digits
        small = self.doc.astype(np.uint16) if len(rests) <= 1 << 16 else self.doc
        self.own = np.repeat(np.arange(len(self.tokens)), np.diff(self.first))[np.argsort(small, kind="stable")]
        self.begin = np.append(0, np.cumsum(np.bincount(self.doc, minlength=len(rests))))
        self.row = np.full(len(self.tokens), -1)
        often = np.flatnonzero(np.diff(self.first) > DENSE * len(rests))
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(rests)))
        for k, t in enumerate(often):
            span = slice(self.first[t], self.first[t + 1])
            self.dense[k, self.doc[span]] = self.weight[span]

    def places(self, i: int) -> np.ndarray:
        """Where the tokens of a rest are in ``tokens``."""
        return self.own[self.begin[i]:self.begin[i + 1]]

    def neighbours(self, seed: np.ndarray, unused: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Unused rests that share a token with the seed, best first; ``at`` are the places of its tokens, if known."""
        at = np.searchsorted(self.tokens, np.unique(seed)) if at is None else at
        rows = self.row[at]
        scores = np.zeros(len(self.rests))
        for k in rows[rows >= 0]:
            scores += self.dense[k]
        spans = [slice(self.first[a], self.first[a + 1]) for a in at[rows < 0]]
        if spans:
            scores += np.bincount(np.concatenate([self.doc[s] for s in spans]),
                                  weights=np.concatenate([self.weight[s] for s in spans]), minlength=len(self.rests))
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


def fill(rests: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of a shard: rest, first id in it, length, sequence, offset. Each id is in one piece."""
    index = Shard(rests, idf, mean)
    at = np.zeros(len(rests), dtype=np.int64)
    left = np.array([len(r) for r in rests])
    unused = left > 0
    sequence = seed = 0
    while True:
        while seed < len(rests) and not unused[seed]:
            seed += 1
        if seed == len(rests):
            return
        offset = 0

        def take(i: int, n: int):
            nonlocal offset
            piece = (i, int(at[i]), n, sequence, offset)
            at[i] += n
            left[i] -= n
            unused[i] = left[i] > 0
            offset += n
            return piece

        yield take(seed, int(left[seed]))
        best = index.neighbours(rests[seed], unused, index.places(seed))
        lengths = left[best]
        # the shortest from each place on: where it does not fit, nothing after it does
        shortest = np.minimum.accumulate(lengths[::-1])[::-1]
        for i, n, least in zip(best.tolist(), lengths.tolist(), shortest.tolist()):
            if window - offset < least:
                break
            if n <= window - offset:
                yield take(i, n)
        onward = iter(best[unused[best]][:1])
        following = seed
        while offset < window:
            i = next(onward, None)
            if i is None:
                following += 1
                while following < len(rests) and not unused[following]:
                    following += 1
                if following >= len(rests):
                    break
                i = following
            yield take(int(i), int(min(left[i], window - offset)))
        sequence += 1


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
         vocabulary: str = DEFAULT_VOCABULARY, shard_rests: int = SHARD_RESTS, keep_ids: bool = False) -> DataFrame:
    """Per piece: its key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``; ``ids`` if wanted."""
    made = written(cut(docs, key, text, window, vocabulary, end_id, keep_ids), "cut")
    rests = made.where(F.octet_length("rest") > 0)
    # one row per id of the vocabulary at most
    counts = _frequencies(rests).toPandas()
    counts = dict(zip(counts["token"].tolist(), counts["n"].tolist()))
    n, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(max(counts, default=0) + 1)
    df[list(counts)] = list(counts.values())
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    given = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), total / max(n, 1)))
    shards = max(1, -(-n // shard_rests))
    kind = dict(made.dtypes)["row_key"]
    schema = (f"row_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "ids binary")

    def shard(got: pa.Table) -> pa.Table:
        got = got.sort_by("row")
        idf, mean = given.value
        own = [np.frombuffer(r, dtype="<u4") for r in got["rest"].to_pylist()]
        number = got["shard"][0].as_py()
        found = list(fill(own, window, idf, mean))
        rest, first, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*found))
        ids = [own[i][a:a + n] for i, a, n, _, _ in found]
        at = pa.array(rest)
        start = got["start"].to_numpy()[rest] + first
        return pa.table({
            "row_key": got["row_key"].take(at), "start": start, "length": length,
            "ids_crc32": pa.array([_crc(x) for x in ids], type=pa.int64()), "doc_tokens": got["tokens"].take(at),
            "sequence_id": sequence + (_PACKED + (number << 32)), "offset": offset,
            "ids": pa.array([x.tobytes() if keep_ids else None for x in ids], type=pa.binary())})

    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    packed = dealt.select("shard", "row", "row_key", "tokens", "start", "rest").groupBy("shard").applyInArrow(shard, schema)
    whole = made.select("row_key", "tokens", "base", "front", F.posexplode("crcs").alias("i", "crc")).select(
        "row_key", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.col("base") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        (F.substring("front", F.col("i") * (4 * window) + 1, F.lit(4 * window)) if keep_ids else F.lit(None).cast("binary"))
        .alias("ids"))
    out = whole.unionByName(packed).withColumnRenamed("row_key", key)
    return out if keep_ids else out.drop("ids")
