"""Ranked lexical search by hashed max-sketches.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. The index holds one
row per document with a term: its key, its number of terms, its text and a sketch. The sketch has ``HASH_ROWS`` rows of
cells; each term of the document enters one cell of every row, and a cell keeps the largest occurrence count that it
met. The impact of a term grows with its count and, inside a document, depends on nothing else, so a cell stands for the
largest impact of its terms. The number of cells follows the number of different terms, so texts of any length have
sketches as sparse as the others'.

A batched lookup reads, for all terms of a block of items at once, the least of the term's cells; the weighted sum is an
upper bound of the document's score. First the documents with the largest bounds of each item are scored exactly: the
k-th best score is a threshold that no result lies below. Then every task goes through its documents by descending bound
and scores them exactly, until the bounds fall below the threshold, which rises with what the task has found. Nothing
but bounds below the threshold is skipped, so the result is exact.

Defined results: a null or empty text has no terms, is not counted and is never found; an item without terms finds
nothing; rows of one item id are one item with all their terms; rows that repeat a document key are documents of their
own; equal scores are ordered by ascending key, nulls last; empty tables give no rows. Only the named columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacemark.llm.text_arrays import PLAIN, constants, mix, pieces, slices, strings, word_bounds, word_hashes
from pacemark.session import new_table_path, written

HASH_ROWS = 3
#: Cells of a row for each different term, before rounding up to a power of two.
CELLS = 4
#: Items (or, if sooner, item terms) that are looked up at once; a longer item is a block of its own.
BLOCK_ITEMS, BLOCK_TERMS = 256, 16_384
#: Documents by bound, for each result wanted, that are scored to find the first threshold.
SEEDS = 4
#: Cells looked up at once in a task, and documents scored between two looks at the threshold.
LOOKUPS, STEP = 1 << 21, 64

_SALT = constants(HASH_ROWS, 71)


def _rows_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each different term of each row, and its count; places are ordered by row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    return order[new], np.diff(np.append(new, len(h))), row[new]


def _sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of terms, cells of all sketches, and where each sketch begins."""
    starts, ends, first = word_bounds(data, offsets, PLAIN)
    h = word_hashes(data, starts, ends)
    place, count, row = _counted(h, _rows_of(first))
    different = np.bincount(row, minlength=len(offsets) - 1)
    width = np.where(different > 0, 1 << np.ceil(np.log2(np.maximum(different * CELLS, 8))).astype(np.int64), 0)
    at = np.concatenate(([0], np.cumsum(width * HASH_ROWS)))
    cells = np.zeros(at[-1], dtype=np.uint8)
    count = np.minimum(count, 255).astype(np.uint8)
    for k in range(HASH_ROWS):
        cell = (mix(h[place] ^ _SALT[k]) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
        np.maximum.at(cells, at[row] + k * width[row] + cell, count)
    return np.diff(first), cells, at


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index (place, row_key, n, text, sketch) and the dictionary (term, df), both written to the shared folder."""
    plain = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    kind = dict(plain.dtypes)["row_key"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                n, cells, at = _sketches(data, offsets)
                sketch = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32).tobytes()),
                                                                      pa.py_buffer(cells.tobytes())])
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), batch.column(1).slice(lo, hi - lo), sketch],
                    names=["row_key", "n", "text", "sketch"])
                yield out.filter(pa.array(n > 0))

    made = plain.mapInArrow(rows, f"row_key {kind}, n long, text string, sketch binary")
    path = new_table_path(docs.sparkSession, "max-sketches")
    made.withColumn("place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    index = docs.sparkSession.read.parquet(path)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _lo, _hi, data, offsets in pieces(batch.column(0)):
                starts, ends, first = word_bounds(data, offsets, PLAIN)
                h = word_hashes(data, starts, ends)
                place, _, _ = _counted(h, _rows_of(first))
                _, one, df = np.unique(h[place], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([strings(*slices(data, starts[place[one]], ends[place[one]])),
                                                  pa.array(df.astype(np.int64))], names=["term", "df"])

    dictionary = index.select("text").mapInArrow(terms, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return index, written(dictionary, "dictionary")


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """The different terms of each item."""
    plain = items.select(F.col(item).alias("item_key"), F.col(text).cast("string").alias("text"))
    kind = dict(plain.dtypes)["item_key"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _hi, data, offsets in pieces(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets, PLAIN)
                place, _, row = _counted(word_hashes(data, starts, ends), _rows_of(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)),
                                                  strings(*slices(data, starts[place], ends[place]))], names=["item_key", "term"])

    return plain.mapInArrow(rows, f"item_key {kind}, term string").distinct()


class Block:
    """Terms, weights and item numbers of a block of items, with what documents need for their scores."""

    def __init__(self, entries: list[tuple[int, str, int]], items: int, total: int, length: int):
        names = sorted({(t, w) for _, t, w in entries})
        self.items, self.total, self.length = items, total, length
        raw = [t.encode() for t, _ in names]
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
        h = word_hashes(self.data, self.at[:-1], self.at[1:])
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        number = {t: i for i, (t, _) in enumerate(names)}
        self.weights = np.zeros((len(names), items))
        for i, t, w in entries:
            self.weights[number[t], i] = w
        # sums of integers below 2^53 are exact in doubles
        if self.weights.sum(axis=0).max(initial=0) * 1e6 >= 2 ** 53:
            self.weights = self.weights.astype(np.int64)
        self.rough = self.weights.astype(np.float32)
        self.salted = [mix(h ^ _SALT[k]) for k in range(HASH_ROWS)]

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 100 - 90 + (90 * n.astype(np.int64) * self.total) // self.length

    def bounds(self, n: np.ndarray, cells: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the batch and upper bounds of their scores (rows x items), some rows at a time."""
        width = np.diff(at) // HASH_ROWS
        m = self.norm(n)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            place = [(s & np.uint64(w - 1)).astype(np.int64) + k * w for k, s in enumerate(self.salted)]
            step = max(1, LOOKUPS // max(len(self.at), int(w) * HASH_ROWS))
            for lo in range(0, len(rows), step):
                own = rows[lo:lo + step]
                sketch = cells[at[own][:, None] + np.arange(w * HASH_ROWS)]
                found = sketch[:, place[0]]
                for p in place[1:]:
                    np.minimum(found, sketch[:, p], out=found)
                tf = found.astype(np.float32)
                # a full cell says "at least 255"
                tf[found == 255] = np.inf
                with np.errstate(invalid="ignore", divide="ignore"):
                    impact = np.float32(1e6) / (1 + (8 * m[own][:, None] / np.float32(1000)).astype(np.float32) / tf)
                # room for the rounding of single precision
                yield own, (impact @ self.rough).astype(np.float64) * (1 + 1e-4)

    def scores(self, texts: pa.Array, n: np.ndarray) -> np.ndarray:
        """Exact scores (rows x items) from whole texts."""
        out = np.zeros((len(n), self.items), dtype=np.int64)
        if not len(self.order):
            return out
        m = self.norm(n)
        for lo, hi, data, offsets in pieces(texts):
            starts, ends, first = word_bounds(data, offsets, PLAIN)
            h = word_hashes(data, starts, ends)
            near = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            hit = np.flatnonzero(self.sorted[near] == h)
            term, row = self.order[near[hit]], _rows_of(first)[hit]
            same = self._equal(data, starts[hit], ends[hit], term)
            term, row = term[same], row[same]
            tf = np.bincount(row * len(self.order) + term, minlength=(hi - lo) * len(self.order)).reshape(hi - lo, -1)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[lo:hi, None])
            out[lo:hi] = (impact.astype(self.weights.dtype) @ self.weights).astype(np.int64)
        return out

    def _equal(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes of its term."""
        same = (ends - starts) == (self.at[term + 1] - self.at[term])
        own, other = slices(data, starts[same], ends[same]), slices(self.data, self.at[term[same]], self.at[term[same] + 1])
        if len(own[0]):
            same[same] = np.logical_and.reduceat(own[0] == other[0], own[1][:-1])
        return same


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    _, index, data = column.buffers()
    at = np.frombuffer(index, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


class _Best:
    """The best ``k`` scores of every item that a task has found, ties by key."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor, self.held, self.rows = k, floor.copy(), [], 0

    def add(self, items: np.ndarray, keys: pa.Array, scores: np.ndarray) -> None:
        if len(items):
            self.held.append(pa.table({"item": items, "row_key": keys, "score": scores}))
            self.rows += len(items)
            if self.rows > 4 * self.k * len(self.floor) + 1024:
                self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        table = pa.concat_tables(self.held).combine_chunks()
        table = table.take(pc.sort_indices(table, [("item", "ascending"), ("score", "descending"), ("row_key", "ascending")]))
        items, scores = table["item"].to_numpy(), table["score"].to_numpy()
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[items[last]] = np.maximum(self.floor[items[last]], scores[last])
        table = table.filter(pa.array(rank < self.k))
        self.held, self.rows = [table], table.num_rows
        return table


def _largest_bounds(index: DataFrame, block, k: int) -> DataFrame:
    """The ``k`` documents with the largest bounds of each item: item, place, bound."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        best = np.zeros((own.items, 0))
        where = np.zeros((own.items, 0), dtype=np.int64)
        for batch in batches:
            place, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, bounds in own.bounds(n, *_flat(batch.column(2))):
                best = np.concatenate((best, bounds.T), axis=1)
                where = np.concatenate((where, np.broadcast_to(place[at], bounds.T.shape)), axis=1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, where = np.take_along_axis(best, top, 1), np.take_along_axis(where, top, 1)
        item, col = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(where[item, col]), pa.array(best[item, col])],
                                         names=["item", "place", "bound"])

    found = index.select("place", "n", "sketch").mapInArrow(rows, "item long, place long, bound double")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "place")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def _thresholds(index: DataFrame, seeds: DataFrame, block, k: int, items: int) -> np.ndarray:
    """The ``k``-th best exact score of the seeds of each item, 1 where there are fewer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        best = np.zeros((0, own.items), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                best = np.concatenate((best, own.scores(part.column(0), part.column(1).to_numpy())))
                if len(best) > k:
                    best = -np.partition(-best, k - 1, axis=0)[:k]
        row, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[row, item])], names=["item", "score"])

    # at most SEEDS * k * BLOCK_ITEMS places
    places = seeds.select("place").distinct()
    scored = (index.select("text", "n", "place").join(F.broadcast(places), "place").select("text", "n")
              .mapInArrow(rows, "item long, score long"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc())
    out = np.ones(items, dtype=np.int64)
    for r in scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).collect():
        out[r["item"]] = r["score"]
    return out


def _rescored(index: DataFrame, block, floor: np.ndarray, k: int) -> DataFrame:
    """Exact scores of the documents that may be among the best: item, row_key, score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        best = _Best(k, floor)
        for batch in batches:
            keys, n, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            for at, bounds in own.bounds(n, *_flat(batch.column(3))):
                over = bounds >= best.floor
                some = np.flatnonzero(over.any(axis=1))
                some = some[np.argsort(-(bounds[some] - best.floor).max(axis=1), kind="stable")]
                while len(some):
                    now, some = some[:STEP], some[STEP:]
                    places = pa.array(at[now])
                    scores = own.scores(texts.take(places), n[at[now]])
                    r, item = np.nonzero((scores >= best.floor) & (scores > 0))
                    best.add(item, keys.take(pa.array(at[now][r])), scores[r, item])
                    some = some[(bounds[some] >= best.floor).any(axis=1)]
        left = best.cut()
        if left is not None:
            yield from left.combine_chunks().to_batches()

    kind = dict(index.dtypes)["row_key"]
    return index.select("row_key", "n", "text", "sketch").mapInArrow(rows, f"item long, row_key {kind}, score long")


def _blocks(terms: DataFrame) -> Iterator[tuple[list, list[tuple[int, str, int]]]]:
    """Item ids and (item number, term, df) of one block after the other; only a block is held."""
    ids: list = []
    entries: list[tuple[int, str, int]] = []
    for one, own in groupby(terms.orderBy("item_key").toLocalIterator(), lambda r: r["item_key"]):
        own = [(r["term"], r["df"] or 0) for r in own]
        if ids and (len(ids) == BLOCK_ITEMS or len(entries) + len(own) > BLOCK_TERMS):
            yield ids, entries
            ids, entries = [], []
        entries += [(len(ids), t, df) for t, df in own]
        ids.append(one)
    if ids:
        yield ids, entries


def weight(total: int, df: int) -> int:
    """Of a term that ``df`` of ``total`` documents hold."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def search(items: DataFrame, docs: DataFrame, k: int = 10, item: str = "item_id", item_text: str = "text",
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item, ``rank``, key and ``score``."""
    spark = docs.sparkSession
    index, dictionary = build_index(docs, key, text)
    size = index.agg(F.count("*").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    total, length = size["total"], size["length"]
    item_kind, key_kind = items.select(item).schema[0].dataType, index.schema["row_key"].dataType
    found = spark.createDataFrame([], f"item_key {item_kind.simpleString()}, row_key {key_kind.simpleString()}, score long")
    terms = _item_terms(items, item, item_text).join(dictionary, "term", "left")
    for ids, entries in _blocks(terms) if total else ():
        block = spark.sparkContext.broadcast(Block([(i, t, weight(total, df)) for i, t, df in entries], len(ids), total, length))
        seeds = written(_largest_bounds(index, block, SEEDS * k), "seeds")
        floor = _thresholds(index, seeds, block, k, len(ids))
        names = _names(spark, ids, item_kind)
        found = found.unionByName(_rescored(index, block, floor, k).join(F.broadcast(names), "item").drop("item"))
    order = Window.partitionBy("item_key").orderBy(F.col("score").desc(), F.col("row_key").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("item_key").alias(item), "rank", F.col("row_key").alias(key), "score"))


def _names(spark: SparkSession, ids: list, kind) -> DataFrame:
    """Item ids of a block by number; at most ``BLOCK_ITEMS``."""
    return spark.createDataFrame(list(enumerate(ids)), f"item long, item_key {kind.simpleString()}")
