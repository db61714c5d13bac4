"""Benchmark passages in documents: item-sized windows, SimHash search, exact verification.

Words are runs of letters and digits (A-Z folded); a shingle is five of them, its weight the
number of its bytes times its occurrences. The similarity of a window and an item is the sum of
the smaller weights of all shingles over the sum of the larger ones.

1. A window has as many words as the item (or is the whole text, if that is shorter). A window can
   reach the threshold only if shingles of items of its size make up that share of its weight and of
   the lightest such item. Two bitmaps of fixed size say which shingles may occur in items; they
   have false hits, which cost time, and no false misses.
2. Every remaining window gets a 64-bit SimHash. Fingerprints are cut into ``radius + 1`` blocks;
   two within the radius agree on a block, so a join on (size, block, bits) finds all of them.
3. A similar pair may lie beyond the radius. It shares more weight than all shingles of the item but the
   rarest that weigh more than ``1 - threshold`` of it, so it shares one of these: a join on them finds the rest.
4. Found pairs are verified exactly, so all windows of step 1 that reach the threshold are reported.

Texts and items without words match nothing. An item with fewer than five words is one shingle
and matches only a text of exactly these words, since such phrases occur in clean documents too.
Rows without a key are not searched. Rows with one key count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark.llm.text_arrays import PLAIN, SHINGLE_WORDS, constants, mix, pieces, shingle_hashes, word_bounds, word_hashes
from pacemark.session import written

#: Largest Hamming distance of fingerprints that is searched; one block more than this cuts 64 bits. It decides no result.
RADIUS = 15
#: Bits of either bitmap: 1 MB, whatever the number of items.
FILTER_BITS = 23


def _shingled(column: pa.Array) -> Iterator[tuple]:
    """First row, shingles, their byte weights, first shingle of each row, words of each row."""
    for lo, _hi, data, offsets in pieces(column):
        starts, ends, first = word_bounds(data, offsets, PLAIN)
        shingles, at = shingle_hashes(word_hashes(data, starts, ends), first)
        run = np.concatenate(([0], np.cumsum(ends - starts)))
        words = np.diff(first)
        rows = np.repeat(np.arange(len(words)), np.diff(at))
        begin = first[rows] + np.arange(len(shingles)) - at[rows]
        weights = run[np.minimum(begin + SHINGLE_WORDS, first[rows + 1])] - run[begin]
        yield lo, shingles, weights, at, words


def _fingerprints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """SimHash of the windows of ``k`` shingles that begin at ``starts``."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingles) + 1, 64), dtype=np.int64)
    np.cumsum((bits.astype(np.int64) * 2 - 1) * weights[:, None], axis=0, out=sums[1:])
    signs = (sums[starts + k] - sums[starts]) > 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _with_length(shingles: np.ndarray, length: int) -> np.ndarray:
    return mix(shingles ^ constants(1, 1000 + length))


def item_table(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """``item_id``, ``length`` in words, ``weight``, ``fingerprint``, ``shingles``, ``weights`` of items with words."""
    plain = items.select(F.col(item_key).alias("item_id"), F.col(text).cast("string").alias("text"))
    out = (f"item_id {dict(plain.dtypes)['item_id']}, length int, weight long, fingerprint long, "
           "shingles array<long>, weights array<long>")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, shingles, weights, at, words in _shingled(batch.column(1)):
                made = []
                for i in np.flatnonzero(words):
                    s, w = shingles[at[i]:at[i + 1]], weights[at[i]:at[i + 1]]
                    print_ = _fingerprints(s, w, np.zeros(1, dtype=int), len(s)).view(np.int64)[0]
                    made.append((batch.column(0)[lo + int(i)].as_py(), int(words[i]), int(w.sum()), int(print_),
                                 s.view(np.int64).tolist(), w.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(
                    zip(*made) if made else [[]] * 6, _arrow(batch.schema.field(0).type))],
                    names=["item_id", "length", "weight", "fingerprint", "shingles", "weights"])

    return plain.mapInArrow(rows, out)


def _arrow(key: pa.DataType) -> list[pa.Field]:
    longs = pa.list_(pa.int64())
    return [pa.field("", t) for t in (key, pa.int32(), pa.int64(), pa.int64(), longs, longs)]


def _bitmaps(items: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles occur in items at all, and in items of which length: two arrays of ``2 ** bits`` bits.

    The bits are gathered by Spark; the driver gets one small row per byte that is set.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.array(shingles, dtype=np.int64).view(np.uint64)
                for which, h in enumerate((s, _with_length(s, length))):
                    at = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), which, dtype=np.int32)), pa.array((at >> 3).astype(np.int32)),
                         pa.array((1 << (at & 7)).astype(np.int32))], names=["which", "byte", "bits"])

    set_bytes = (items.select("length", "shingles").mapInArrow(rows, "which int, byte int, bits int")
                 .groupBy("which", "byte").agg(F.bit_or("bits").alias("bits")))
    maps = np.zeros((2, 1 << (bits - 3)), dtype=np.uint8)
    got = set_bytes.toPandas()
    maps[got["which"].to_numpy(), got["byte"].to_numpy()] = got["bits"].to_numpy()
    return maps[0], maps[1]


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = h >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def windows(docs: DataFrame, items: DataFrame, key: str, text: str, threshold: float, bits: int) -> DataFrame:
    """``row_key``, ``start`` (word), ``length``, ``fingerprint``, ``shingles``, ``weights`` of windows that may match."""
    anywhere, by_length = _bitmaps(items, bits)
    lightest = {r["length"]: r["w"] for r in items.groupBy("length").agg(F.min("weight").alias("w")).collect()}
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((anywhere, by_length, sorted(lightest.items())))
    plain = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    out = (f"row_key {dict(plain.dtypes)['row_key']}, start long, length int, fingerprint long, "
           "shingles array<long>, weights array<long>")

    def of_document(s: np.ndarray, w: np.ndarray, hit: np.ndarray, n_words: int) -> Iterator[tuple]:
        _, by_length, lightest = given.value
        run, at = np.concatenate(([0], np.cumsum(w))), np.flatnonzero(hit)
        for length, least in lightest:
            k = min(max(length - SHINGLE_WORDS + 1, 1), len(s))
            mine = at[_in_bitmap(by_length, _with_length(s[at], length), bits)]
            if w[mine].sum() < threshold * least:
                continue
            held = np.zeros(len(s), dtype=np.int64)
            held[mine] = w[mine]
            held = np.concatenate(([0], np.cumsum(held)))
            inside = held[k:] - held[:-k]
            begin = np.flatnonzero((inside >= threshold * (run[k:] - run[:-k])) & (inside >= threshold * least))
            if len(begin):
                a, b = begin[0], begin[-1] + k
                for x, f in zip(begin, _fingerprints(s[a:b], w[a:b], begin - a, k)):
                    yield int(x), length, int(f.view(np.int64)), s[x:x + k].view(np.int64), w[x:x + k]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anywhere, _, lightest = given.value
        least = min((w for _, w in lightest), default=None)
        for batch in batches:
            if least is None:
                return
            for lo, s, w, at, words in _shingled(batch.column(1)):
                hit = _in_bitmap(anywhere, s, bits)
                run = np.concatenate(([0], np.cumsum(np.where(hit, w, 0))))
                made = []
                for i in np.flatnonzero((run[at[1:]] - run[at[:-1]] >= threshold * least) & (words > 0)):
                    a, b = at[i], at[i + 1]
                    row_key = batch.column(0)[lo + int(i)].as_py()
                    made += [(row_key, *x) for x in of_document(s[a:b], w[a:b], hit[a:b], int(words[i]))]
                if made:
                    kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                             pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t) for c, t in zip(zip(*made), kinds)],
                        names=["row_key", "start", "length", "fingerprint", "shingles", "weights"])

    return plain.mapInArrow(rows, out)


def _block(column: str, i: int, radius: int) -> Column:
    """Block ``i`` of ``radius + 1`` blocks of a fingerprint."""
    a, b = 64 * i // (radius + 1), 64 * (i + 1) // (radius + 1)
    return F.shiftrightunsigned(F.col(column), a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))


def within_radius(found: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of a window and an item of its size whose fingerprints differ in at most ``radius`` bits, each once."""
    blocks = lambda c: F.array(*[F.struct(F.lit(i).alias("i"), _block(c, i, radius).alias("v"))
                                 for i in range(radius + 1)])
    left = (found.select("row_key", "start", "length", "fingerprint")
            .withColumn("b", F.explode(blocks("fingerprint"))).withColumns({"i": F.col("b.i"), "v": F.col("b.v")}).drop("b"))
    right = (items.select("item_id", "length", F.col("fingerprint").alias("item_print"))
             .withColumn("b", F.explode(blocks("item_print"))).withColumns({"i": F.col("b.i"), "v": F.col("b.v")}).drop("b"))
    pairs = left.join(right, ["length", "i", "v"])
    pairs = pairs.withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))))
    # a pair that agrees on several blocks counts at the first of them
    earlier = F.lit(False)
    for i in range(radius):
        earlier = earlier | ((F.col("i") > i) & (_block("fingerprint", i, radius) == _block("item_print", i, radius)))
    return pairs.where((F.col("distance") <= radius) & ~earlier).select("row_key", "start", "length", "item_id", "distance")


def rarest_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """``item_id``, ``length``, ``item_print``, ``shingle``: of each item, its rarest shingles that weigh more than
    ``1 - threshold`` of it. What shares none of them has a similarity below the threshold."""
    each = (items.withColumn("item_row", F.monotonically_increasing_id())
            .select("item_row", "item_id", "length", "weight", F.col("fingerprint").alias("item_print"),
                    F.explode(F.arrays_zip("shingles", "weights")).alias("x"))
            .groupBy("item_row", "item_id", "length", "weight", "item_print", F.col("x.shingles").alias("shingle"))
            .agg(F.sum("x.weights").alias("w")))
    each = written(each, "item-shingles")
    counted = each.groupBy("length", "shingle").agg(F.count("*").alias("n"))
    rarest_first = Window.partitionBy("item_row").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(rarest_first), F.lit(0))
    # a hair more than the share, for rounding
    return (each.join(counted, ["length", "shingle"]).withColumn("before", before)
            .where(F.col("before") <= (1 - threshold + 1e-6) * F.col("weight"))
            .select("item_id", "length", "item_print", "shingle"))


def sharing_rare(found: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a window and an item of its size that share one of the item's rarest shingles, once per shingle."""
    left = found.select("row_key", "start", "length", "fingerprint", F.explode(F.array_distinct("shingles")).alias("shingle"))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    return (left.join(rarest_shingles(items, threshold), ["length", "shingle"])
            .select("row_key", "start", "length", "item_id", distance.alias("distance")))


def _weighted_similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = []
        for a, wa, b, wb in zip(*(batch.column(i).to_pylist() for i in range(5, 9))):
            names, at = np.unique(np.array(a + b, dtype=np.int64), return_inverse=True)
            x = np.bincount(at[:len(a)], weights=wa, minlength=len(names))
            y = np.bincount(at[len(a):], weights=wb, minlength=len(names))
            values.append(float(np.minimum(x, y).sum() / np.maximum(x, y).sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(values, type=pa.float64())],
                                         names=[*batch.schema.names[:5], "similarity"])


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text",
            item_text: str = "text", threshold: float = 0.8, radius: int = RADIUS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per document and item: number of matching windows, and word, size, distance and similarity of the best one.

    The best window is the most similar, then the earliest one.
    """
    prepared = written(item_table(items.where(F.col(item_key).isNotNull()), item_key, item_text), "items")
    found = written(windows(docs, prepared, key, text, threshold, filter_bits), "windows")
    near, rare = within_radius(found, prepared, radius), sharing_rare(found, prepared, threshold)
    pairs = written(near.unionByName(rare).distinct(), "window-pairs")
    joined = (pairs.join(found.select("row_key", "start", "length", "shingles", "weights"), ["row_key", "start", "length"])
              .join(prepared.select("item_id", F.col("shingles").alias("s"), F.col("weights").alias("w")), "item_id")
              .select("row_key", "item_id", "start", "length", "distance", "shingles", "weights", "s", "w"))
    kinds = dict(joined.dtypes)
    scored = joined.mapInArrow(_weighted_similarity, f"row_key {kinds['row_key']}, item_id {kinds['item_id']}, start long, "
                                                     "length int, distance int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "length", (-F.col("distance")).alias("d")))
    return (scored.where(F.col("similarity") >= threshold).groupBy("row_key", "item_id")
            .agg(F.countDistinct("start").alias("n_windows"), best.alias("b"))
            .select(F.col("row_key").alias(key), F.col("item_id").alias(item_key), "n_windows",
                    (-F.col("b.s")).alias("start_word"), F.col("b.length").cast("long").alias("n_words"),
                    (-F.col("b.d")).cast("long").alias("distance"), F.round("b.similarity", 6).alias("similarity")))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id",
                      text: str = "text", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """All columns, whatever their names, of the documents that hold no passage of an item; rows without a key stay."""
    hit = matches(docs, items, key, item_key, text, item_text, threshold).select(key).distinct()
    return docs.join(written(hit, "contaminated"), key, "left_anti")
