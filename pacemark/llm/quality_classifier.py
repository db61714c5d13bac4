"""Quality of texts: random-indexing word vectors pooled per document, and a small network.

Tokens are runs of letters, digits and characters beyond ASCII (case kept), and runs of one punctuation mark. Every
token has a random index vector: a few signs in ``DIMENSIONS`` places, one of ``INDEXES`` drawn by its hash. The context vector of a token
sums the index vectors of its neighbours over the whole corpus, so it grows by addition, in any order and on any number
of tasks. Vectors are kept in ``TABLES`` tables of ``SLOTS`` rows; a token owns one row of each, chosen by independent
hashes, and its vector is the mean of its normalised rows. So every token of the corpus counts and has a vector, however
many there are, and the model that tasks read has a fixed size (``TABLES * SLOTS * DIMENSIONS`` single floats, 3 MB).

A document is the mean and the spread of the vectors of its tokens, rarer tokens weighing more, with the mean cosine of
neighbouring tokens and the logarithm of their number. A network of two layers learns from a bounded sample of labelled rows, ``sample_rows`` at most of either label, chosen by a hash of key and text;
a fifth of them, not trained on, gives the temperature that calibrates its probabilities and ends training.

Scoring takes whole texts and nothing else. Defined results: texts without tokens, null ones included, get the share
of label 1 among the labelled rows; without labelled rows of both kinds every score is that share (0.5 without labels).
Of several labels of one key the largest counts; rows of one key are scored each by itself. Empty tables give no rows.
Only the named columns are read, so other columns may have any name. Texts of any length are taken in pieces of a few MB.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark.llm.text_arrays import PLAIN, _power_tables, constants, mix, pieces

DIMENSIONS, SIGNS, INDEXES = 48, 6, 1024
TABLES, SLOTS = 2, 8192
#: Neighbours on either side.
REACH = 2
#: Labelled rows of either label that are learned from at most.
SAMPLE_ROWS = 8000
#: Tokens whose vectors are held at once, so that they stay in a processor's cache.
CHUNK = 1 << 12
#: Cells of contexts that a task gathers before it counts them.
CELLS = 1 << 22
HIDDEN, ROUNDS, BATCH, RATE = 32, 60, 128, 2e-3
#: Rows of a table that travel together, and slots that a sum is dealt over on the way.
SLICE, WAYS = 512, 16

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_CASED = constants(256, 91)
_SALT = constants(TABLES, 92)
_INDEX = constants(1, 93)[0]


def _signs() -> np.ndarray:
    """Index vectors by the low bits of a token's hash."""
    rng = np.random.default_rng(17)
    out = np.zeros((INDEXES, DIMENSIONS))
    for row in out:
        row[rng.choice(DIMENSIONS, SIGNS, replace=False)] = rng.choice([-1, 1], SIGNS)
    return out


_SIGNS = _signs()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, case kept, and the first token of each row (one more entry than rows)."""
    if len(data) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    kind = np.where(PLAIN[data], 256, data.astype(np.int64))
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    marks = np.flatnonzero(edge)
    keep = ~_SPACE[data[marks[:-1]]]
    starts, ends = marks[:-1][keep], marks[1:][keep]
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_CASED[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def _slots(h: np.ndarray, table: int) -> np.ndarray:
    return (mix(h ^ _SALT[table]) & np.uint64(SLOTS - 1)).astype(np.int64)


def _met(h: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Per table, the cells of the tokens of a piece: one for each neighbour in its row, by index vector, and one for itself."""
    index = (mix(h ^ _INDEX) & np.uint64(INDEXES - 1)).astype(np.int64)
    near = [np.flatnonzero(row[k:] == row[:-k]) for k in range(1, REACH + 1)]
    out = []
    for t in range(TABLES):
        slot = _slots(h, t) * (INDEXES + 1)
        cells = [slot + INDEXES]
        for k, at in enumerate(near, 1):
            cells += [slot[at + k] + index[at], slot[at] + index[at + k]]
        out.append(np.concatenate(cells))
    return out


def context_tables(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sums of contexts and, in the last column, numbers of tokens: tables x slots x (dimensions + 1)."""
    wide = DIMENSIONS + 1

    def add(counts: np.ndarray, met: list[list[np.ndarray]]) -> None:
        for t in range(TABLES if met else 0):
            counts[t] += np.bincount(np.concatenate([m[t] for m in met]), minlength=counts.shape[1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # how often each slot met each index vector, and how many tokens it has
        counts = np.zeros((TABLES, SLOTS * (INDEXES + 1)), dtype=np.int64)
        met: list[list[np.ndarray]] = []
        for batch in batches:
            for _lo, _hi, data, offsets in pieces(batch.column(0)):
                h, first = tokens(data, offsets)
                met.append(_met(h, np.repeat(np.arange(len(first) - 1), np.diff(first))))
                if sum(len(m[0]) for m in met) > CELLS:
                    add(counts, met)
                    met = []
        add(counts, met)
        table = np.empty((TABLES, SLOTS, wide))
        for own, flat in zip(table, counts.reshape(TABLES, SLOTS, INDEXES + 1)):
            for lo in range(0, SLOTS, SLICE):
                own[lo:lo + SLICE, :-1] = flat[lo:lo + SLICE, :-1].astype(np.float64) @ _SIGNS
            own[:, -1] = flat[:, -1]
        yield from _parts(table.reshape(-1, SLICE, wide))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(values.as_buffer(), dtype=np.float64)
                held[part] = held[part] + got if part in held else got.copy()
        if held:
            yield from _parts(np.stack(list(held.values())), list(held))

    made = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(sums, "part int, vectors binary")
    # a task holds no more than one table, whatever the number of parts it adds up
    near = made.withColumn("way", F.pmod(F.spark_partition_id(), F.lit(WAYS))).repartition("part", "way").select("part", "vectors")
    near = near.mapInArrow(merged, "part int, vectors binary").repartition("part").mapInArrow(merged, "part int, vectors binary")
    out = np.zeros((TABLES * SLOTS // SLICE, SLICE, wide))
    for r in near.collect():
        out[r["part"]] = np.frombuffer(r["vectors"], dtype=np.float64).reshape(SLICE, wide)
    return out.reshape(TABLES, SLOTS, wide)


def _parts(parts: np.ndarray, names: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    names = list(range(len(parts))) if names is None else names
    use = [i for i in range(len(parts)) if parts[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in use], pa.int32()),
                                      pa.array([parts[i].tobytes() for i in use], pa.binary())], names=["part", "vectors"])


class Vectors:
    """Word vectors and weights from the sums of contexts."""

    def __init__(self, sums: np.ndarray):
        count = sums[..., -1]
        mean = sums[..., :-1].sum(axis=1, keepdims=True) / np.maximum(count.sum(axis=1), 1)[:, None, None]
        # what all contexts have in common says nothing about a token
        rows = sums[..., :-1] / np.maximum(count, 1)[..., None] - mean
        size = np.sqrt((rows ** 2).sum(axis=2, keepdims=True))
        self.rows = (rows / np.maximum(size, 1e-9) / TABLES).astype(np.float32)
        share = count / np.maximum(count.sum(axis=1, keepdims=True), 1)
        self.weight = (1e-3 / (1e-3 + share)).astype(np.float32)

    def pooled(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, last row, pooled vectors (mean, spread, likeness of neighbours, size) and whether a row has tokens."""
        for lo, hi, data, offsets in pieces(column):
            h, first = tokens(data, offsets)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            total, square = np.zeros((hi - lo, DIMENSIONS)), np.zeros((hi - lo, DIMENSIONS))
            weights, alike = np.zeros(hi - lo), np.zeros(hi - lo)
            for a in range(0, len(h), CHUNK):
                own, r = h[a:a + CHUNK], row[a:a + CHUNK]
                slots = [_slots(own, t) for t in range(TABLES)]
                vector = self.rows[0][slots[0]]
                weight = self.weight[0][slots[0]]
                for t in range(1, TABLES):
                    vector += self.rows[t][slots[t]]
                    # a slot counts all its tokens, so the larger weight is nearer to the token's own
                    np.maximum(weight, self.weight[t][slots[t]], out=weight)
                new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                length = np.sqrt(np.einsum("ij,ij->i", vector, vector)) + np.float32(1e-9)
                cosine = np.einsum("ij,ij->i", vector[1:], vector[:-1]) / (length[1:] * length[:-1])
                same = np.concatenate((np.where(r[1:] == r[:-1], cosine, 0), [0]))
                alike[r[new]] += np.add.reduceat(same, new)
                vector *= weight[:, None]
                total[r[new]] += np.add.reduceat(vector, new, axis=0)
                np.multiply(vector, vector, out=vector)
                square[r[new]] += np.add.reduceat(vector, new, axis=0)
                weights[r[new]] += np.add.reduceat(weight, new)
            n = np.diff(first)
            scale = np.maximum(weights, 1e-9)[:, None]
            mean = total / scale
            yield lo, hi, np.concatenate((mean, np.sqrt(np.maximum(square / scale - mean ** 2, 0)),
                                          (alike / np.maximum(n, 1))[:, None], np.log1p(n)[:, None]), axis=1), n > 0


class Network:
    """Two layers over standardised pooled vectors; probabilities at a temperature."""

    def __init__(self, centre, scale, w1, b1, w2, b2, heat, prior):
        self.centre, self.scale, self.w1, self.b1, self.w2, self.b2 = centre, scale, w1, b1, w2, b2
        self.heat, self.prior = float(heat), float(prior)

    def odds(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        if not len(self.w2):
            return np.full(len(x), self.prior)
        return np.where(some, 1 / (1 + np.exp(-np.clip(self.odds(x) / self.heat, -30, 30))), self.prior)


def _loss(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, odds) - y * odds)).sum() / weight.sum())


def temperature(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm.

    Targets are drawn in by one row of either label, so that separable rows don't ask for certainty.
    """
    y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    lo, hi, golden = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        if _loss(odds / math.exp(a), y, weight) <= _loss(odds / math.exp(b), y, weight):
            hi = b
        else:
            lo = a
    return math.exp((lo + hi) / 2)


def train(x: np.ndarray, y: np.ndarray, share: float) -> Network:
    """A network from pooled vectors and labels; ``share`` is the share of label 1 among all labelled rows."""
    none = np.zeros((0, 0))
    if not 0 < y.sum() < len(y):
        return Network(0, 1, none, none, np.zeros(0), 0, 1, share)
    rng = np.random.default_rng(23)
    rate = y.mean()
    weight = np.where(y == 1, share / rate, (1 - share) / (1 - rate))
    order = rng.permutation(len(y))
    test, own = order[:len(y) // 5], order[len(y) // 5:]
    centre, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z = (x - centre) / scale
    names = ("w1", "b1", "w2", "b2")
    net = dict(zip(names, (rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                           rng.normal(0, math.sqrt(2 / HIDDEN), HIDDEN), np.array(0.0))))
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    best, kept, step = math.inf, dict(net), 0
    for _ in range(ROUNDS):
        own = rng.permutation(own)
        for lo in range(0, len(own), BATCH):
            at = own[lo:lo + BATCH]
            hidden = np.maximum(z[at] @ net["w1"] + net["b1"], 0)
            error = weight[at] * (1 / (1 + np.exp(-np.clip(hidden @ net["w2"] + net["b2"], -30, 30))) - y[at]) / len(at)
            back = error[:, None] * net["w2"] * (hidden > 0)
            slope = {"w1": z[at].T @ back + 1e-4 * net["w1"], "b1": back.sum(axis=0),
                     "w2": hidden.T @ error + 1e-4 * net["w2"], "b2": error.sum()}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slope[k]
                second[k] = 0.999 * second[k] + 0.001 * slope[k] ** 2
                net[k] = net[k] - RATE * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        if len(test):
            odds = np.maximum(z[test] @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]
            if (now := _loss(odds, y[test], weight[test])) < best:
                best, kept = now, dict(net)
        else:
            kept = dict(net)
    out = Network(centre, scale, *(kept[k] for k in names), 1.0, share)
    if len(test):
        out.heat = temperature(out.odds(x[test]), y[test], weight[test])
    return out


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the key as text leaves 2 when divided by four (null: empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> tuple[Vectors, Network]:
    """Word vectors of all documents, and a network from at most ``sample_rows`` labelled rows of either label.

    Labels without key, null labels and held-out keys are ignored.
    """
    vectors = Vectors(context_tables(docs, text))
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("row_key")).agg((F.max(label) > 0).cast("int").alias("good")))
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    given = docs.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, some in given.value.pooled(batch.column(0)):
                out = pa.RecordBatch.from_arrays(
                    [pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary()), batch.column(1).slice(lo, hi - lo),
                     batch.column(2).slice(lo, hi - lo)], names=["vector", "good", "place"])
                yield out.filter(pa.array(some))

    # the keys with the smallest hashes of either label, then their rows: both at most 2 * sample_rows
    order = F.xxhash64(F.col("row_key"), F.lit("sample"))
    keys = [known.where(F.col("good") == good).orderBy(order, "row_key").limit(sample_rows) for good in (0, 1)]
    sample = (docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
              .join(F.broadcast(keys[0].unionByName(keys[1])), "row_key").select("text", "good", order.alias("place"))
              .mapInArrow(rows, "vector binary, good int, place long"))
    first = Window.partitionBy("good").orderBy("place", "vector")
    got = (sample.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_rows)
           .orderBy("good", "nth").collect())
    x = np.array([np.frombuffer(r["vector"], dtype=np.float32) for r in got], dtype=np.float64).reshape(len(got), 2 * DIMENSIONS + 2)
    return vectors, train(x, np.array([r["good"] for r in got], dtype=float), share)


def score(docs: DataFrame, model: tuple[Vectors, Network], key: str = "doc_id", text: str = "text", level: float = 0.7) -> DataFrame:
    """Per row: its key, ``score`` and ``predicted`` (1 where the score is at least ``level``)."""
    plain = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    # a table of fixed size and a network
    given = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = given.value
        for batch in batches:
            for lo, hi, x, some in vectors.pooled(batch.column(1)):
                p = network.probability(x, some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p),
                                                  pa.array((p >= level).astype(np.int32))], names=["row_key", "score", "predicted"])

    kind = dict(plain.dtypes)["row_key"]
    return plain.mapInArrow(rows, f"row_key {kind}, score double, predicted int").withColumnRenamed("row_key", key)
