"""Masked pseudo-likelihood of documents by a bidirectional window network trained in numpy.

Words (runs of letters and digits, A-Z folded) become classes: the most frequent words of the whole
corpus have one each, all others share a class by their length and are told apart by the ``LEVELS`` digits of a code,
which is 16 bits of their hash. The network predicts every word from the classes and codes of the ``SPAN`` words on either
side: position-wise embeddings are added, pass tanh, a softmax over all classes gives the conditional probability of the
class, and one softmax per digit that of the code. The score of a document is the sum of the logarithms of these
probabilities over all its words.

Words of a shared class are the leaves of a tree by digits. A child has the share of its words among those of the node, from
the counts of all words of the corpus, times the exponential of what the hidden values say of the digit, over the sum of
that for all children. Only words of one class and one code, of which there are 65,536 a class, share what the context says,
by their counts. A network that says nothing gives a word that occurs n times among the N of its class the share n / (N + 1);
what is left is for words that the corpus does not hold. The counts of at most ``COMMON`` words travel to the tasks,
those of all others are joined, so the vocabulary grows with the input and no word is left out.

Word and class counts cover all rows. Every task trains a copy of the network on all words of its rows,
starting from the same weights; the copies are averaged, weighted by their words, once per round.
The driver sees the classes, the counts of common words and one set of weights, all of bounded size.

Null texts and texts without words have a sum of 0 over 0 words and no mean. Rows are scored one by
one, so keys may be null or repeated. A corpus without words leaves the initial weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.llm.text_arrays import PLAIN, pieces, word_bounds, word_hashes
from pacemark.session import written

#: Classes: 0 lies beyond a text, then classes of rarer words by length, then frequent words.
CLASSES, RARE = 64, 16
HIDDEN, SPAN, BATCH = 16, 2, 2048
RATE = 0.05
#: Digits of the code of a word, and the values of a digit.
LEVELS, FAN = 4, 16
CODES = FAN ** LEVELS
#: Words whose counts are sent to every task; it decides what is joined, not what is counted.
COMMON = 1 << 17

OFFSETS = tuple(o for o in range(-SPAN, SPAN + 1) if o)


@dataclass
class Vocabulary:
    """All words of a corpus: those with a class of their own, common ones with the logarithm of their count, the table of all.

    ``shares`` holds per level the share of each digit below every node, a class and the digits before.
    """

    frequent: np.ndarray
    common: np.ndarray
    common_logs: np.ndarray
    class_logs: np.ndarray
    others: DataFrame
    shares: list[np.ndarray] = field(default_factory=list)

    def common_places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the common words, and whether it is there."""
        if not len(self.common):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return at, self.common[at] == h


def frequent_words(docs: DataFrame, text: str, n: int = CLASSES - RARE, common: int = COMMON) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, its most frequent words (ties by hash) sorted by hash, and the counts of all classes."""
    plain = docs.select(F.col(text).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _lo, _hi, data, offsets in pieces(batch.column(0)):
                starts, ends, _ = word_bounds(data, offsets, PLAIN)
                words, first, counts = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), pa.array(_length_class((ends - starts)[first]) * CODES + codes_of(words)),
                     pa.array(counts)], names=["word", "leaf", "n"])

    counted = written(plain.mapInArrow(rows, "word long, leaf int, n long").groupBy("word")
                      .agg(F.min("leaf").alias("leaf"), F.sum("n").alias("n")), "word-counts")
    top = counted.orderBy(F.desc("n"), "word").limit(n).toPandas().sort_values("word", key=lambda c: c.to_numpy().view(np.uint64))
    words = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    # no more rows than there are leaves, however many words
    leaves, held = np.zeros(RARE * CODES), counted.groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    leaves[held["leaf"].to_numpy()] = held["n"].to_numpy()
    np.subtract.at(leaves, top["leaf"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=float))
    counts = np.zeros(CLASSES)
    counts[:RARE] = leaves.reshape(RARE, -1).sum(axis=1)
    # of shared classes: what a word's count is divided by
    class_logs = np.zeros(CLASSES)
    class_logs[:RARE] = np.log(counts[:RARE] + 1)
    counts[RARE:RARE + len(top)] = top["n"].to_numpy(dtype=float)
    # words by the size of their count, the largest first, as long as they are few enough
    grade = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in sorted(counted.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):
        held += r["count"]
        if held > common:
            break
        least = r["grade"]
    near = counted.where(grade >= least if least is not None else F.lit(False)).select("word", "n").toPandas()
    hashes = near["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    # the count 1 has the logarithm 0
    others = counted.where((F.col("n") > 1) & (grade < least if least is not None else F.lit(True)))
    return Vocabulary(words, hashes[order], np.log(near["n"].to_numpy(dtype=float)[order]), class_logs,
                      others.select("word", F.log("n").alias("log_n")), shares_of(leaves)), counts


def shares_of(leaves: np.ndarray) -> list[np.ndarray]:
    """Per level the share of each digit below every node; a word that was never seen counts for a leaf's part of one word."""
    below, out = leaves + 1 / CODES, []
    for _ in range(LEVELS):
        children = below.reshape(-1, FAN)
        below = children.sum(axis=1)
        out.append((children / below[:, None]).astype(np.float32))
    return out[::-1]


def codes_of(hashes: np.ndarray) -> np.ndarray:
    """The code of a word: 16 bits that all bits of its hash decide."""
    return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int32)


def _length_class(lengths: np.ndarray) -> np.ndarray:
    return np.clip(lengths, 1, RARE - 1).astype(np.int32)


def classes(words: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and hash of every word, and the first word of each row."""
    starts, ends, first = word_bounds(data, offsets, PLAIN)
    out = _length_class(ends - starts).astype(np.int64)
    h = word_hashes(data, starts, ends)
    if len(words) and len(starts):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        out = np.where(words[at] == h, RARE + at, out)
    return out, h, first


def contexts(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes, or codes, of the neighbours of every word, one column per offset; 0 beyond the text."""
    n = len(own)
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    out = np.zeros((n, len(OFFSETS)), dtype=own.dtype)
    place = np.arange(n)
    for k, o in enumerate(OFFSETS):
        at = place + o
        fits = (at >= begin) & (at < end)
        out[fits, k] = own[at[fits]]
    return out


class Network:
    """Weights as one flat vector with named views."""

    SHAPES = {"embed": (len(OFFSETS), CLASSES, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "bias": (CLASSES,),
              "code_embed": (len(OFFSETS), 2, 256, HIDDEN), "code_out": (HIDDEN, LEVELS * FAN)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at:at + size].reshape(shape))
            at += size

    @classmethod
    def initial(cls, counts: np.ndarray) -> Network:
        """Small fixed pseudo-random weights; the bias holds the class frequencies."""
        size = sum(int(np.prod(s)) for s in cls.SHAPES.values())
        net = cls(np.random.default_rng(0).normal(0, 0.1, size).astype(np.float32))
        net.hidden_bias[:] = 0
        net.code_out[:] = 0
        net.bias[:] = np.log((counts + 1) / (counts.sum() + len(counts)))
        return net

    def hidden(self, context: np.ndarray, codes: np.ndarray | None) -> np.ndarray:
        h = self.embed[0].take(context[:, 0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += self.embed[k].take(context[:, k], axis=0)
        for k in range(len(OFFSETS) if codes is not None else 0):
            own = codes[:, k]
            h += self.code_embed[k, 0].take(own >> 8, axis=0)
            h += self.code_embed[k, 1].take(own & 255, axis=0)
        h += self.hidden_bias
        return np.tanh(h, out=h)

    def forward(self, context: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log probabilities of all classes; ``codes`` are those of the neighbours, if they are known."""
        h = self.hidden(context, codes)
        z = h @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return h, z

    def _children(self, h: np.ndarray, own: np.ndarray, code: np.ndarray, shares: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What the hidden values say of every digit, and with the shares of the nodes on the way of each word what it weighs."""
        said = h @ self.code_out
        # no digit is favoured by more than e^20, so that nothing overflows
        np.minimum(said, 20, out=said)
        np.maximum(said, -20, out=said)
        weight = np.exp(said).reshape(len(h), LEVELS, FAN)
        for j in range(LEVELS):
            weight[:, j] *= shares[j].take(own * FAN ** j + (code >> 4 * (LEVELS - j)), axis=0)
        return said, weight

    def digits(self, h: np.ndarray, own: np.ndarray, code: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
        """What the context adds to the log probability that the shares give words in shared classes."""
        said, weight = self._children(h, own, code, shares)
        gained = -np.log(weight.sum(axis=2)).sum(axis=1)
        for at in _own_digits(code):
            gained += said.ravel().take(at)
        return gained

    def learn(self, context: np.ndarray, own: np.ndarray, squares: np.ndarray, codes: np.ndarray | None = None,
              code: np.ndarray | None = None, shares: list[np.ndarray] | None = None) -> None:
        """One step of Adagrad on the mean log probability of a batch, of classes alone if no ``codes`` are given."""
        n, h = len(own), self.hidden(context, codes)
        z = h @ self.out
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True) * n
        z[np.arange(n), own] -= 1 / n
        grad = Network(np.zeros_like(self.flat))
        grad.bias[:] = z.sum(axis=0)
        grad.out[:] = h.T @ z
        d = z @ self.out.T
        if codes is not None:
            rare = np.flatnonzero(own < RARE)
            some, held = code.take(rare), h.take(rare, axis=0)
            _, p = self._children(held, own.take(rare), some, shares)
            p /= p.sum(axis=2, keepdims=True) * n
            p = p.reshape(len(rare), LEVELS * FAN)
            for at in _own_digits(some):
                p.ravel()[at] -= 1 / n
            grad.code_out[:] = held.T @ p
            d[rare] += p @ self.code_out.T
        h *= h
        d *= 1 - h
        grad.hidden_bias[:] = d.sum(axis=0)
        d = d.ravel().astype(np.float64)
        for k in range(len(OFFSETS)):
            _added(grad.embed[k], context[:, k], d)
            if codes is not None:
                _added(grad.code_embed[k, 0], codes[:, k] >> 8, d)
                _added(grad.code_embed[k, 1], codes[:, k] & 255, d)
        step = grad.flat * grad.flat
        squares += step
        np.sqrt(squares, out=step)
        step += 1e-6
        np.divide(grad.flat, step, out=step)
        step *= RATE
        self.flat -= step


def _own_digits(code: np.ndarray) -> Iterator[np.ndarray]:
    """Per level the place of the word's digit among all digits of all words."""
    row = np.arange(len(code)) * (LEVELS * FAN)
    for j in range(LEVELS):
        yield row + (j * FAN + (code >> 4 * (LEVELS - 1 - j) & FAN - 1))


def _added(out: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
    """Rows of ``d`` (flat, doubles) added up by their id: one count over all cells."""
    cells = (ids.astype(np.int64) * HIDDEN)[:, None] + np.arange(HIDDEN)
    out[:] = np.bincount(cells.ravel(), d, out.size).reshape(out.shape)


def train(docs: DataFrame, text: str, words: Vocabulary, counts: np.ndarray, rounds: int = 1) -> Network:
    """Average of the copies that the tasks train on all their words, ``rounds`` times."""
    plain = docs.select(F.col(text).cast("string").alias("text"))
    net = Network.initial(counts)
    for _ in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast((words.frequent, words.shares, net.flat))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, shares, flat = given.value
            own_net, squares, seen = Network(flat.copy()), np.full(len(flat), 1e-6, dtype=np.float32), 0

            def learn(own: np.ndarray, around: np.ndarray, code: np.ndarray, codes: np.ndarray) -> None:
                own_net.learn(around, own, squares, codes, code, shares)

            held = None
            for batch in batches:
                for _lo, _hi, data, offsets in pieces(batch.column(0)):
                    own, h, first = classes(words, data, offsets)
                    code = codes_of(h)
                    order = np.random.default_rng(seen).permutation(len(own))
                    now = [v[order] for v in (own, contexts(own, first), code, contexts(code, first))]
                    if held is not None:
                        now = [np.concatenate(v) for v in zip(held, now)]
                    whole = len(now[0]) // BATCH * BATCH
                    for i in range(0, whole, BATCH):
                        learn(*(v[i:i + BATCH] for v in now))
                    held = [v[whole:] for v in now]
                    seen += whole
            if held is not None and len(held[0]):
                learn(*held)
                seen += len(held[0])
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat))), pa.array(own_net.flat.astype(np.float64) * seen),
                     pa.array(np.full(len(flat), seen))], names=["i", "weighted", "words"])

        averaged = (plain.mapInArrow(rows, "i long, weighted double, words long").groupBy("i")
                    .agg((F.sum("weighted") / F.sum("words")).alias("value")).toPandas())
        if len(averaged):
            flat = np.zeros_like(net.flat)
            flat[averaged["i"].to_numpy()] = averaged["value"].to_numpy()
            net = Network(flat)
    return net


def score(docs: DataFrame, net: Network, words: Vocabulary, key: str, text: str) -> DataFrame:
    """Per row: its key, ``n_words``, ``log_likelihood`` (sum) and ``mean_log_likelihood``."""
    plain = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    sent = Vocabulary(words.frequent, words.common, words.common_logs, words.class_logs, None, words.shares)
    given = docs.sparkSession.sparkContext.broadcast((sent, net.flat))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = given.value
        net = Network(flat)
        row = TaskContext.get().partitionId() << 38
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                own, h, first = classes(vocabulary.frequent, data, offsets)
                code = codes_of(h)
                around, codes = contexts(own, first), contexts(code, first)
                logs = np.zeros(len(own) + 1)
                shared = own < RARE
                for i in range(0, len(own), BATCH):
                    hidden, z = net.forward(around[i:i + BATCH], codes[i:i + BATCH])
                    logs[i + 1:i + 1 + len(z)] = z[np.arange(len(z)), own[i:i + BATCH]]
                    rare = np.flatnonzero(shared[i:i + BATCH])
                    logs[i + 1 + rare] += net.digits(hidden[rare], own[i + rare], code[i + rare], vocabulary.shares)
                at, near = vocabulary.common_places(h)
                logs[1:] -= vocabulary.class_logs[own]
                logs[1:][shared & near] += vocabulary.common_logs[at[shared & near]]
                n = np.diff(first)
                # differences of one running sum over a few MB of text
                run = np.cumsum(logs)
                total = run[first[1:]] - run[first[:-1]]
                far = np.flatnonzero(shared & ~near)
                begin = np.searchsorted(far, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(n))), batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(total),
                     pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(h[far].view(np.int64)))],
                    names=["row", "row_key", "n_words", "in_task", "far"])
                row += len(n)

    kind = dict(plain.dtypes)["row_key"]
    made = written(plain.mapInArrow(rows, f"row long, row_key {kind}, n_words long, in_task double, far array<long>"), "scores")
    joined = (made.select("row", F.explode("far").alias("word")).join(words.others, "word")
              .groupBy("row").agg(F.sum("log_n").alias("joined")))
    total = F.col("in_task") + F.coalesce("joined", F.lit(0.0))
    return (made.drop("far").join(joined, "row", "left")
            .select(F.col("row_key").alias(key), "n_words", total.alias("log_likelihood"),
                    F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood")))


def likelihoods(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 1) -> DataFrame:
    """Learn vocabulary and network from all rows, then score all rows."""
    words, counts = frequent_words(docs, text)
    return score(docs, train(docs, text, words, counts, rounds), words, key, text)
