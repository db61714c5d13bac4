"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Training uses a bounded sample of labelled rows: up to ``toxic_rows`` and ``clean_rows`` rows with
texts of at most ``SAMPLE_CHARS`` characters, chosen by a hash of the key. One half of them gives the lexicon: words and word beginnings
that occur in more different contexts of toxic than of clean documents; counting contexts rather
than occurrences makes copies count once. The other half gives labelled tokens (lexicon hits of
strong evidence in toxic documents are toxic, all other tokens are not), on windows of which the
field is trained, and the calibration of document scores.

Scoring takes whole texts. Forward-backward runs over the tokens that carry or touch evidence;
the neutral runs between them enter as powers of one matrix, so marginals are exact for the whole
chain. A document's probability is that of at least one toxic token, calibrated with the expected
number of toxic tokens. Texts without tokens get the calibrated score of a document without
evidence. Without any labelled rows of both kinds every score is the share of toxic labels (0.0
without labels). Only the text enters a score.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.llm.text_arrays import PLAIN, _BYTE, _power_tables, constants, mix, pieces, word_bounds

#: Bounds of the labelled sample.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 2000, 4000, 20_000
#: Byte lengths of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
#: Different contexts a feature needs in toxic documents, and features kept at most.
LEAST_CONTEXTS, LEXICON = 6, 4096
#: Levels of evidence; level k means a log ratio of k / 2 + 1 to k / 2 + 1.5, level 0 none.
LEVELS = 10
STRONG = 5
WINDOW = 8
TRAINING_WINDOWS = 4000

_KIND = constants(8, 31)


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power_tables(len(data) + 1)[0][:-1], out=sums[1:])
    return sums


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For whole words and each length of beginnings: tokens that have the feature, and its hash."""
    sums, down = _sums(data), _power_tables(len(data) + 1)[1]
    out = [(np.arange(len(starts)), mix(((sums[ends] - sums[starts]) * down[starts]) ^ _KIND[0]))]
    for k, length in enumerate(BEGINNINGS):
        own = np.flatnonzero(ends - starts > length)
        s = starts[own]
        out.append((own, mix(((sums[s + length] - sums[s]) * down[s]) ^ _KIND[k + 1])))
    return out


class Model:
    """Lexicon, field weights and calibration; ``dump`` and ``load`` carry them as bytes."""

    def __init__(self, lexicon, levels, current, before, after, bias, moves, calibration):
        self.lexicon, self.levels = lexicon, levels
        self.current, self.before, self.after, self.bias, self.moves = current, before, after, float(bias), moves
        self.calibration = calibration
        step = np.exp(moves) * np.exp([0.0, self.bias])[None, :]
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-values.real)
        self._ratio = float(values.real[order][1] / values.real[order][0])
        self._in, self._out = vectors.real[:, order], np.linalg.inv(vectors.real[:, order])
        self._moves = np.exp(moves)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, lexicon=self.lexicon, levels=self.levels, current=self.current, before=self.before,
                 after=self.after, bias=self.bias, moves=self.moves, calibration=self.calibration)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        got = np.load(io.BytesIO(data))
        return Model(*(got[n] for n in ("lexicon", "levels", "current", "before", "after", "bias", "moves", "calibration")))

    def run(self, length: int) -> np.ndarray:
        """The matrix of ``length`` neutral tokens, up to a factor."""
        return (self._in * np.array([1.0, self._ratio ** length])[None, :]) @ self._out

    def marginals(self, places: np.ndarray, scores: np.ndarray, length: int) -> np.ndarray:
        """P(toxic) at ``places`` (increasing) with emission ``scores``; all other tokens are neutral."""
        n = len(places)
        gaps = np.diff(np.concatenate(([-1], places, [length]))) - 1
        mats = {g: self.run(g) for g in np.unique(gaps).tolist()}
        emit = np.exp(np.clip(scores, -30, 30))
        ahead = np.empty((n, 2))
        state = np.array([1.0, 0.0])
        for i in range(n):
            state = state @ mats[gaps[i]] @ self._moves
            state = np.array([state[0], state[1] * emit[i]])
            state = np.abs(state) / np.abs(state).sum()
            ahead[i] = state
        back = np.empty((n, 2))
        state = mats[gaps[n]].sum(axis=1)
        for i in range(n - 1, -1, -1):
            back[i] = np.abs(state) / np.abs(state).sum()
            state = mats[gaps[i]] @ (self._moves @ (np.array([1.0, emit[i]]) * back[i]))
        both = ahead * back
        return both[:, 1] / both.sum(axis=1)

    def levels_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _levels(self.lexicon, self.levels, data, starts, ends)

    def document(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that carry or touch evidence, and their marginals."""
        hit = np.flatnonzero(levels)
        if not len(hit):
            return hit, np.zeros(0)
        near = np.unique(np.concatenate((hit - 1, hit, hit + 1)))
        near = near[(near >= 0) & (near < len(levels))]
        padded = np.concatenate(([0], levels, [0]))
        scores = self.bias + self.current[padded[near + 1]] + self.before[padded[near]] + self.after[padded[near + 2]]
        return near, self.marginals(near, scores, len(levels))

    def score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-float(self.calibration @ _summary(marginals)))))


def _levels(lexicon: np.ndarray, levels: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.int64)
    if len(lexicon) == 0 or len(starts) == 0:
        return out
    for own, h in _features(data, starts, ends):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        out[own] = np.maximum(out[own], np.where(lexicon[at] == h, levels[at], 0))
    return out


def _summary(marginals: np.ndarray) -> np.ndarray:
    """What calibration sees: a constant, log odds of any toxic token, log of the expected number."""
    none = float(np.log1p(-np.minimum(marginals, 1 - 1e-6)).sum())
    some = -math.expm1(none)
    some = min(max(some, 1e-4), 1 - 1e-4)
    return np.array([1.0, math.log(some / (1 - some)), math.log1p(float(marginals.sum()))])


def _lexicon(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], toxic: np.ndarray):
    """Features with their evidence level from pieces of (bytes, word starts, word ends, row of each word)."""
    tokens = np.zeros(2)
    pairs: list[list] = [[], []]
    for data, starts, ends, row in rows:
        label = toxic[row].astype(int)
        tokens += np.bincount(label, minlength=2)
        feats = _features(data, starts, ends)
        whole = feats[0][1]
        context = np.concatenate((whole[1:], whole[:1])) if len(whole) else whole
        for own, h in feats:
            for y in (0, 1):
                mine = label[own] == y
                pairs[y].append((h[mine], mix(h[mine] ^ (context[own][mine] << np.uint64(1)))))
    joined = [tuple(np.concatenate([p[k] for p in side]) if side else np.zeros(0, np.uint64) for k in (0, 1)) for side in pairs]
    _, first = np.unique(joined[1][1], return_index=True)
    names, seen = np.unique(joined[1][0][first], return_counts=True)
    names, seen = names[seen >= LEAST_CONTEXTS], seen[seen >= LEAST_CONTEXTS]
    if not len(names):
        return names, np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(names, joined[0][0]), len(names) - 1)
    own = names[at] == joined[0][0]
    _, first = np.unique(joined[0][1][own], return_index=True)
    clean = np.bincount(at[own][first], minlength=len(names))
    ratio = np.log((seen + 0.5) / (tokens[1] + 1)) - np.log((clean + 0.5) / (tokens[0] + 1)) - 1 / np.sqrt(seen)
    level = np.clip(np.floor((ratio - 1) * 2), 0, LEVELS - 1).astype(np.int64)
    keep = np.flatnonzero(level > 0)
    keep = keep[np.argsort(-(ratio[keep] * np.log1p(seen[keep])), kind="stable")[:LEXICON]]
    order = keep[np.argsort(names[keep])]
    return names[order], level[order]


def _field(windows: np.ndarray, truth: np.ndarray, inside: np.ndarray, rounds: int = 80):
    """Weights of the field by gradient ascent on the likelihood of labelled windows.

    ``windows``: evidence levels, one row per window with a neighbour on either side;
    ``truth`` and ``inside`` (token exists) are two columns narrower.
    """
    current, before, after = np.zeros(LEVELS), np.zeros(LEVELS), np.zeros(LEVELS)
    bias, moves = -2.0, np.zeros((2, 2))
    square = {n: 0.0 for n in ("current", "before", "after", "bias", "moves")}
    n, width = truth.shape
    middle, left, right = windows[:, 1:-1], windows[:, :-2], windows[:, 2:]
    follows = inside[:, 1:] & inside[:, :-1]
    seen = np.bincount((truth[:, :-1] * 2 + truth[:, 1:])[follows].astype(int), minlength=4).reshape(2, 2)
    for _ in range(rounds):
        score = bias + current[middle] + before[left] + after[right]
        emit = np.exp(np.clip(score, -30, 30))
        step = np.exp(moves)
        ahead, back = np.empty((n, width, 2)), np.ones((n, width, 2))
        state = np.tile([1.0, 0.0], (n, 1))
        for t in range(width):
            new = state @ step
            new[:, 1] *= emit[:, t]
            new /= new.sum(axis=1, keepdims=True)
            state = np.where(inside[:, t:t + 1], new, state)
            ahead[:, t] = state
        for t in range(width - 2, -1, -1):
            new = back[:, t + 1].copy()
            new[:, 1] *= emit[:, t + 1]
            new = new @ step.T
            new /= new.sum(axis=1, keepdims=True)
            back[:, t] = np.where(inside[:, t + 1:t + 2], new, back[:, t + 1])
        both = ahead * back
        p = both[..., 1] / both.sum(axis=2)
        error = np.where(inside, truth - p, 0.0)
        gain = {k: np.bincount(lv.ravel(), weights=error.ravel(), minlength=LEVELS)
                for k, lv in (("current", middle), ("before", left), ("after", right))}
        gain["bias"] = error.sum()
        pair = seen.astype(float)
        for t in range(1, width):
            use = follows[:, t - 1]
            joint = ahead[:, t - 1, :, None] * step[None] * (back[:, t] * np.stack((np.ones(n), emit[:, t]), 1))[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pair -= joint[use].sum(axis=0)
        gain["moves"] = pair
        for k in gain:
            value = {"current": current, "before": before, "after": after, "bias": bias, "moves": moves}[k]
            grad = gain[k] / n - 1e-4 * value
            square[k] = square[k] + grad ** 2
            move = 0.5 * grad / (np.sqrt(square[k]) + 1e-8)
            if k == "bias":
                bias = float(bias + move)
            else:
                value += move
        # level 0 is the neutral token itself
        before[0] = after[0] = current[0] = 0.0
    return current, before, after, bias, moves


def _calibration(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the coefficients of evidence are not negative."""
    active = np.ones(x.shape[1], dtype=bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            v = x[:, active]
            grad = v.T @ (weight * (y - p)) - 1e-3 * w[active]
            w[active] += np.linalg.solve((v * (weight * p * (1 - p) + 1e-9)[:, None]).T @ v + 1e-3 * np.eye(v.shape[1]), grad)
        wrong = (w < 0) & (np.arange(len(w)) > 0)
        if not wrong.any():
            return w
        active &= ~wrong


def train(texts: pa.Array, toxic: np.ndarray, share: float) -> Model:
    """A model from labelled texts; ``share`` is the share of toxic rows among all labelled ones."""
    halves: list[list] = [[], []]
    parts = []
    for lo, _hi, data, offsets in pieces(texts):
        starts, ends, first = word_bounds(data, offsets, PLAIN)
        row = np.repeat(np.arange(lo, lo + len(offsets) - 1), np.diff(first))
        odd = row % 2 == 1
        halves[0].append((data, starts[~odd], ends[~odd], row[~odd]))
        parts.append((lo, data, starts, ends, first))
    lexicon, levels = _lexicon(halves[0], toxic)
    made, truth, inside = [], [], []
    rng = np.random.default_rng(0)
    levelled = []
    for lo, data, starts, ends, first in parts:
        found = _levels(lexicon, levels, data, starts, ends)
        levelled += [(found[first[i]:first[i + 1]], bool(toxic[lo + i]))
                     for i in range(len(first) - 1) if (lo + i) % 2 == 1]
    for own, y in levelled:
        hits = np.flatnonzero(own)
        centres = hits[rng.permutation(len(hits))[:6]] if len(hits) else hits
        if len(own):
            centres = np.append(centres, rng.integers(len(own)))
        padded = np.concatenate((np.zeros(WINDOW + 1, int), own, np.zeros(WINDOW + 1, int)))
        exists = np.concatenate((np.zeros(WINDOW, bool), np.ones(len(own), bool), np.zeros(WINDOW, bool)))
        for c in centres:
            seen = padded[c:c + 2 * WINDOW + 3]
            made.append(seen)
            inside.append(exists[c:c + 2 * WINDOW + 1])
            truth.append((seen[1:-1] >= STRONG) & y)
    if made and lexicon.size:
        pick = rng.permutation(len(made))[:TRAINING_WINDOWS]
        weights = _field(np.array(made)[pick], np.array(truth)[pick].astype(float), np.array(inside)[pick])
    else:
        weights = (np.zeros(LEVELS), np.zeros(LEVELS), np.zeros(LEVELS), -8.0, np.zeros((2, 2)))
    model = Model(lexicon, levels, *weights, np.zeros(3))
    y = np.array([d[1] for d in levelled], dtype=float)
    if 0 < y.sum() < len(y):
        x = np.array([_summary(model.document(own)[1]) for own, _ in levelled])
        rate = y.mean()
        model.calibration = _calibration(x, y, np.where(y == 1, share / rate, (1 - share) / (1 - rate)))
    else:
        model.calibration = np.array([math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0])
    return model


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the key as text divides by five (null: empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> bytes:
    """Train on a bounded sample of labelled rows that are not held out.

    Rows without key or label are ignored; of several labels of one key the largest counts.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("row_key")).agg((F.max(label) > 0).alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(True, 0) / total if total else 0.0
    order = F.xxhash64(F.col("row_key"), F.lit("sample"))
    chosen = (known.where("toxic").orderBy(order, "row_key").limit(toxic_rows)
              .union(known.where("NOT toxic").orderBy(order, "row_key").limit(clean_rows)))
    # at most toxic_rows + clean_rows keys
    sample = (docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
              .where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "row_key")
              .select("text", "toxic").repartition(1).sortWithinPartitions(F.xxhash64("text"), "toxic"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        texts = got["text"].combine_chunks() if got else pa.array([], pa.string())
        toxic = got["toxic"].to_numpy() if got else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array([train(texts, toxic.astype(bool), share).dump()], pa.binary())], ["model"])

    found = sample.mapInArrow(one, "model binary").collect()
    if found:
        return bytes(found[0]["model"])
    return train(pa.array([], pa.string()), np.zeros(0, bool), share).dump()


def score(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", span_level: float = 0.5) -> DataFrame:
    """Per row: its key, ``score``, ``predicted``, ``n_toxic`` and ``offending``: byte:byte of tokens, comma-joined.

    A token offends if its marginal is at least ``span_level``; offsets are bytes of the text in UTF-8.
    """
    plain = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(given.value)
        empty = model.score(np.zeros(0))
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets, PLAIN)
                levels = model.levels_of(data, starts, ends)
                hits = np.concatenate(([0], np.cumsum(levels > 0)))[first]
                scores = np.full(hi - lo, empty)
                spans = np.full(hi - lo, "", dtype=object)
                counts = np.zeros(hi - lo, dtype=np.int64)
                for i in np.flatnonzero(np.diff(hits)):
                    a, b = first[i], first[i + 1]
                    places, p = model.document(levels[a:b])
                    scores[i] = model.score(p)
                    bad = places[p >= span_level]
                    counts[i] = len(bad)
                    spans[i] = ",".join(f"{starts[a + t] - offsets[i]}:{ends[a + t] - offsets[i]}" for t in bad)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                     pa.array(counts), pa.array(spans, type=pa.string())],
                    names=["row_key", "score", "predicted", "n_toxic", "offending"])

    kind = dict(plain.dtypes)["row_key"]
    out = plain.mapInArrow(rows, f"row_key {kind}, score double, predicted int, n_toxic long, offending string")
    return out.withColumnRenamed("row_key", key)


def drop_toxic(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """All columns of the rows that are not predicted toxic; each row is judged by itself."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(given.value)
        empty = model.score(np.zeros(0)) < 0.5
        for batch in batches:
            keep = np.full(batch.num_rows, empty)
            for lo, _hi, data, offsets in pieces(batch.column(at)):
                starts, ends, first = word_bounds(data, offsets, PLAIN)
                levels = model.levels_of(data, starts, ends)
                hits = np.concatenate(([0], np.cumsum(levels > 0)))[first]
                for i in np.flatnonzero(np.diff(hits)):
                    keep[lo + i] = model.score(model.document(levels[first[i]:first[i + 1]])[1]) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)
