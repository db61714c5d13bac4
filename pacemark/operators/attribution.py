"""Attribution of a forest's predictions to features, along the paths of its trees.

A row's attribution is the Shapley value of the game in which an unknown feature lets a row go down both sides of a
split, in the shares of the training rows. A leaf matters through the features on its path only: feature i lets the
row pass (``one`` is 1 or 0) when it is known, and passes a share ``zero`` of the rows when it is not. The Shapley weights
over all subsets are the integral over t in [0, 1] of the product of ``one * t + zero * (1 - t)`` over the other features,
a polynomial, so a few Gauss-Legendre points give it exactly. Batches of rows go down all leaves of a tree at once.

Attributions of a row sum to its prediction less the mean prediction over the training rows (``expected``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.operators.boosting import Forest, Tree
from pacemark.sources.schemas import KEY

#: Rows whose leaves are held at once.
CHUNK = 2048


def _paths(tree: Tree) -> Iterator[tuple[float, list[tuple[int, list[tuple[float, bool]], float]]]]:
    """Leaf value and, for each feature on the path, its conditions (threshold, goes right) and share of rows that pass."""
    def walk(node: int, path: list[tuple[int, float, bool, float]]):
        if tree.feature[node] < 0:
            if tree.cover[node] > 0 and path:
                merged: dict[int, tuple[list, float]] = {}
                for f, threshold, right, share in path:
                    conditions, zero = merged.get(f, ([], 1.0))
                    merged[f] = ([*conditions, (threshold, right)], zero * share)
                yield float(tree.value[node]), [(f, c, z) for f, (c, z) in merged.items()]
            return
        for right in (False, True):
            child = 2 * node + 1 + right
            step = (int(tree.feature[node]), float(tree.threshold[node]), right, float(tree.cover[child] / tree.cover[node]))
            yield from walk(child, [*path, step])

    yield from walk(0, [])


def expected(forest: Forest) -> float:
    """The mean prediction over the rows the trees were grown on."""
    out = forest.base
    for t in forest.trees:
        leaf = t.feature < 0
        if t.cover[0] > 0:
            out += float((t.value[leaf] * t.cover[leaf]).sum() / t.cover[0])
        else:
            out += float(t.value[0])
    return out


class _Plan:
    """The leaves of a forest, grouped by the number of features on their paths, as arrays.

    Per group: values (leaves), features, shares and bounds (leaves x features): a row passes feature j of a leaf if its
    value is above ``low`` and not above ``high``.
    """

    def __init__(self, forest: Forest):
        groups: dict[int, list] = {}
        for tree in forest.trees:
            for value, path in _paths(tree):
                rows = []
                for f, conditions, zero in path:
                    low = max([t for t, right in conditions if right], default=-np.inf)
                    high = min([t for t, right in conditions if not right], default=np.inf)
                    rows.append((f, zero, low, high))
                groups.setdefault(len(path), []).append((value, rows))
        self.groups = []
        for m, leaves in sorted(groups.items()):
            table = np.array([rows for _, rows in leaves], dtype=np.float64)
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            self.groups.append((np.array([v for v, _ in leaves]), table[:, :, 0].astype(np.int64), table[:, :, 1],
                                table[:, :, 2], table[:, :, 3], (points + 1) / 2, weights / 2))
        self.width = forest.width

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        for lo in range(0, len(x), CHUNK):
            part = x[lo:lo + CHUNK]
            for value, feature, zero, low, high, points, weights in self.groups:
                # as many leaves at once as keep the arrays at a few million cells
                step = max(1, (1 << 21) // max(1, len(part) * feature.shape[1]))
                for a in range(0, len(value), step):
                    f, z = feature[a:a + step], zero[a:a + step]
                    own = part[:, f]
                    one = (own > low[a:a + step]) & (own <= high[a:a + step])
                    share = np.zeros(one.shape)
                    for t, w in zip(points, weights):
                        factor = one * t + z * (1 - t)
                        share += w * factor.prod(axis=2, keepdims=True) / factor
                    share *= (one - z) * value[a:a + step, None]
                    for j in range(f.shape[1]):
                        order = np.argsort(f[:, j], kind="stable")
                        names, first = np.unique(f[order, j], return_index=True)
                        out[lo:lo + CHUNK, names] += np.add.reduceat(share[:, order, j], first, axis=1)
        return out


def attributions(rows: DataFrame, forest: Forest, vector: str = "features") -> DataFrame:
    """Per row: key, ``prediction``, ``expected`` and ``attribution``, an array with one value per feature."""
    mean = expected(forest)
    given = rows.sparkSession.sparkContext.broadcast(forest.dump())
    kinds = dict(rows.dtypes)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Forest.load(given.value)
        plan = _Plan(model)
        for batch in batches:
            n = batch.num_rows
            x = batch.column(len(KEY)).flatten().to_numpy(zero_copy_only=False).reshape(n, model.width)
            at = pa.array(np.arange(n + 1, dtype=np.int32) * model.width)
            values = pa.ListArray.from_arrays(at, pa.array(plan.values(x).ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(KEY))), pa.array(model.predict(x)), pa.array(np.full(n, mean)), values],
                names=[*KEY, "prediction", "expected", "attribution"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", prediction double, expected double, attribution array<double>"
    return rows.select(*KEY, F.col(vector)).mapInArrow(explain, schema)
