"""Near-duplicates by MinHash with tensored banding; candidates are verified on full shingle sets.

Two collections of ``halves`` short keys (two minhashes each) are computed per set. A table is a
pair of one key from either collection, so ``halves ** 2`` tables need ``4 * halves`` minhashes
instead of ``4 * halves ** 2``. Sets with similarity s meet in some table with probability
``(1 - (1 - s ** 2) ** halves) ** 2``: 0.99999 at 0.85 and 0.9999 at 0.8 with ten halves.

* Equal sets are one node, whatever the number of copies.
* A short key that nobody shares cannot be part of a shared table, so pairs are formed only from
  shared ones.
* Round one compares the members of a table bucket with two pivots, and most buckets become one
  component. Round two compares what is left: buckets with several components that share members
  are one group, its members are dealt into cells of bounded size, and a task compares a cell as a
  product of matrices and returns only links that connect components. So no link that a bucket
  offers is lost, and no pairs are written for a large group of near copies.

A text without words has an empty set and no links. Rows without a key are never linked; their
component is null. Rows with one key are one document: it has the links of any of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.llm.components import components
from pacemark.llm.text_arrays import SPACED, constants, mix, pieces, shingle_hashes, shingle_sets, word_bounds, word_hashes
from pacemark.session import written

HALVES = 10
#: Members of a block; two blocks meet in a cell of round two.
CELL_MEMBERS = 256

_MULTIPLY = constants(4 * 64, 11)
_ADD = constants(4 * 64, 12)
_DIGEST = constants(2, 13)


def _signature_rows(column: pa.Array, halves: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Set sizes, two digests and short keys of the texts, piece by piece."""
    for _lo, _hi, data, offsets in pieces(column):
        starts, ends, first = word_bounds(data, offsets, SPACED)
        shingles, at = shingle_hashes(word_hashes(data, starts, ends), first)
        sets = [np.unique(shingles[at[i]:at[i + 1]]) for i in range(len(at) - 1)]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(sizes)
        digests = np.zeros((2, len(sets)), dtype=np.uint64)
        keys = np.zeros((len(sets), 2 * halves), dtype=np.uint64)
        if len(full):
            own = np.concatenate(sets)
            edges = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
            for k in range(2):
                digests[k, full] = np.add.reduceat(mix(own ^ _DIGEST[k]), edges)
            for k in range(2 * halves):
                a, b = (np.minimum.reduceat(own * _MULTIPLY[i] + _ADD[i], edges) for i in (2 * k, 2 * k + 1))
                keys[full, k] = mix(mix(a) + b * np.uint64(3) + _ADD[k])
        yield sizes, digests[0], digests[1], keys


def signatures(docs: DataFrame, key: str, text: str, halves: int = HALVES) -> DataFrame:
    """Per row: ``row_key``, ``n`` (set size), ``d1`` and ``d2`` (digest of the set), ``keys`` (short keys)."""
    plain = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    out = f"row_key {dict(plain.dtypes)['row_key']}, n long, d1 long, d2 long, keys array<long>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for n, d1, d2, keys in _signature_rows(batch.column(1), halves):
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * halves)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(n)), pa.array(n), pa.array(d1.view(np.int64)),
                     pa.array(d2.view(np.int64)), lists], names=["row_key", "n", "d1", "d2", "keys"])
                lo += len(n)

    return plain.mapInArrow(rows, out)


def _similar(threshold: tuple[int, int]):
    """Keeps pairs of texts whose sets reach the threshold, a fraction of whole numbers."""
    above, below = threshold

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            for (i, x), (_, y) in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = below * both >= above * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return rows


def verified(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a``, ``b``, ``linked`` of every pair, decided on the full sets of their texts (``row_key``, ``text``)."""
    kind = dict(pairs.dtypes)["a"]
    left = texts.select(F.col("row_key").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("row_key").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(_similar(threshold), f"a {kind}, b {kind}, linked boolean")


def _sizes_fit(threshold: tuple[int, int]) -> Column:
    above, below = threshold
    return (F.least("n_a", "n_b") * below >= F.greatest("n_a", "n_b") * above)


def table_buckets(nodes: DataFrame, halves: int) -> DataFrame:
    """``node``, ``n``, ``bucket`` for every table bucket that at least two nodes share."""
    short = written(nodes.select("node", "n", F.posexplode("keys").alias("place", "short")), "short-keys")
    shared = short.groupBy("short").agg(F.count("*").alias("c")).where("c > 1").select("short")
    kept = short.join(shared, "short", "left_semi")
    sides = kept.groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("place") < halves, F.col("short"))).alias("first"),
        F.collect_list(F.when(F.col("place") >= halves, F.col("short"))).alias("second"))
    tables = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    keyed = written(sides.select("node", "n", F.explode(tables).alias("bucket")), "tables")
    many = keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return written(keyed.join(many, "bucket"), "buckets")


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """Each member with the first and the last member of its buckets in a random order."""
    ranked = buckets.withColumn("at", F.struct(F.xxhash64("node").alias("o"), F.col("node"), F.col("n")))
    ends = ranked.groupBy("bucket").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    met = ranked.join(ends, "bucket").select(
        "node", "n", F.explode(F.array("lo", "hi")).alias("pivot"))
    return met.select("node", "n", F.col("pivot.node").alias("other"), F.col("pivot.n").alias("n_other"))


def _ordered(pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    first = F.col("node") < F.col("other")
    return (pairs.where("node <> other").select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("n_other")).alias("n_a"),
        F.when(first, F.col("n_other")).otherwise(F.col("n")).alias("n_b"))
        .where(_sizes_fit(threshold)).select("a", "b").distinct())


def _open_cells(buckets: DataFrame, labels: DataFrame, cell: int) -> DataFrame:
    """``node``, ``component`` and the cells it is compared in, for members of buckets with several components.

    Open buckets that share members make one group. A group is dealt into blocks of about ``cell`` members
    by hash; a cell holds two blocks, and every two members of a group meet in one cell.
    """
    labelled = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = written(labelled.select("bucket", "node", "component"), "labelled")
    mixed = (labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                            F.min("node").alias("first")).where("lo <> hi").select("bucket", "first"))
    open_ = written(labelled.join(mixed, "bucket"), "open")
    groups = components(open_, "node", "first").select("node", F.col("component").alias("group"))
    members = written(open_.select("node", "component").distinct().join(groups, "node"), "members")
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("blocks"))
    return (members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("x", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("node", "component", "group", F.least("block", "x").alias("cell_a"),
                    F.greatest("block", "x").alias("cell_b"), "block"))


#: Shingles of a cell whose occurrences are held as a matrix at once.
_COLUMNS = 4096


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    names, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one set is in no intersection
    place = np.cumsum(seen > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = seen[at] > 1
    owner, at = owner[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + _COLUMNS))
        held = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        held[owner[a:b], at[a:b] - lo] = 1
        out += held[left] @ held[right].T
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix of links connects."""
    todo, out = np.ones(len(linked), dtype=bool), []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root], queue = False, [root]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(linked[i] & todo)
            todo[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def _cell_links(cells: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a``, ``b``: links within each cell that connect members of different components."""
    kind = dict(cells.dtypes)["node"]
    above, below = threshold

    def compare(got: pa.Table) -> pa.Table:
        sets = [s for _, s in shingle_sets(got["text"].combine_chunks())]
        nodes, component = got["node"].to_pylist(), got["component"].to_numpy(zero_copy_only=False)
        block, n = got["block"].to_numpy(), np.array([len(s) for s in sets])
        left = np.flatnonzero(block == got["cell_a"][0].as_py())
        right = np.flatnonzero(block == got["cell_b"][0].as_py())
        linked = np.zeros((len(sets), len(sets)), dtype=bool)
        if len(left) and len(right):
            both = _common(sets, left, right)
            near = below * both >= above * (n[left][:, None] + n[right][None, :] - both)
            linked[np.ix_(left, right)] = near & (component[left][:, None] != component[right][None, :])
        found = _forest(linked | linked.T)
        return pa.table({"a": got["node"].take(pa.array([i for i, _ in found], pa.int64())),
                         "b": pa.array([nodes[j] for _, j in found], type=got["node"].type)})

    joined = cells.join(texts.hint("merge"), cells["node"] == texts["row_key"]).select(*cells.columns, "text")
    return joined.groupBy("group", "cell_a", "cell_b").applyInArrow(compare, f"a {kind}, b {kind}")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = (80, 100),
                halves: int = HALVES, cell: int = CELL_MEMBERS) -> DataFrame:
    """Per row: its key, ``n_shingles``, ``component_id`` and ``kept``."""
    signed = written(signatures(docs, key, text, halves), "signatures")
    filled = signed.where("n > 0 AND row_key IS NOT NULL")
    # rows with one key are one document, so its sets share the node of the key
    nodes = written(filled.groupBy("d1", "d2").agg(
        F.min("row_key").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.count("*").alias("copies")), "nodes")
    buckets = table_buckets(nodes, halves)
    texts = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    # the join does not change its kind with the size, so costs grow as the input does
    met = buckets.select(F.col("node").alias("row_key")).distinct()
    met = written(texts.join(met.hint("merge"), "row_key", "left_semi"), "bucket-texts")
    pairs = written(_ordered(_pivot_pairs(buckets), threshold), "pivot-pairs")
    first = written(verified(pairs, met, threshold).where("linked").select("a", "b"), "pivot-links")
    links = first.union(_links_of_keys(filled, nodes))
    labels = written(components(links, "a", "b"), "components")
    second = written(_cell_links(_open_cells(buckets, labels, cell), met, threshold), "cell-links")
    if second.take(1):
        labels = components(links.union(second), "a", "b")
    labels = written(labels, "components")
    copies = nodes.where("copies > 1").select("d1", "d2", "node")
    out = signed.join(copies, ["d1", "d2"], "left").withColumn(
        "node", F.when((F.col("n") > 0) & F.col("row_key").isNotNull(), F.coalesce("node", "row_key"))
        .otherwise(F.col("row_key")))
    out = out.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select(F.col("row_key").alias(key), F.col("n").alias("n_shingles"), "component_id",
                      F.col("row_key").eqNullSafe(F.col("component_id")).alias("kept"))


def _links_of_keys(filled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of rows that have the same key but different sets."""
    twice = filled.groupBy("row_key").agg(F.count("*").alias("c")).where("c > 1").select("row_key")
    mine = filled.join(twice, "row_key", "left_semi").select("row_key", "d1", "d2").join(
        nodes.select("d1", "d2", "node"), ["d1", "d2"])
    return mine.where("row_key <> node").select(F.col("row_key").alias("a"), F.col("node").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """All columns, whatever their names, of the rows whose document represents its group; rows with its key stay together."""
    gone = written(near_groups(docs, key, text, threshold).where(~F.col("kept")).select(key).distinct(), "near-copies")
    return docs.join(gone, key, "left_anti")
