"""Phrases that occur more often than their parts explain, counted with burst tries.

Texts are cut at sentence marks and line ends into pieces and those at spaces and tabs into words, A-Z in lower case.
Every count is per language. The whole texts are read three times.

The first two passes are sieves: the first of words and pairs, the second of longer phrases whose words and pairs are
left. Phrases are counted by hash cells, so that a cell counts at least as often as any phrase in it; cells with fewer than
``least`` hold no candidate and no part of one, since a phrase occurs no more often than its parts. Tasks compact
their cells and send sorted runs, cut by ranges of cells; each range is merged by itself. The cells left make a filter of
bounded size for each length: it may let further phrases in, but keeps none out.

The third pass counts the phrases of 1 to 5 words that are left (``HatTrie``): a task holds a
shallow trie over word ids whose leaves are hash containers of phrase ends. A container that grows over ``BURST``
entries bursts into a node with a container for each next word. Beyond ``ENTRIES`` phrases whole subtrees are spilled
as sorted runs, the largest first. Runs are cut and dealt by the first two words of their phrases, so every partition
merges the runs of its prefixes; there are as many partitions as the size of the texts asks for.

Word ids are 64-bit hashes of language and word and never leave a task; runs hold the words themselves.

Defined results: a null text is empty, a null language is ``und``; empty texts and tables give nothing; rows that
repeat a key count once each; equal scores are ordered by count, then by phrase. Only the named columns are read, so
other columns may have any name. Texts of any length are taken in pieces of a few MB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacemark.llm.text_arrays import _FOLD, constants, mix, pieces, word_bounds, word_hashes
from pacemark.session import written

#: Entries of a container before it bursts, and phrases a task holds before it spills.
BURST, ENTRIES = 4096, 250_000
LONGEST = 5
#: Bits of the filter for each frequent phrase, and bits at most (16 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 27

#: Cells a task holds before it sends them, and bytes of text for each range of cells.
SIEVE_ENTRIES, RANGE_BYTES = 1 << 20, 1 << 23

_CUTS = np.zeros(256, dtype=bool)
_CUTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_CUTS
_INSIDE[list(b" \t")] = False
_PLACES = constants(LONGEST, 81)
_PROBES = constants(2, 82)
_LOWER = bytes(_FOLD.astype(np.uint8).tolist())


class Node(dict):
    """A trie node: children by next word; ``ends`` counts the phrase that ends here."""

    ends = 0


class HatTrie:
    """Counts of phrases, which are strings of 8-byte word ids."""

    def __init__(self, burst: int = BURST, entries: int = ENTRIES):
        self.burst, self.entries = burst, entries
        self.single: dict[bytes, int] = {}
        self.root: dict[bytes, dict] = {}
        self.sizes: dict[bytes, int] = {}
        self.held = 0

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        root, sizes, single = self.root, self.sizes, self.single
        for key, count in zip(keys, counts):
            head, rest = key[:8], key[8:]
            if not rest:
                single[head] = single.get(head, 0) + count
                continue
            box = root.get(head)
            if box is None:
                box = root[head] = {}
                sizes[head] = 0
            path = word = None
            while type(box) is Node and rest:
                path, word, rest = box, rest[:8], rest[8:]
                box = path.get(word)
                if box is None:
                    box = path[word] = {}
            if type(box) is Node:
                sizes[head] += not box.ends
                box.ends += count
                continue
            before = box.get(rest)
            if before is not None:
                box[rest] = before + count
                continue
            box[rest] = count
            sizes[head] += 1
            if len(box) > self.burst:
                (root if path is None else path)[head if path is None else word] = self._burst(box)
        self.held = len(single) + sum(sizes.values())

    @staticmethod
    def _burst(box: dict) -> Node:
        node = Node()
        for rest, count in box.items():
            if rest:
                node.setdefault(rest[:8], {})[rest[8:]] = count
            else:
                node.ends = count
        return node

    def _walk(self, box: dict, path: bytes) -> Iterator[tuple[bytes, int]]:
        if type(box) is Node:
            if box.ends:
                yield path, box.ends
            for word in sorted(box):
                yield from self._walk(box[word], path + word)
        else:
            for rest in sorted(box):
                yield path + rest, box[rest]

    def spill(self, down_to: int = 0) -> Iterator[tuple[bytes, int]]:
        """Sorted runs of whole subtrees, the largest first, until ``down_to`` phrases are left; then single words."""
        for head in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if self.held <= down_to:
                return
            yield from self._walk(self.root.pop(head), head)
            self.held -= self.sizes.pop(head)
        if self.held > down_to:
            # words met late are the rarer ones
            late = sorted(list(self.single)[down_to:])
            for head in late:
                yield head, self.single.pop(head)
            self.held -= len(late)


class Filter:
    """Cells of phrases, with a bounded number of bits; false hits are possible, misses are not."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def slots(keys: np.ndarray, slots: int) -> list[np.ndarray]:
        return [mix(keys ^ p) & np.uint64(slots - 1) for p in _PROBES]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for slot in self.slots(_cell(hashes, self.bits), len(self.words) * 64):
            out &= (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return out


def _tongue(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def _words(data: np.ndarray, offsets: np.ndarray, tongue: np.ndarray):
    """Bounds of all words, their ids, the piece of text each is in and their rows."""
    starts, ends, first = word_bounds(data, offsets, _INSIDE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ids = mix(word_hashes(data, starts, ends) ^ tongue[row])
    cut = np.cumsum(_CUTS[data])[starts] if len(starts) else np.zeros(0, dtype=np.int64)
    # cuts before a word and rows before it: pieces differ if either does
    return starts, ends, ids, cut + row, row


def _phrase_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out += ids[at + k] * _PLACES[k]
    return mix(out)


def _plain(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))


def _read(batches: Iterator[pa.RecordBatch]):
    """Per piece of a batch: bytes, word bounds, ids, pieces of text, language of each word, and languages."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        tongues = langs.dictionary.to_pylist()
        hashes = np.array([_tongue(t) for t in tongues], dtype=np.uint64)
        codes = langs.indices.to_numpy()
        for lo, hi, data, offsets in pieces(batch.column(1)):
            starts, ends, ids, piece, row = _words(data, offsets, hashes[codes[lo:hi]])
            yield data, (starts, ends), ids, piece, codes[lo:hi][row], tongues


def _places(ids: np.ndarray, piece: np.ndarray, sizes: range, known: dict[int, Filter]) -> Iterator[tuple[int, np.ndarray]]:
    """Where phrases of the given sizes begin, if they and all their parts pass the filters there are."""
    run = np.ones(len(ids), dtype=bool)
    for size in range(1, max(sizes) + 1):
        if size > 1:
            run = run[:-1] & run[1:]
        if size == 2:
            run &= piece[:-1] == piece[1:]
        if size in known:
            at = np.flatnonzero(run)
            run[at] = known[size].has(_phrase_hashes(ids, at, size))
        if size in sizes:
            yield size, np.flatnonzero(run)


def count_phrases(docs: DataFrame, filters: dict, bits: int, lang: str = "lang", text: str = "text",
                  burst: int = BURST, entries: int = ENTRIES) -> DataFrame:
    """Counts (lang, phrase, f) of the phrases that pass the broadcast filters of their sizes; the empty phrase counts all words."""
    plain = _plain(docs, lang, text)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names, total = HatTrie(burst, entries), {}, {}
        known = {k: f.value for k, f in filters.items()}
        for data, (starts, ends), ids, piece, code, tongues in _read(batches):
            for c, n in enumerate(np.bincount(code, minlength=len(tongues)).tolist()):
                if n:
                    total[tongues[c]] = total.get(tongues[c], 0) + n
            used = np.zeros(len(ids), dtype=bool)
            new = []
            for size, at in _places(ids, piece, range(1, LONGEST + 1), known):
                _, one, count = np.unique(_phrase_hashes(ids, at, size), return_index=True, return_counts=True)
                at = at[one]
                used[at] = True
                raw = np.stack([ids[at + k] for k in range(size)], axis=1).astype(">u8").tobytes()
                new.append(([raw[i:i + 8 * size] for i in range(0, len(raw), 8 * size)], count.tolist()))
            at = np.flatnonzero(used)
            at = at[np.unique(ids[at], return_index=True)[1]]
            lower = data.tobytes().translate(_LOWER)
            for i, s, e, c in zip(ids[at].tolist(), starts[at].tolist(), ends[at].tolist(), code[at].tolist()):
                i = i.to_bytes(8, "big")
                if i not in names:
                    # a word holds no tab
                    names[i] = tongues[c].encode() + b"\t" + lower[s:e]
            for keys, counts in new:
                trie.add(keys, counts)
            if trie.held > entries or len(names) > 2 * entries:
                yield from _runs(trie.spill(entries // 2 if len(names) <= 2 * entries else 0), names, bits)
                if not trie.held:
                    names = {}
        yield from _runs(trie.spill(), names, bits, {t.encode() + b"\t": n for t, n in total.items()})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def left() -> Iterator[pa.RecordBatch]:
            names = sorted(sums)
            for lo in range(0, len(names), 50_000):
                own = names[lo:lo + 50_000]
                parts = [n.rpartition(b"\t") for n in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in parts], pa.binary()).cast(pa.string()), pa.array([p[2] for p in parts], pa.binary())
                     .cast(pa.string()), pa.array([sums[n] for n in own], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for part, names, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != now:
                    yield from left()
                    now, sums = part, {}
                for n, c in zip(names.values.to_pylist(), counts.values.to_pylist()):
                    sums[n] = sums.get(n, 0) + c
        yield from left()

    # runs are dealt by the first words of their phrases, so the counts of a phrase meet
    return (plain.mapInArrow(runs, "part long, names array<binary>, counts array<long>").repartition("part")
            .sortWithinPartitions("part").mapInArrow(merged, "lang string, phrase string, f long"))


def _runs(run: Iterator[tuple[bytes, int]], names: dict, bits: int, more: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Spilled subtrees as sorted runs, one row for each partition of prefixes: languages with phrases, and counts."""
    parts: dict[int, tuple[list, list]] = {}

    def put(prefix: bytes, name: bytes, count: int) -> None:
        own = parts.setdefault(zlib.crc32(prefix) & ((1 << bits) - 1), ([], []))
        own[0].append(name)
        own[1].append(count)

    for key, count in run:
        name = prefix = names[key[:8]]
        if len(key) > 8:
            words = [names[key[i:i + 8]].rpartition(b"\t")[2] for i in range(8, len(key), 8)]
            name, prefix = b" ".join([name, *words]), name + b" " + words[0]
        put(prefix, name, count)
    for name, count in (more or {}).items():
        put(name, name, count)
    for lo in range(0, len(parts), 256):
        own = sorted(parts)[lo:lo + 256]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([parts[p][0] for p in own], pa.list_(pa.binary())),
                                          pa.array([parts[p][1] for p in own], pa.list_(pa.int64()))], names=["part", "names", "counts"])


class _Cells:
    """Counts of hash cells that a task compacts and cuts into runs."""

    def __init__(self, bits: int):
        self.bits, self.held, self.rows = bits, [], 0

    def add(self, hashes: np.ndarray) -> None:
        cells, counts = np.unique(_cell(hashes, self.bits), return_counts=True)
        self.held.append((cells, counts.astype(np.uint64)))
        self.rows += len(cells)
        if self.rows > 2 * SIEVE_ENTRIES:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            self.held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        self.held = [_summed(*(np.concatenate(x) for x in zip(*self.held)))]
        self.rows = len(self.held[0][0])
        return self.held[0]

    def runs(self, size: int) -> Iterator[pa.RecordBatch]:
        """One row per range of cells: the cells met once, and the others with their counts."""
        cells, counts = self.compact()
        part = (cells >> np.uint64(32)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, int)
        low, counts = cells.astype(np.uint32), np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
        for lo in range(0, len(cuts) - 1, 4096):
            some = list(zip(cuts[lo:lo + 4096], cuts[lo + 1:lo + 4097]))
            once = [counts[a:b] == 1 for a, b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(some), pa.int32()), pa.array([part[a] for a, _ in some], pa.int64()),
                 pa.array([low[a:b][o].tobytes() for (a, b), o in zip(some, once)], pa.binary()),
                 pa.array([low[a:b][~o].tobytes() for (a, b), o in zip(some, once)], pa.binary()),
                 pa.array([counts[a:b][~o].tobytes() for (a, b), o in zip(some, once)], pa.binary())],
                names=["size", "part", "once", "more", "times"])
        self.held, self.rows = [], 0


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(cells), 1), bool), cells[1:] != cells[:-1])))
    return cells[first], np.add.reduceat(counts[order], first, dtype=np.uint64) if len(first) else counts


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A range of cells (the first ``bits`` bits) and a cell of 32 bits in it."""
    part = hashes >> np.uint64(64 - bits) if bits else np.zeros_like(hashes)
    return (part << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def sieve(docs: DataFrame, least: int, sizes: range, filters: dict, bits: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """Cells (size of the phrases, key) that count ``least`` at least, of phrases whose parts pass the broadcast filters.

    ``bits`` name a range of cells (``range_bits``).
    """
    plain = _plain(docs, lang, text)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {size: _Cells(bits) for size in sizes}
        known = {k: f.value for k, f in filters.items()}
        for _, _, ids, piece, _, _ in _read(batches):
            for size, at in _places(ids, piece, sizes, known):
                cells[size].add(_phrase_hashes(ids, at, size))
                if cells[size].rows > SIEVE_ENTRIES:
                    yield from cells[size].runs(size)
        for size, own in cells.items():
            yield from own.runs(size)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], 0

        def left() -> pa.RecordBatch:
            cells, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
            key = cells[counts >= least].astype(np.int64) | (now[1] << 32)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), now[0], np.int32)), pa.array(key)], names=["size", "key"])

        for batch in batches:
            for size, part, once, more, times in zip(*(batch.column(i) for i in range(5))):
                if (own := (size.as_py(), part.as_py())) != now:
                    if now:
                        yield left()
                    now, held, rows = own, [], 0
                once, more, times = (np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in (once, more, times))
                held.append((np.concatenate((once, more)), np.concatenate((np.ones(len(once), np.uint64), times))))
                rows += len(once) + len(more)
                if rows > SIEVE_ENTRIES:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    rows = 0
        if now:
            yield left()

    # hash ranges are even, and there are as many as the size of the texts asks for
    made = plain.mapInArrow(runs, "size int, part long, once binary, more binary, times binary")
    return made.repartition("size", "part").sortWithinPartitions("size", "part").mapInArrow(merged, "size int, key long")


def range_bits(docs: DataFrame, text: str = "text") -> int:
    """The bits that name a range of cells: one range for every ``RANGE_BYTES`` of text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    bits = 0
    while (RANGE_BYTES << bits) < size and bits < 20:
        bits += 1
    return bits


def filter_of(keys: DataFrame, bits: int = 0, bits_each: int = FILTER_BITS, most_bits: int = MOST_BITS):
    """A broadcast filter of all rows of ``key``; its size is bounded, so it is fuller where there are more."""
    slots = 1 << 16
    n = keys.count()
    while slots < bits_each * n and slots < most_bits:
        slots *= 2

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.concatenate(Filter.slots(batch.column(0).to_numpy().astype(np.uint64), slots))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)),
                                              pa.array((slot & np.uint64(63)).astype(np.int32))], names=["word", "bit"])

    # no more rows than the filter has words
    got = (keys.select("key").mapInArrow(placed, "word long, bit int").groupBy("word")
           .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set")).toArrow())
    words = np.zeros(slots // 64, dtype=np.uint64)
    words[got["word"].to_numpy()] = got["set"].to_numpy().astype(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Filter(words, bits))


def phrase_counts(docs: DataFrame, least: int = 100, lang: str = "lang", text: str = "text",
                  **trie) -> tuple[DataFrame, DataFrame]:
    """Words counted per language (lang, n), and phrases of 1 to 5 words with ``least`` occurrences (lang, phrase, size, f)."""
    bits, filters = range_bits(docs, text), {}
    for sizes in (range(1, 3), range(3, LONGEST + 1)):
        cells = written(sieve(docs, least, sizes, filters, bits, lang, text), "cells")
        filters |= {k: filter_of(cells.where(F.col("size") == k), bits) for k in sizes}
    counts = count_phrases(docs, filters, bits, lang, text, **trie)
    counts = written(counts.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return totals, counts.where("phrase <> ''").withColumn("size", F.size(F.split("phrase", " ")))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang: str = "lang", text: str = "text", **trie) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to 5 words counts ``a``; its weakest cut has parts that count ``l`` and ``r``. Phrases that occur
    nowhere but inside one longer phrase are left out.
    """
    totals, counts = phrase_counts(docs, least, lang, text, **trie)
    candidates = counts.where(F.col("size") > 1).withColumnRenamed("f", "a")
    # a phrase inside a longer one is inside one that is longer by a word, which occurs at least as often
    inside = (candidates.where(F.col("size") > 2)
              .select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"),
                                                F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("within")))
    own = (candidates.join(inside, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a")))
           .drop("within"))
    cuts = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size").select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    part = counts.select("lang", "phrase", "f")
    both = (cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
            .join(totals, "lang"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(a * CAST(1000 AS DECIMAL(4,0)) * n) div (l * r)")
    scored = (both.select("lang", "phrase", "k", *(wide(c).alias(c) for c in ("a", "l", "r", "n")))
              .withColumn("score", score)
              .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")))
    flat = scored.select("lang", "phrase", *(F.col(f"cut.{c}").cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (flat.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
