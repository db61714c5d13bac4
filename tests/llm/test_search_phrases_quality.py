"""Ranked search, collocations and the quality classifier against plain Python and on tables with nulls, ties and repeats."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pacemark.llm import collocations, max_sketch, quality_classifier

SMALL = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, row_key string, n int, sketch string, place string, item string, score string, "
          "term string, df int, phrase string, f int, prefix string, size int, a int, good int, vector string, rank int, nth int")
EXTRA = ("k", 1, "s", "p", "i", "sc", "t", 2, "ph", 3, "pr", 4, 5, 6, "v", 7, 8)
WORDS = [f"w{i}" for i in range(30)] + ["Über", "ÉTÉ", "don't", "x-y", "naïve"]


def table(spark, rows):
    return spark.createDataFrame([(k, t, g, *EXTRA) for k, t, g in rows], SCHEMA)


def rows_with_edges():
    rng = random.Random(11)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    say = lambda n: " ".join(rng.choices(WORDS, weights, k=n)) + rng.choice(["", ".", "\n", "!?"])
    rows = [(i, " ".join(say(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 9))), rng.choice(["en", "fr", None]))
            for i in range(150)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \t\n.,;", None), (None, say(30), "en"), (None, None, None),
             (203, rows[3][1], "en"), (203, rows[3][1], "en"), (203, say(9), "fr"), (204, "w0 " * 3000, "en"),
             (205, say(20_000), "fr"), (206, "W0\tw1  W2", "en"), (207, "\x00w0\x7fw1  w2", "en"), (208, "z" * 50_000, "und")]
    return rows


def terms_of(text):
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(items, docs, k):
    held = [(key, collections.Counter(terms_of(t))) for key, t, _ in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    total, length = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for key, c, n in held:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms if c[t])
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,k", [(256, 10), (2, 3)])
def test_search_is_exact(spark, monkeypatch, block, k):
    monkeypatch.setattr(max_sketch, "BLOCK_ITEMS", block)
    docs = rows_with_edges()
    items = [(1, "w0 w1 W29 über"), (2, "w3 w3 nothing of this"), (3, None), (4, ""), (5, "naïve été don't"), (None, "w7"),
             (6, docs[3][1]), (6, "w28"), (7, "unknown"), (8, " ".join(WORDS))]
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, term string, item_key string")
    found = max_sketch.search(asked, table(spark, docs).repartition(5), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked(items, docs, k)


def test_search_of_empty_tables(spark):
    docs, items = table(spark, rows_with_edges()), spark.createDataFrame([(1, "w0")], "item_id long, text string")
    assert max_sketch.search(items.limit(0), docs).collect() == []
    assert max_sketch.search(items, docs.where("doc_id in (200, 201, 202)")).collect() == []
    assert max_sketch.search(items, docs.limit(0)).collect() == []


def test_bounds_are_not_below_scores():
    texts = [t for _, t, _ in rows_with_edges() if terms_of(t)]
    column = pa.array(texts)
    block = max_sketch.Block([(i % 3, w.lower(), 900 + 37 * i) for i, w in enumerate(WORDS)], 3, len(texts),
                             sum(len(terms_of(t)) for t in texts))
    sketched = [max_sketch._sketches(d, o) for _, _, d, o in max_sketch.pieces(column)]
    n = np.concatenate([s[0] for s in sketched])
    cells = np.concatenate([s[1] for s in sketched])
    at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(s[2]) for s in sketched]))))
    scores, seen = block.scores(column, n), 0
    for rows, bounds in block.bounds(n, cells, at):
        assert (bounds >= scores[rows]).all()
        seen += len(rows)
    assert seen == len(texts) and scores.any()


def best_phrases(docs, least, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        rows = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            cuts = [((1000 * a * n[lang]) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("burst,entries,top", [(4096, 250_000, 2000), (2, 20, 7)])
def test_collocations_are_exact(spark, burst, entries, top):
    docs = rows_with_edges()
    found = collocations.collocations(table(spark, docs).repartition(3), least=5, top=top, burst=burst, entries=entries)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(t == "bigint" for c, t in found.dtypes if c not in ("lang", "phrase"))
    expected = best_phrases(docs, 5, top)
    assert sorted(tuple(r) for r in found.collect()) == expected and len(expected) >= 7


def test_collocations_of_nothing(spark):
    docs = table(spark, rows_with_edges())
    assert collocations.collocations(docs.limit(0), least=1).collect() == []
    assert collocations.collocations(docs.where("doc_id in (200, 201, 202)"), least=1).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    totals = spark.createDataFrame([("en", 9 * 10 ** 12)], "lang string, n long")
    f = {"a": 3 * 10 ** 12, "b": 2 * 10 ** 12 + 7, "a b": 10 ** 12 + 1}
    counts = spark.createDataFrame([("en", p, a, len(p.split())) for p, a in f.items()], "lang string, phrase string, f long, size int")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **k: (totals, counts))
    [row] = collocations.collocations(table(spark, []), least=1).collect()
    assert row.score == 1000 * f["a b"] * 9 * 10 ** 12 // (f["a"] * f["b"])


def test_trie_bursts_spills_and_loses_nothing():
    rng = random.Random(3)
    trie, true, spilled = collocations.HatTrie(burst=3, entries=50), collections.Counter(), collections.Counter()
    for _ in range(60):
        keys = [b"".join(rng.randrange(6).to_bytes(8, "big") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
        trie.add(keys, [2] * len(keys))
        for k in keys:
            true[k] += 2
        if trie.held > trie.entries:
            run = list(trie.spill(25))
            for head in {k[:8] for k, _ in run}:
                subtree = [k for k, _ in run if k[:8] == head and len(k) > 8]
                assert subtree == sorted(subtree)
            spilled.update(dict(run))
            assert trie.held <= 25
    spilled.update(dict(trie.spill()))
    assert spilled == true and trie.held == 0 and not trie.root


@pytest.mark.parametrize("entries,range_bytes", [(1 << 20, 1 << 23), (30, 200)])
def test_sieve_keeps_all_frequent_words_and_pairs(spark, monkeypatch, entries, range_bytes):
    monkeypatch.setattr(collocations, "SIEVE_ENTRIES", entries)
    monkeypatch.setattr(collocations, "RANGE_BYTES", range_bytes)
    docs = rows_with_edges()
    given = table(spark, docs).repartition(3)
    bits = collocations.range_bits(given)
    column = pa.RecordBatch.from_arrays([pa.array([g or "und" for _, _, g in docs]), pa.array([t for _, t, _ in docs])], names=["a", "b"])
    words = list(collocations._read(iter([column])))
    counts = collections.defaultdict(collections.Counter)
    for _, _, ids, piece, _, _ in words:
        for k in range(1, 6):
            at = np.flatnonzero(piece[:len(piece) - k + 1] == piece[k - 1:])
            counts[k].update(collocations._cell(collocations._phrase_hashes(ids, at, k), bits).tolist())
    filters = {}
    for sizes in (range(1, 3), range(3, 6)):
        found = collocations.sieve(given, 20, sizes, filters, bits).cache()
        kept = {(r.size, r.key) for r in found.collect()}
        assert kept == {(k, c) for k in sizes for c, n in counts[k].items() if n >= 20} and kept
        for k in sizes:
            filters[k] = collocations.filter_of(found.where(f"size = {k}"), bits, most_bits=1 << 16)
            keys = np.array([c for s, c in kept if s == k], dtype=np.uint64)
            # a hash with the same range and cell
            hashes = (keys >> np.uint64(32) << np.uint64(64 - bits) if bits else np.zeros_like(keys)) | (keys & np.uint64(0xFFFFFFFF))
            assert filters[k].value.has(hashes).all()
    assert filters[2].value.has(np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)).mean() < 0.05


def held(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


def test_quality_on_rows_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    own = [k for k in truth if held(k)]
    assert sum(got[k].predicted == truth[k] for k in own) >= 0.94 * len(own)
    loss = -np.mean([math.log(max(got[k].score if truth[k] else 1 - got[k].score, 1e-6)) for k in own])
    share = np.mean([truth[k] for k in own])
    assert loss < 0.5 * -(share * math.log(share) + (1 - share) * math.log(1 - share))


def test_quality_never_learns_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held_out = quality_classifier.held_out
    turned = labels.withColumn("quality", quality_classifier.F.when(held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    a, b = (quality_classifier.fit(docs, x)[1] for x in (labels, turned))
    assert (a.w1 == b.w1).all() and a.heat == b.heat


def test_quality_of_edges(spark):
    rng = random.Random(2)
    rows = rows_with_edges() + [(1000 + i, ("### " if i % 2 else "") + " ".join(
        rng.choice(WORDS) + ("!!" if i % 2 else "") for _ in range(20)), None) for i in range(120)]
    docs = table(spark, rows).repartition(3)
    labels = spark.createDataFrame([(1000 + i, 1 - i % 2, "x") for i in range(120)] + [(None, 1, "x"), (3, None, "x"), (1000, 0, "x")],
                                   "doc_id long, quality int, good string")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(rows)
    share = model[1].prior
    empty = [r.score for r in got if r.doc_id in (200, 201)]
    assert empty == [share, share]
    junk = [r.predicted == 1 - (r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id >= 1000]
    assert np.mean(junk) > 0.95
    same = [r.score for r in got if r.doc_id == 203]
    assert len(same) == 3 and len(set(same)) == 2
    assert quality_classifier.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_quality_without_two_kinds_of_labels(spark, labels, score):
    docs = table(spark, rows_with_edges())
    model = quality_classifier.fit(docs, spark.createDataFrame([x for x in labels if not held(x[0])], "doc_id long, quality int"))
    got = {r.score for r in quality_classifier.score(docs, model).collect()}
    assert got == {score if any(not held(x[0]) for x in labels) else 0.5}


def test_contexts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, many = (quality_classifier.context_tables(docs.repartition(n)) for n in (1, 7))
    assert (one == many).all() and one[..., -1].sum(axis=1).min() > 0
    # each table counts every token once
    assert one[0, :, -1].sum() == one[1, :, -1].sum()


def test_temperature_softens_odds_that_say_too_much():
    rng = np.random.default_rng(4)
    odds = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-odds))).astype(float)
    assert abs(quality_classifier.temperature(5 * odds, y, np.ones(4000)) - 5) < 0.6
