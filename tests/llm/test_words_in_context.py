"""Rare words are told apart by their context, as what is predicted and as what it is predicted from."""

import numpy as np
import pytest

from pacemark.llm import pseudo_likelihood
from pacemark.llm.pseudo_likelihood import BATCH, CLASSES, CODES, FAN, LEVELS, RARE, Network


def test_rare_words_of_one_length_depend_on_their_neighbours(spark):
    """Sixty rare words stand each with one of sixty others; the same words dealt otherwise are less likely."""
    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(300)]
    frequent, left, right = names[:48], names[48:108], names[108:168]
    rows = []
    for i in range(1500):
        k = rng.integers(0, 60, 12)
        rows.append((i, " ".join(f"{left[j]} {right[j]} {frequent[rng.integers(48)]} {frequent[rng.integers(48)]}" for j in k)))
    pairs = rng.permutation(60)
    rows += [(9000, " ".join(f"{left[j]} {right[j]} {frequent[0]} {frequent[1]}" for j in pairs)),
             (9001, " ".join(f"{left[j]} {right[(j + 7) % 60]} {frequent[0]} {frequent[1]}" for j in pairs))]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in pseudo_likelihood.likelihoods(table, rounds=3).where("doc_id >= 9000").collect()}
    # the classes of all words are the same at every place
    assert got[9000].n_words == got[9001].n_words == 240
    assert got[9000].log_likelihood > got[9001].log_likelihood + 20


def test_probabilities_of_all_leaves_add_up():
    rng = np.random.default_rng(1)
    leaves = np.zeros(RARE * CODES)
    used = rng.choice(CODES, 500, replace=False)
    leaves[3 * CODES + used] = rng.integers(1, 50, 500)
    shares = pseudo_likelihood.shares_of(leaves)
    assert [s.shape for s in shares] == [(RARE * FAN ** j, FAN) for j in range(LEVELS)]
    net = Network.initial(np.ones(CLASSES))
    net.code_out[:] = rng.normal(0, 0.5, net.code_out.shape)
    h = np.repeat(np.tanh(rng.normal(0, 1, (1, 16))), 500, axis=0).astype(np.float32)
    share = leaves[3 * CODES + used] / (leaves.sum() + 1)
    gained = net.digits(h, np.full(500, 3), used, shares)
    assert np.ptp(gained) > 0.5 and (share * np.exp(gained)).sum() == pytest.approx(1, abs=0.01)
    net.code_out[:] = 0
    assert np.allclose(net.digits(h, np.full(500, 3), used, shares), 0, atol=1e-5)


def test_gradient_with_codes():
    rng = np.random.default_rng(0)
    shares = pseudo_likelihood.shares_of(rng.integers(0, 3, RARE * CODES).astype(float))
    net = Network(rng.normal(0, 0.3, len(Network.initial(np.ones(CLASSES)).flat)))
    context, own = rng.integers(0, CLASSES, (50, 4)), rng.integers(1, 2 * RARE, 50)
    codes, code = rng.integers(0, CODES, (50, 4)).astype(np.int32), rng.integers(0, CODES, 50).astype(np.int32)
    rare = np.flatnonzero(own < RARE)

    def value(flat):
        net = Network(flat)
        h, z = net.forward(context, codes)
        return (z[np.arange(50), own].sum() + net.digits(h[rare], own[rare], code[rare], shares).sum()) / 50

    squares, start = np.zeros(len(net.flat)), net.flat.copy()
    net.learn(context, own, squares, codes, code, shares)
    at = np.concatenate([np.argsort(-squares)[:20], len(start) - 1 - np.arange(0, 1000, 97), np.flatnonzero(squares[5200:37968])[:9] + 5200])
    for i in at:
        step = np.zeros(len(start))
        step[i] = 1e-5
        slope = (value(start + step) - value(start - step)) / 2e-5
        assert abs(slope) == pytest.approx(np.sqrt(squares[i]), rel=1e-3, abs=1e-7) and slope * (net.flat[i] - start[i]) >= 0


def test_batches_hold_whole_words(spark):
    """More words than a batch in one row, and a row without words."""
    table = spark.createDataFrame([(1, "alpha beta " * BATCH), (2, None), (3, "...")], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudo_likelihood.likelihoods(table).collect()}
    assert got[1].n_words == 2 * BATCH and got[1].log_likelihood < 0 and got[2].mean_log_likelihood is None is got[3].mean_log_likelihood
