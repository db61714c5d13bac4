"""Rank sums, quantiles and metrics against brute force."""

import hashlib
import math
import random
import statistics
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacemark.operators import comparison, metrics, quantiles, ranks


def average_ranks(x):
    order = np.sort(x)
    return np.array([(np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2 for v in x])


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_rank_sums_do_not_depend_on_the_cuts(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rng = np.random.RandomState(1)
    groups = {"a": rng.randint(-9, 10, 400).astype(float), "b": rng.normal(0.2, 1, 150), "c": np.zeros(5)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, d double")
    got = {r.g: r for r in ranks.signed_rank_sums(df, ["g"], "d").collect()}
    for g, d in groups.items():
        nz = d[d != 0]
        r = average_ranks(np.abs(nz)) if len(nz) else np.array([])
        _, sizes = np.unique(np.abs(nz), return_counts=True)
        assert (got[g].n, got[g].zeros) == (len(nz), len(d) - len(nz))
        assert got[g].w_plus == pytest.approx(r[nz > 0].sum())
        assert got[g].w_minus == pytest.approx(r[nz < 0].sum())
        assert got[g].ties == pytest.approx((sizes.astype(float) ** 3 - sizes).sum())


@pytest.mark.parametrize("partitions", [1, 5])
def test_delta_counts_all_pairs(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rng = np.random.RandomState(2)
    x, y = rng.randint(0, 30, 300).astype(float), rng.randint(0, 35, 200).astype(float)
    rows = [("g", float(v), True) for v in x] + [("g", float(v), False) for v in y]
    df = spark.createDataFrame(rows, "g string, v double, is_x boolean")
    r = ranks.order_counts(df, ["g"], "v", F.col("is_x")).first()
    assert (r.n_first, r.n_second) == (300, 200)
    assert r.above == (x[:, None] > y[None, :]).sum() and r.below == (x[:, None] < y[None, :]).sum()
    back = ranks.order_counts(df, ["g"], "v", ~F.col("is_x")).first()
    assert (back.above, back.below) == (r.below, r.above)


@pytest.mark.parametrize("partitions", [1, 6])
def test_random_guess_error_is_the_exact_expectation(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rng = np.random.RandomState(3)
    train, test = rng.lognormal(3, 1, 300).round(1), rng.lognormal(3, 1, 90).round(1)
    rows = [("g", float(v), False) for v in train] + [("g", float(v), True) for v in test]
    df = spark.createDataFrame(rows, "g string, v double, is_test boolean")
    r = ranks.random_guess_error(df, ["g"], "v", F.col("is_test")).first()
    apart = np.abs(test[:, None] - train[None, :])
    assert r.mae_p0 == pytest.approx(apart.mean())
    assert r.std_p0 == pytest.approx(np.sqrt(apart.var(axis=1).sum()) / len(test))
    draws = [np.abs(test - rng.choice(train, len(test))).mean() for _ in range(1000)]
    assert r.mae_p0 == pytest.approx(np.mean(draws), rel=0.02)
    assert r.std_p0 == pytest.approx(np.std(draws, ddof=1), rel=0.1)


def test_small_tie_free_samples_use_the_exact_distribution(spark):
    d = [1.0, -2.0, 3.0, 4.0, -5.0, 6.0, 7.0]
    df = spark.createDataFrame([("g", max(v, 0.0), max(-v, 0.0)) for v in d], "g string, error_1 double, error_2 double")
    r = comparison.wilcoxon(df, ["g"]).first()
    sums = [sum(k for k, s in zip(range(1, 8), signs) if s) for signs in product([0, 1], repeat=7)]
    assert r.statistic == 7.0
    assert r.p_value == pytest.approx(min(1.0, 2 * sum(s <= 7 for s in sums) / 2 ** 7))


def test_larger_samples_use_the_normal_approximation(spark):
    rng = np.random.RandomState(4)
    d = rng.normal(0.1, 1, 200)
    df = spark.createDataFrame([("g", float(max(v, 0)), float(max(-v, 0))) for v in d],
                               "g string, error_1 double, error_2 double")
    r = comparison.wilcoxon(df, ["g"]).first()
    rank = average_ranks(np.abs(d))
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    z = (w - 200 * 201 / 4) / math.sqrt(200 * 201 * 401 / 24)
    assert (r.statistic, r.z) == (pytest.approx(w), pytest.approx(z))
    assert r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_identical_errors_give_no_p(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0)] * 5, "g string, error_1 double, error_2 double")
    r = comparison.wilcoxon(df, ["g"]).first()
    assert (r.n, r.zeros, r.p_value) == (0, 5, None)


def test_quantiles_are_exact(spark):
    rng = np.random.RandomState(6)
    # sizes on both sides of every width of the brackets
    groups = {f"n{n}": rng.lognormal(2, 1, n) for n in (2, 4, 29, 30, 31, 299, 300, 301, 2999, 3000, 3001, 29_999, 30_001, 70_000)}
    groups |= {"hot": rng.lognormal(2, 1, 6000), "ties": rng.randint(0, 4, 3000).astype(float),
              "few": np.array([5.0, 1.0, 9.0]), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    for r in quantiles.quantiles(df, ["g"], "v", wanted).collect():
        assert r.n == len(groups[r.g])
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.percentile(groups[r.g], p * 100), rel=1e-12), (r.g, name)
    every = np.concatenate(list(groups.values()))
    whole = quantiles.quantiles(df, [], "v", {"m": 0.5}).first()
    assert (whole.n, whole.m) == (len(every), pytest.approx(np.median(every)))


def test_keys_have_the_order_and_bits_of_doubles(spark):
    rng = np.random.RandomState(3)
    edges = [0.0, -0.0, 1.0, 2.0, 0.5, 1e308, 1.7976931348623157e308, 5e-324, 2.2250738585072014e-308,
             2.225073858507201e-308, 1e-310, float("inf")]
    powers = [2.0 ** e for e in range(-1074, 1024, 3)]
    below = [float(np.nextafter(x, 0)) for x in powers] + [float(np.nextafter(x, np.inf)) for x in powers]
    values = np.array(edges + powers + below + list(np.exp(rng.uniform(-700, 700, 3000))))
    values = np.concatenate([values, -values])
    df = spark.createDataFrame([(float(v),) for v in values], "_v double")
    for v, key in quantiles.with_order_key(df).collect():
        bits = int(np.float64(abs(v)).view(np.int64))
        assert key == (-bits if v < 0 else bits), v


def test_no_task_sorts_more_than_a_digit(spark):
    df = spark.range(200_000).select(F.col("id").cast("double").alias("_v"), F.lit("hot").alias("g"))
    assert quantiles.quantiles(df, [], "_v", {"m": 0.5}).first().m == 99_999.5
    inside = quantiles._inside(df, ["g"], [0.5])
    # the first digit leaves 256 cells per power of two, two of which hold the median
    assert inside.count() <= 2 * 65_536 / 256
    # three digits of 20, 22 and 22 bits make up the key, which no value exceeds
    assert 64 - quantiles._BELOW_FIRST <= 22 and quantiles._BELOW_FIRST - quantiles._BELOW_SECOND <= 22 and quantiles._BELOW_SECOND <= 22


def test_quantiles_among_values_that_differ_in_the_last_bits(spark):
    values = [1.0]
    for _ in range(4000):
        values.append(float(np.nextafter(values[-1], 2)))
    values += [-x for x in values[:1500]] + [7.0] * 3000 + [-0.0, 0.0, float("inf"), float("-inf"), 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ranks_wanted = {f"p{i}": i / (len(values) - 1) for i in (0, 1, 700, 1499, 1502, 3000, 5000, 6000, len(values) - 1)}
    got = quantiles.quantiles(df, [], "v", ranks_wanted).first()
    ordered = sorted(values)
    for name, p in ranks_wanted.items():
        place = (len(values) - 1) * p
        assert ordered[math.floor(place)] <= got[name] <= ordered[math.ceil(place)], name
    nothing = quantiles.quantiles(df.where("v is null"), [], "v", {"m": 0.5}).first()
    assert nothing.m is None and not nothing.n
    assert quantiles.quantiles(df.where("v is null").withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5}).count() == 0


def test_quantiles_of_several_columns(spark):
    rng = np.random.RandomState(9)
    a, b = rng.normal(size=900), rng.randint(0, 9, 900).astype(float)
    rows = [("gh"[i % 2], float(x), None if i < 400 else float(y)) for i, (x, y) in enumerate(zip(a, b))] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r.g: r for r in quantiles.quantiles_of(df, ["g"], {"a": {"a50": 0.5, "a9": 0.9}, "b": {"b50": 0.5}}).collect()}
    for g in "gh":
        x = [r[1] for r in rows if r[0] == g]
        y = [r[2] for r in rows if r[0] == g and r[2] is not None]
        assert (got[g].n, got[g].a50, got[g].a9, got[g].b50) == (
            450, pytest.approx(np.median(x)), pytest.approx(np.percentile(x, 90)), np.median(y))
    assert "none" not in got


def test_a_group_of_missing_keys_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", 5.0)], "g string, v double")
    got = {r.g: (r.n, r.m) for r in quantiles.quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: (2, 2.0), "g": (1, 5.0)}


def predictions(spark, actual, predicted, train=None):
    rows = [("r", i, "m", "test", float(a), float(p)) for i, (a, p) in enumerate(zip(actual, predicted))]
    rows += [("r", 10_000 + i, "m", "train", float(t), 0.0) for i, t in enumerate(train if train is not None else actual)]
    return spark.createDataFrame(
        rows, "repo string, issue_number long, model string, split string, actual_hours double, predicted_hours double")


def measured(spark, actual, predicted):
    return metrics.all_metrics(predictions(spark, actual, predicted), ["model"]).first()


def test_perfect_predictions(spark):
    m = measured(spark, [10, 20, 30, 40, 50], [10, 20, 30, 40, 50])
    assert (m.mae, m.mdae, m.mre, m.pred_25, m.pred_50, m.r2, m.sa) == (0, 0, 0, 100, 100, 1, 100)


def test_mean_predictor(spark):
    m = measured(spark, [10, 20, 30, 40, 50], [30] * 5)
    assert (m.mae, m.mae_p0, m.sa) == (pytest.approx(12), pytest.approx(16), pytest.approx(25))
    assert m.r2 == pytest.approx(0)


def test_known_errors(spark):
    assert measured(spark, [10, 20, 30], [12, 18, 25]).mae == pytest.approx(3)
    assert measured(spark, [100] * 4, [110, 130, 80, 50]).pred_25 == pytest.approx(50)
    assert measured(spark, [10, 20, 30], [50, 5, 60]).r2 < 0


def test_constant_targets_give_zeros(spark):
    m = measured(spark, [5, 5, 5], [6, 6, 6])
    assert (m.sa, m.mae_p0, m.std_p0, m.glass_delta, m.r2) == (0, 0, 0, 0, None)


def test_accuracy_over_mean(spark):
    df = predictions(spark, [10, 20, 30, 40, 50], [12, 18, 33, 44, 50], []).drop("split")
    expected = (1 - (2 + 2 + 3 + 4 + 0) / (20 + 10 + 0 + 10 + 20)) * 100
    assert metrics.accuracy_over_mean(df, ["model"]).first().sa_mean == pytest.approx(expected)
    assert metrics.accuracy_over_mean(df, []).first().sa_mean == pytest.approx(expected)


def test_report_covers_every_pair_and_skips_unequal_test_sets(spark):
    rng = np.random.RandomState(9)
    rows = []
    for i in range(120):
        a = float(rng.lognormal(3, 1))
        for k, m in enumerate("ABC"):
            if m == "C" and i >= 100:
                continue
            rows.append(("r", i, m, a, a + float(rng.normal(0, 5 + k))))
    df = spark.createDataFrame(rows, "repo string, issue_number long, model string, actual_hours double, predicted_hours double")
    report = comparison.comparison_report(df, ["A", "B", "C"]).collect()
    assert [(r.model_1, r.model_2, r.n) for r in report] == [("A", "B", 120)]
    same = comparison.comparison_report(df.where("issue_number < 100"), ["A", "B", "C"]).collect()
    assert sorted((r.model_1, r.model_2) for r in same) == list(combinations("ABC", 2))
    for r in same:
        e = {m: np.abs([a - p for _, i, k, a, p in rows if k == m and i < 100]) for m in "ABC"}
        x, y = e[r.model_1], e[r.model_2]
        assert r.cliffs_delta == pytest.approx(
            ((x[:, None] > y).sum() - (x[:, None] < y).sum()) / len(x) / len(y))
        assert r.better_model == (r.model_1 if x.mean() < y.mean() else r.model_2)
    assert comparison.comparison_report(df.where("model = 'A'"), ["A", "B"]).count() == 0


def test_the_normal_p_can_be_asked_for(spark):
    d = [1.0, -2.0, 3.0, 4.0, 5.0, -6.0, 7.0, 8.0]
    df = spark.createDataFrame([("g", max(x, 0.0), max(-x, 0.0)) for x in d], "g string, error_1 double, error_2 double")
    auto, normal = (comparison.wilcoxon(df, ["g"], m).first() for m in ("auto", "normal"))
    z = (8 - 8 * 9 / 4) / math.sqrt(8 * 9 * 17 / 24)
    assert normal.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert auto.p_value == pytest.approx(50 / 256)
    with pytest.raises(ValueError, match="unknown method"):
        comparison.wilcoxon(df, ["g"], "other")


def draw(seed, run, keys, n):
    return int(hashlib.md5("|".join([str(seed), str(run), *map(str, keys)]).encode()).hexdigest()[:13], 16) % n


@pytest.mark.parametrize("span", [1, 16, 1000])
def test_drawn_guesses_equal_plain_draws_and_lie_near_the_exact_value(spark, span):
    rng = random.Random(8)
    rows = [(m, i, rng.choice([1.0, 1.0, 1.0, 5.0, round(rng.expovariate(0.1), 2)]) if i % 9 else None, i % 4 == 0)
            for m in ("a", "b", None) for i in range(160)] + [("only test", 1, 2.0, True), ("only train", 1, 2.0, False)]
    df = spark.createDataFrame(rows, "model string, i long, v double, test boolean").repartition(3)
    got = {r.model: r for r in ranks.drawn_guess_error(df, ["model"], "v", F.col("test"), ["i"], 300, 5, span).collect()}
    exact = {r.model: r for r in ranks.random_guess_error(df, ["model"], "v", F.col("test")).collect()}
    assert set(got) == {"a", "b", None}
    for m, r in got.items():
        train = sorted(v for n, _, v, t in rows if n == m and not t and v is not None)
        tested = [(i, v) for n, i, v, t in rows if n == m and t and v is not None]
        runs = [sum(abs(v - train[draw(5, d, [i], len(train))]) for i, v in tested) / len(tested) for d in range(300)]
        assert (r.n_test, r.draws) == (len(tested), 300)
        assert r.mae_p0 == pytest.approx(statistics.mean(runs)) and r.std_p0 == pytest.approx(statistics.stdev(runs))
        assert abs(r.mae_p0 - exact[m].mae_p0) < 3 * exact[m].std_p0 / 300 ** 0.5


def test_rank_directory_holds_every_rank_once(spark):
    values = [3.0] * 50 + [1.0, 2.0, 2.0, None, 7.5] + [float(i % 13) for i in range(100)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(4)
    rows = ranks.rank_directory(df, ["g"], "v", 8).collect()
    ordered = sorted(v for v in values if v is not None)
    for rank, v in enumerate(ordered):
        [own] = [r for r in rows if r.part == rank // 8 and r.first <= rank <= r.last]
        assert own.v == v


def test_a_group_column_may_be_called_m(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, False), ("b", 2.0, True), ("b", 7.0, False)], "m string, v double, test boolean")
    got = {r.m: r.mae_p0 for r in ranks.random_guess_error(df, ["m"], "v", F.col("test")).collect()}
    assert got == {"a": 2.0, "b": 5.0}


def test_draws_are_spread_over_tasks_that_follow_their_number(spark, monkeypatch):
    rows = [("m", i, float(i % 17), i % 2 == 0) for i in range(80)] + [("m", None, 3.0, True), ("m", 80, None, True)]
    df = spark.createDataFrame(rows, "model string, i long, v double, test boolean").coalesce(1)

    def guessed():
        return ranks.drawn_guess_error(df, ["model"], "v", F.col("test"), ["i"], 50, 5).collect()

    plain, before = guessed(), spark.conf.get("spark.sql.shuffle.partitions")
    plans, kept = [], ranks.written
    monkeypatch.setattr(ranks, "written", lambda d, name: plans.append((name, d._jdf.queryExecution().toString())) or kept(d, name))
    monkeypatch.setattr(ranks, "DRAWS_PER_TASK", 100)
    again = guessed()
    # 41 test rows draw 50 times
    assert "RoundRobinPartitioning(21)" in dict(plans)["runs"] and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert [(r.n_test, r.draws) for r in again] == [(r.n_test, r.draws) for r in plain] == [(41, 50)]
    assert again[0].mae_p0 == pytest.approx(plain[0].mae_p0) and again[0].std_p0 == pytest.approx(plain[0].std_p0)
