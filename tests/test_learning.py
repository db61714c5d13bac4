"""Vector reduction against numpy; training, scoring and importance end to end."""

import json
import math

import numpy as np
import pytest
from conftest import rows_of
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.operators import embeddings, learning, scoring, sensitivity
from pacemark.streaming import estimate as stream_estimate
from pacemark.streaming import ingest

BUDGET = learning.Budget(trials=3, folds=2, trees=(15, 15), depth=(2, 4))


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.RandomState(0)
    x = rng.normal(0, 1, (120, 6)) @ rng.normal(0, 1, (6, 6))
    y = np.abs(x @ np.array([3, -2, 1, 0, 0, 0.5]) + rng.normal(0, 0.3, 120)) + 1
    return x, y


@pytest.fixture(scope="module")
def vectors(spark, numbers):
    x, y = numbers
    rows = [("r", i, x[i].tolist(), float(y[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "repo string, issue_number long, embedding array<double>, duration_hours double")
    return embeddings.with_vector(df).withColumns({"hours": F.col("duration_hours"), "log_hours": F.log1p("duration_hours")})


def reduced(model, df):
    rows = model.transform(df).select("issue_number", vector_to_array("reduced").alias("a")).orderBy("issue_number")
    return np.array([r.a for r in rows.collect()])


def standard(x):
    return (x - x.mean(0)) / x.std(0)


def test_pca_scores_match_up_to_sign(vectors, numbers):
    z = standard(numbers[0])
    _, _, v = np.linalg.svd(z, full_matrices=False)
    got = reduced(embeddings.fit_reducer(vectors, "pca", 3, "hours", "log_hours"), vectors)
    assert np.allclose(np.abs(got), np.abs(z @ v[:3].T))


def test_top_elements_by_f(vectors, numbers):
    x, y = numbers
    r2 = np.array([np.corrcoef(x[:, j], y)[0, 1] ** 2 for j in range(6)])
    best = sorted(np.argsort(-r2)[:2])
    got = reduced(embeddings.fit_reducer(vectors, "topk", 2, "hours", "log_hours"), vectors)
    assert np.allclose(got, standard(x)[:, best])
    f = {r.element: r.f_score for r in embeddings.f_scores(vectors, "embedding", "hours").collect()}
    assert [f[j] for j in range(6)] == pytest.approx(list(r2 / (1 - r2) * 118))


def pls_scores(x, y, k):
    """Textbook deflation, on rows."""
    left, target, scores = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1), []
    for _ in range(k):
        w = left.T @ target
        w /= np.linalg.norm(w)
        t = left @ w
        scores.append(t)
        left = left - np.outer(t, left.T @ t / (t @ t))
        target = target - t * (target @ t / (t @ t))
    return np.array(scores).T


def test_pls_scores_match_row_deflation(vectors, numbers):
    x, y = numbers
    got = reduced(embeddings.fit_reducer(vectors, "pls", 4, "hours", "log_hours"), vectors)
    assert np.allclose(got, pls_scores(x, np.log1p(y), 4), atol=1e-8)


def test_scaler_learns_from_train_rows_only(vectors, numbers):
    x, _ = numbers
    model = embeddings.population_scaler(vectors.where("issue_number < 100"), "embedding_vector", "reduced")
    got = reduced(model, vectors)
    assert np.allclose(got, (x - x[:100].mean(0)) / x[:100].std(0))
    assert np.allclose(got[:100].mean(0), 0) and not np.allclose(got.mean(0), 0, atol=1e-6)


def test_component_count():
    assert embeddings.component_count(1000, 768) == 50
    assert embeddings.component_count(100, 768) == 20
    assert embeddings.component_count(1000, 30) == 30


def test_unknown_method(vectors):
    with pytest.raises(ValueError, match="unknown method"):
        embeddings.fit_reducer(vectors, "other", 1, "hours", "log_hours")


def test_complexity_against_a_given_center(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    center = spark.createDataFrame([([1.0, 0.0],)], "centroid array<double>")
    got = dict(rows_of(embeddings.complexity_scores(df, "v", center), "id", "complexity_score"))
    assert (got[1], got[2], got[3]) == (0.0, 1.0, pytest.approx(1 - 2 ** -0.5))
    alone = embeddings.complexity_scores(df.where("id = 3"), "v").first()
    assert alone.complexity_score == pytest.approx(0)


def test_attribution_means(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([-3.0, 0.0],)], "a array<double>")
    assert [tuple(r) for r in learning.mean_attribution(df, "a", ["x", "y"]).collect()] == [("x", 2.0), ("y", 1.0)]


def test_search_space_stays_in_its_ranges():
    drawn = learning.search_space(learning.Budget(trials=40))
    assert drawn == learning.search_space(learning.Budget(trials=40))
    assert all(100 <= d.trees <= 1000 and 3 <= d.depth <= 10 and 0.01 <= d.rate <= 0.3 and 0.6 <= d.row_share <= 1
               and 0.5 <= d.column_share <= 1 and 1e-3 <= d.l1 <= 10 and 1e-3 <= d.l2 <= 10 and 1 <= d.least_rows <= 10 for d in drawn)


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(300):
        text, past = rng.rand(len(fv.TEXT_FEATURES)), rng.rand(len(fv.HISTORY_FEATURES)) * 10
        hours = float(np.exp(1 + 3 * text[0] + 0.2 * past[0] + rng.normal(0, 0.1)))
        rows.append(("r", i, hours, rng.normal(0, 1, 4).tolist(), *text.tolist(), *past.tolist()))
    names = ["repo string", "issue_number long", "duration_hours double", "embedding array<double>"]
    names += [f"{c} double" for c in fv.TEXT_FEATURES + fv.HISTORY_FEATURES]
    return embeddings.with_vector(spark.createDataFrame(rows, ", ".join(names)))


@pytest.fixture(scope="module")
def training(features):
    return learning.training_rows(features)


@pytest.fixture(scope="module")
def trained(training):
    return learning.train_all(training, k=2, budget=BUDGET)


def test_every_row_is_predicted_once_by_a_model_that_did_not_see_it(trained, training):
    assert sorted(trained) == ["A", "B", "C"]
    for t in trained.values():
        assert rows_of(t.predictions, "repo", "issue_number") == rows_of(training, "repo", "issue_number")
        assert t.predictions.where("predicted_hours < 0").count() == 0
    assert trained["A"].feature_names == ["pca_0", "pca_1", *fv.TEXT_FEATURES]
    assert trained["C"].feature_names[2:] == fv.TEXT_FEATURES + fv.HISTORY_FEATURES


def test_evaluation(trained):
    got = {r.model: r for r in learning.evaluate(trained).collect()}
    assert set(got) == {"A", "B", "C"} and all(r.sa > 0 and r.mae > 0 for r in got.values())


def test_models_are_trained_anew_under_every_cap(features):
    budget = learning.Budget(trials=1, folds=2, trees=(2, 2), depth=(2, 3))
    table = sensitivity.trained_sensitivity(features, [0, 4, None], k=2, budget=budget).collect()
    assert sorted(r.threshold for r in table) == ["4d", "no cap"]
    by = {r.threshold: r for r in table}
    assert by["no cap"].n_samples == 300 > by["4d"].n_samples >= 50
    assert all(r.a_vs_c_sig in ("YES", "no", "err") and r.c_mae > 0 for r in table)


def test_text_only_without_history(training):
    assert list(learning.variants(with_history=False)) == ["A"]


def test_importance_finds_the_feature_that_matters(trained, training):
    assert learning.feature_importance(trained["B"]).first().feature == "num_files"
    shuffled = learning.permutation_importance(trained["B"], training, rows_per_slot=20)
    assert shuffled.count() == len(fv.HISTORY_FEATURES) and shuffled.first().feature == "num_files"


def test_shuffled_errors_equal_scoring_row_by_row(spark, trained):
    forest = trained["B"].forest
    rng = np.random.default_rng(3)
    own, other = rng.uniform(0, 60, (2, 40, forest.width))
    hours = [None if i == 7 else float(i) for i in range(40)]
    cases = spark.createDataFrame([(h, a.tolist(), b.tolist()) for h, a, b in zip(hours, own, other)],
                                  "hours double, own array<double>, other array<double>").repartition(3)
    got = dict(rows_of(learning._shuffled_errors(cases.where("hours is not null"), forest), "i", "mae"))
    assert set(got) == set(range(-1, forest.width))
    for i, mae in got.items():
        x = own.copy()
        if i >= 0:
            x[:, i] = other[:, i]
        wanted = [abs(h - max(math.expm1(p), 0)) for h, p in zip(hours, forest.predict(x)) if h is not None]
        assert mae == pytest.approx(sum(wanted) / len(wanted))
    assert rows_of(learning._shuffled_errors(cases.limit(0), forest)) == []


def test_the_best_setting_wins_and_folds_are_not_seen(trained, training):
    t = trained["B"]
    assert len(t.scores) == 3
    best = min(t.scores, key=lambda x: x["log_mae"])
    assert {k: v for k, v in best.items() if k != "log_mae"} == t.params
    train = t.predictions.where("split = 'train'").select(F.abs(F.log1p("predicted_hours") - F.log1p("actual_hours")).alias("e"))
    # hours are never negative, so the two errors agree where no estimate was cut off
    assert train.toPandas()["e"].mean() == pytest.approx(best["log_mae"], rel=0.02)


def test_a_sweep_grows_what_single_runs_grow(training):
    settings, budget = [("pca", 2), ("topk", 1), ("none", None)], learning.Budget(trials=1, folds=2, trees=(3, 3), depth=(2, 3))
    together = {r.setting: r.mae for r in learning.sweep(training, settings, fv.TEXT_FEATURES, budget).collect()}
    assert set(together) == {"PCA-2", "TOPK-1", "NONE"}
    # without a draw of columns the columns of other variants change nothing
    alone = learning.train_variant(training, "x", fv.TEXT_FEATURES, "none", None, budget)
    assert learning.evaluate({"x": alone}).first().mae == pytest.approx(together["NONE"], rel=0.05)


def test_attributions_of_a_model_add_up(trained, training):
    tested = training.where("split = 'test'")
    for t in trained.values():
        got = learning.attributed(t, tested)
        assert got.count() == tested.count()
        hours = dict(rows_of(t.predictions.where("split = 'test'"), "issue_number", "predicted_hours"))
        for r in got.collect():
            assert len(r.attribution) == len(t.feature_names) and sum(r.attribution) == pytest.approx(r.prediction - r.expected)
            assert hours[r.issue_number] == pytest.approx(max(np.expm1(r.prediction), 0))
        means = learning.mean_attribution(got, "attribution", t.feature_names).collect()
        assert [r.feature for r in means][0] in ("num_files", "complexity_score", "text_length", *fv.TEXT_FEATURES)


def test_saved_models_score_the_same(spark, trained, training, tmp_path):
    for name in ("A", "B"):
        scoring.save_bundle(trained[name], str(tmp_path))
    bundles = scoring.Bundles(spark, str(tmp_path))
    assert bundles.available("A") and not bundles.available("C") and bundles.about("C") is None
    about = {r.split: r for r in bundles.about("B").collect()}
    assert about["test"].feature_names == trained["B"].feature_names and json.loads(about["test"].params)["trees"] == 15
    assert about["train"].n + about["test"].n == training.count() and about["train"].mae > 0
    out = {(r.model, r.issue_number): r for r in scoring.estimate_all(training, bundles).collect()}
    assert out["C", 0].hours is None and out["C", 0].error == "Model not trained yet"
    test_rows = trained["B"].predictions.where("split = 'test'").collect()
    for r in test_rows:
        assert out["B", r.issue_number].hours == pytest.approx(r.predicted_hours)
        assert out["B", r.issue_number].effort_tier in ("Trivial", "Small", "Medium", "Large", "XL")


def test_metrics_of_saved_models_are_made_together(spark, trained, training, tmp_path, monkeypatch):
    made, metrics = [], learning.split_metrics
    monkeypatch.setattr(learning, "split_metrics", lambda t: made.append(list(t)) or metrics(t))
    paths = scoring.save_bundles([trained["A"], trained["B"]], str(tmp_path))
    assert made == [["A", "B"]] and paths == [f"{tmp_path}/model_a", f"{tmp_path}/model_b"]
    for name in ("A", "B"):
        about = scoring.Bundles(spark, str(tmp_path)).about(name).collect()
        assert {(r.model, r.split) for r in about} == {(name, "train"), (name, "test")}
        assert {r.split: r.mae for r in about} == pytest.approx(dict(rows_of(metrics({name: trained[name]}), "split", "mae")))
        assert all(r.feature_names == trained[name].feature_names for r in about)


def test_a_saved_projection_comes_back(spark, vectors, tmp_path):
    model = embeddings.fit_reducer(vectors, "pls", 2, "hours", "log_hours")
    model.stages[1].write().overwrite().save(str(tmp_path / "projection"))
    back = embeddings.Projection.load(str(tmp_path / "projection"))
    scaled = model.stages[0].transform(vectors)
    assert rows_of(back.transform(scaled), "reduced") == rows_of(model.stages[1].transform(scaled), "reduced")


def test_alignment_fills_and_reorders(spark):
    df = spark.createDataFrame([("r", 1, 5, None)], "repo string, issue_number long, b long, a double")
    out = learning.aligned(df, ["a", "missing", "b"])
    assert out.columns[-3:] == ["a", "missing", "b"] and tuple(out.first())[-3:] == (0.0, 0.0, 5.0)


def test_rows_without_history_keep_the_number_of_files(training):
    df = scoring.without_history(training.withColumn("has_history", F.col("issue_number") > 0))
    zero, known = (df.where(f"issue_number = {i}").first() for i in (0, 1))
    assert zero.fan_in == 0 and zero.num_files > 0 and not zero.used_real_features
    assert known.fan_in > 0 and known.used_real_features


def test_new_rows_are_scored_from_title_body_and_files(spark, trained):
    new = spark.createDataFrame(
        [("r", 1, "Add api", "must be fast", "a.py|b.py", "2024-03-01"), ("new", 2, "Fix", None, "c.py", "2024-03-02")],
        "repo string, issue_number long, issue_title string, issue_body string, pr_files_changed string, at string")
    new = new.withColumn("issue_created_at", F.to_timestamp("at"))
    commits = spark.createDataFrame(
        [("r", "c1", "a.py", 5, 1, "2024-02-01"), ("r", "c1", "x.py", 2, 0, "2024-02-01"), ("r", "c2", "a.py", 1, 1, "2023-01-01")],
        "repo string, commit_id string, path string, added long, deleted long, at string")
    commits = commits.withColumn("committed_at", F.to_timestamp("at"))
    vectors = spark.createDataFrame([("r", 1, [1.0, 0.0, 0.0, 0.0]), ("new", 2, [0.0, 1.0, 0.0, 0.0])],
                                    "repo string, issue_number long, embedding array<double>")
    center = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],)], "centroid array<double>")
    rows = scoring.raw_features(new, vectors, center, commits)
    old, fresh = (rows.where(f"issue_number = {i}").first() for i in (1, 2))
    assert (old.total_churn_added, old.total_churn_commits, old.complexity_score, old.word_count) == (5, 1, 0.0, 5)
    assert (fresh.total_churn_added, fresh.complexity_score, fresh.used_real_features) == (0, 1.0, False)
    assert (old.num_files, fresh.num_files) == (2, 1)
    out = scoring.estimate(rows, trained["C"].model, fv.TEXT_FEATURES + fv.HISTORY_FEATURES, "C").collect()
    assert len(out) == 2 and all(r.hours >= 0 for r in out)


def test_stream_scores_like_the_batch(spark, trained, training, tmp_path):
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("inbox", "target", "checkpoint"))
    training.select("repo", "issue_number", *fv.HISTORY_FEATURES).repartition(3).write.parquet(inbox)
    arrivals = ingest.read_arrivals(spark, inbox, spark.read.parquet(inbox).schema, max_files=1)
    stream_estimate.start_estimates(arrivals, trained["B"].model, fv.HISTORY_FEATURES, "B", target, checkpoint).awaitTermination()
    batch = scoring.estimate(training, trained["B"].model, fv.HISTORY_FEATURES, "B")
    assert rows_of(spark.read.parquet(target), "issue_number", "hours") == rows_of(batch, "issue_number", "hours")


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "c")], "id long, t string")
    out = embeddings.hashed_text_vectors(df, "t", 16).transform(df)
    assert all(len(r.embedding_vector) == 16 for r in out.collect())
