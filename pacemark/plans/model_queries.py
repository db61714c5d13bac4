"""Vector reduction, training, sweeps, importance, scoring and the stream jobs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.operators import embeddings, learning, scoring, sensitivity, splits
from pacemark.operators.unions import stacked
from pacemark.plans import views
from pacemark.plans.registry import query, tidy
from pacemark.session import new_table_path, written
from pacemark.sources import standins
from pacemark.sources.readers import read_table
from pacemark.sources.schemas import KEY
from pacemark.streaming import estimate as stream_estimate
from pacemark.streaming import ingest

#: The search of the registered queries: ten settings in five folds, 10 to 20 trees, where the operator's own budget is 50
#: settings of 100 to 1000 trees. Importance, attribution and scoring take the models that ``train_eval_abc`` finds.
_BUDGET = learning.Budget(trials=10, trees=(10, 20), depth=(3, 5))
#: Sweeps compare many data sets in five folds each, searched with two settings of ten trees.
_SWEEP = learning.Budget(trials=2, trees=(10, 10), depth=(3, 4))
_MAX_DAYS = 2500


def _vectors(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"))
    marked = rows.withColumn("split", splits.holdout(F.lit("vec"), F.col("vec_id")))
    return embeddings.with_vector(marked).withColumn("log_y", F.log1p("y"))


def _long_scores(df, column):
    return df.select("vec_id", F.posexplode(vector_to_array(column)).alias("component", "score"))


_VECTORS_SQL = f"""x AS (
  SELECT vec_id, CAST(label AS DOUBLE) AS y, {views.holdout("'vec'", 'vec_id')} AS split,
    unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS component FROM embeddings),
fit AS (
  SELECT component, avg(v) AS m, stddev_pop(v) AS s, corr(v, y) AS r, corr(v, ln(1 + y)) AS log_r
  FROM x WHERE split = 'train' GROUP BY component)"""


@query(f"""WITH {_VECTORS_SQL}
SELECT vec_id, component, round((v - m) / s, 5) + 0e0 AS score FROM x JOIN fit USING (component)""")
def scaled_vectors(spark, sf_dir):
    """Every vector scaled by what the train vectors say."""
    rows = _vectors(spark, sf_dir)
    scaler = embeddings.population_scaler(rows.where("split = 'train'"), "embedding_vector", "scaled")
    return tidy(_long_scores(scaler.transform(rows), "scaled"), 5)


@query(f"""WITH {_VECTORS_SQL}
SELECT component FROM fit ORDER BY r * r DESC, component LIMIT 20""")
def topk_elements(spark, sf_dir):
    """The vector elements that depend most on the target."""
    rows = _vectors(spark, sf_dir)
    chosen = embeddings.top_elements(
        embeddings.correlations(rows.where("split = 'train'"), "embedding_vector", "y"), 20)
    return spark.createDataFrame([(i,) for i in chosen], "component long")


@query(f"""WITH {_VECTORS_SQL}, w AS (SELECT component, m, s, log_r / sqrt(sum(log_r * log_r) OVER ()) AS w FROM fit),
n AS (SELECT count(DISTINCT vec_id) AS n FROM x WHERE split = 'train')
SELECT vec_id, CAST(0 AS BIGINT) AS component, round(sum((v - m) / s * w) * sqrt((n - 1) / n), 5) + 0e0 AS score
FROM x JOIN w USING (component), n GROUP BY vec_id, n""")
def pls_first_scores(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = embeddings.fit_reducer(rows.where("split = 'train'"), "pls", 1, "y", "log_y")
    return tidy(_long_scores(model.transform(rows), "reduced"), 5)


@query()
def pls_scores(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = embeddings.fit_reducer(rows.where("split = 'train'"), "pls", 10, "y", "log_y")
    return tidy(_long_scores(model.transform(rows), "reduced"), 5)


@query()
def pca_scores(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = embeddings.fit_reducer(rows.where("split = 'train'"), "pca", 10, "y", "log_y")
    return tidy(_long_scores(model.transform(rows), "reduced"), 5)


@query(f"""WITH x AS (
  SELECT abs(unnest(embedding)::DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT 'emb_' || i AS feature, round(avg(v), 6) AS mean_abs FROM x GROUP BY i""")
def mean_attribution(spark, sf_dir):
    names = [f"emb_{i}" for i in range(64)]
    return tidy(learning.mean_attribution(read_table(spark, sf_dir, "embeddings"), "embedding", names))


def _training_rows(spark, sf_dir):
    rows = learning.training_rows(standins.feature_table(spark, sf_dir), max_days=_MAX_DAYS)
    # vectors are stored as they are given, which is half of what they take as doubles
    return embeddings.with_vector(written(rows, "training_rows"))


_runs: dict[tuple[str, str], tuple] = {}


def _trained(spark, sf_dir):
    """Training rows and the three models of a folder, fitted once in a session."""
    run = (spark.sparkContext.applicationId, sf_dir)
    if run not in _runs:
        rows = _training_rows(spark, sf_dir)
        _runs[run] = rows, learning.train_all(rows, budget=_BUDGET)
    return _runs[run]


@query()
def train_eval_abc(spark, sf_dir):
    """Text, history and both: test metrics of the three models, each the best of ten settings in five folds."""
    return tidy(learning.evaluate(_trained(spark, sf_dir)[1]))


@query()
def hyperparameter_search(spark, sf_dir):
    """The ten settings that were tried for each model and their cross-validated error on the log target."""
    tried = [(name, i, t["trees"], t["depth"], t["rate"], t["row_share"], t["column_share"], t["l1"], t["l2"],
              t["least_rows"], float(t["log_mae"]))
             for name, model in _trained(spark, sf_dir)[1].items() for i, t in enumerate(model.scores)]
    return tidy(spark.createDataFrame(
        tried, "model string, trial long, trees long, depth long, rate double, row_share double, column_share double, l1 double, "
               "l2 double, least_rows long, log_mae double"))


@query()
def reducer_sweep(spark, sf_dir):
    settings = [(method, k) for method in ("pca", "pls", "topk") for k in (20, 50)] + [("none", None)]
    return tidy(learning.sweep(_training_rows(spark, sf_dir), settings, fv.TEXT_FEATURES, _SWEEP))


@query()
def encoder_sweep(spark, sf_dir):
    """The given vectors against hashed word vectors of the same texts."""
    rows = _training_rows(spark, sf_dir)
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = embeddings.hashed_text_vectors(documents, "text", 64)
    hashed = encoder.transform(documents).select("doc_id", F.col("embedding_vector").alias("hashed"))
    n = documents.agg(F.count("*").alias("n")).scalar()
    other = (rows.withColumn("doc_id", F.col("issue_number") % n).join(hashed, "doc_id")
             .drop("doc_id", "embedding_vector").withColumnRenamed("hashed", "embedding_vector"))
    both = (rows.withColumn("encoder", F.lit("given"))
            .unionByName(other.withColumn("encoder", F.lit("hashed"))))
    return tidy(learning.encoder_sweep(both, ["given", "hashed"], fv.TEXT_FEATURES, k=20, budget=_SWEEP))


@query()
def sensitivity_trained(spark, sf_dir):
    """Models trained anew under four caps and without one, compared under each; the whole search of ``learning.Budget``."""
    features = written(standins.feature_table(spark, sf_dir), "features")
    return tidy(sensitivity.trained_sensitivity(embeddings.with_vector(features), [60, 75, 90, 105, None], k=10))


@query()
def feature_importance(spark, sf_dir):
    """The share of each history feature in the gain of model B."""
    return tidy(learning.feature_importance(_trained(spark, sf_dir)[1]["B"]))


@query()
def permutation_importance(spark, sf_dir):
    """How much the error of model B grows when one feature is shuffled."""
    rows, trained = _trained(spark, sf_dir)
    return tidy(learning.permutation_importance(trained["B"], rows))


@query()
def tree_attribution(spark, sf_dir):
    """Mean absolute attribution of each feature over the test rows, for each model."""
    rows, trained = _trained(spark, sf_dir)
    tested = rows.where("split = 'test'")
    return tidy(stacked(*[
        learning.mean_attribution(learning.attributed(t, tested), "attribution", t.feature_names).withColumn("model", F.lit(name))
        for name, t in trained.items()]))


@query()
def attribution_rows(spark, sf_dir):
    """What each of the test rows' estimates by model B is made of: expected log hours plus one part per feature."""
    rows, trained = _trained(spark, sf_dir)
    parts = learning.attributed(trained["B"], rows.where("split = 'test'"))
    names = trained["B"].feature_names
    return tidy(parts.select(*KEY, "prediction", "expected", *[F.get("attribution", i).alias(n) for i, n in enumerate(names)]))


@query()
def batch_score(spark, sf_dir):
    """Estimates of saved models for all pairs; model C was never saved."""
    rows, trained = _trained(spark, sf_dir)
    folder = new_table_path(spark, "models")
    scoring.save_bundles([trained["A"], trained["B"]], folder)
    known = scoring.without_history(rows.withColumn("has_history", F.col("total_churn_commits") > 0))
    return tidy(scoring.estimate_all(known, scoring.Bundles(spark, folder)))


_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE_ORDER)}) AS place
  FROM lineitem) WHERE place = 1""")
def stream_ingest(spark, sf_dir):
    """All lines arrive in three deliveries, each a micro-batch; each key is kept once.

    Later deliveries bring the lines of the one before again, with another quantity; the held ones stay.
    """
    lines = read_table(spark, sf_dir, "lineitem").select(*_LINE_KEY, *_LINE_ORDER)
    kind = dict(lines.dtypes)["l_quantity"]
    delivery = F.pmod(F.col("l_orderkey"), F.lit(3))
    inbox, target = new_table_path(spark, "arriving"), new_table_path(spark, "ingested")
    for i in range(3):
        again = lines.where(delivery == i - 1).withColumn("l_quantity", (F.col("l_quantity") + 1).cast(kind))
        stacked(lines.where(delivery == i), again).write.mode("append").parquet(inbox)
        ingest.start_ingest(ingest.read_arrivals(spark, inbox, lines.schema), target, f"{target}-checkpoint",
                            _LINE_KEY, _LINE_ORDER).awaitTermination()
    return tidy(spark.read.parquet(target).drop("key_part", "ingest_batch", "l_shipdate"))


@query()
def stream_score(spark, sf_dir):
    """Feature rows arrive as a stream and get the estimate of a trained model."""
    rows, models = _trained(spark, sf_dir)
    trained = models["B"]
    inbox = new_table_path(spark, "arriving")
    rows.select(*KEY, *fv.HISTORY_FEATURES).write.parquet(inbox)
    arrivals = ingest.read_arrivals(spark, inbox, spark.read.parquet(inbox).schema)
    target = new_table_path(spark, "estimates")
    stream_estimate.start_estimates(arrivals, trained.model, fv.HISTORY_FEATURES, "B", target,
                                    f"{target}-checkpoint").awaitTermination()
    return tidy(spark.read.parquet(target))
