"""Text features, vector distances and answers given as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacemark.operators import embeddings, estimates, text_features
from pacemark.plans import views
from pacemark.plans.registry import query, tidy
from pacemark.sources import standins
from pacemark.sources.readers import read_table
from pacemark.sources.schemas import KEY


def _features_sql(source: str, key: str, title: str, body: str, before: str = "") -> str:
    return f"WITH {before}{views.text_features('features', source, key, title, body)} SELECT * FROM features"


@query(_features_sql("pairs", "repo, issue_number", "issue_title", "issue_body", views.pairs() + ",\n"))
def pair_text_features(spark, sf_dir):
    rows = standins.pairs(spark, sf_dir)
    return tidy(text_features.derived_features(rows, KEY, F.col("issue_title"), F.col("issue_body")))


@query(_features_sql("documents", "doc_id", "source", "text"))
def document_text_features(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents")
    return tidy(text_features.derived_features(rows, ["doc_id"], F.col("source"), F.col("text")))


@query(_features_sql("pages", "page_id", "url", "html"))
def page_text_features(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages")
    return tidy(text_features.derived_features(rows, ["page_id"], F.col("url"), F.col("html")))


@query("""WITH x AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
s AS (
  SELECT vec_id, sum(v * m) AS dot, sqrt(sum(v * v)) AS len FROM x JOIN c USING (i) GROUP BY vec_id),
n AS (SELECT sqrt(sum(m * m)) AS len FROM c)
SELECT vec_id, round(1 - dot / CASE WHEN s.len * n.len = 0 THEN 1 ELSE s.len * n.len END, 6) AS complexity_score
FROM s, n""")
def complexity_score(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return tidy(embeddings.complexity_scores(vectors, "embedding").select("vec_id", "complexity_score"))


@query("""WITH x AS (
  SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i, CAST(label AS DOUBLE) AS y FROM embeddings),
r AS (SELECT i - 1 AS element, count(*) AS n, corr(v, y) AS r FROM x GROUP BY i)
SELECT CAST(element AS BIGINT) AS element, n, round(r * r / (1 - r * r) * (n - 2), 6) AS f_score FROM r""")
def topk_f_scores(spark, sf_dir):
    return tidy(embeddings.f_scores(read_table(spark, sf_dir, "embeddings"), "embedding", "label"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN NULL WHEN 'click' THEN 0e0
  ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS predicted_hours FROM events""")
def json_estimates(spark, sf_dir):
    kind, props = F.col("event_type"), F.col("props")
    # readable answers, answers that leave the hours out, broken ones and ones without a block
    answer = (F.when(kind == "signup", "no idea")
              .when(kind == "view", F.replace(props, F.lit(":"), F.lit("")))
              .when(kind == "click", F.replace(props, F.lit('"k"'), F.lit('"other"')))
              .otherwise(F.concat(F.lit("My estimate: "), props, F.lit(" as asked."))))
    rows = read_table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return tidy(estimates.parsed_answers(rows, hours_key="k").select("event_id", "predicted_hours"))
