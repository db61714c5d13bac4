"""Registered queries of the operators in this package, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.llm import (collocations, decontamination, exact_dedup, max_sketch, minhash, packing, pii, pseudo_likelihood,
                          quality_classifier, secret_scan, separators, tool_calls, toxicity)
from pacemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, with the session settings it depends on."""

    def register(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return plan(spark, sf_dir)

        QUERIES[plan.__name__] = run
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all documents, dropped ones included."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM worded WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component AS component_id, d.doc_id = c.component AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a) c USING (doc_id)""")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 85 % of their shingles."""
    return minhash.near_groups(table(spark, sf_dir, "documents"), threshold=(85, 100))


@query()
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with the item and the best window."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                         "n_toxic", "offending")


@query()
def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids, filled with lexical neighbours."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found in flat token streams of all documents, with their token counts."""
    return separators.document_token_counts(table(spark, sf_dir, "documents"))


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query()
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


@query()
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed conditional log-probabilities of the words of all documents."""
    return pseudo_likelihood.likelihoods(table(spark, sf_dir, "documents"))


@query()
def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results that the turns of all conversations stand for, linked, ordered and checked."""
    calls, results = tool_calls.calls_of_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.standin_schemas(spark))


@query("""
WITH terms AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM terms GROUP BY doc_id),
total AS (SELECT count(*) AS dn, CAST(sum(n) AS BIGINT) AS dl FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * dn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM terms, total GROUP BY term, dn),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * dn) // dl)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN terms USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return max_sketch.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)),
begins AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
phrases AS (SELECT lang, ws, i, unnest(range(1, 6)) AS k FROM begins),
counts AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM phrases WHERE i + k - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 100),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' ') AS phrase, f FROM (
      SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM often WHERE k > 2)))
  GROUP BY ALL),
own AS (
  SELECT o.lang, o.k, o.phrase, o.f AS a FROM often o LEFT JOIN longer USING (lang, phrase)
  WHERE o.k > 1 AND (longer.f IS NULL OR 100 * longer.f < 100 * o.f)),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM own)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, n,
         CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = head JOIN often y ON y.lang = c.lang AND y.phrase = tail
  JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE nth = 1)
WHERE rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
