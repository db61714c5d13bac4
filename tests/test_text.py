"""Text functions against Python's own text functions."""

import random
import re

from pyspark.sql import functions as F

from pacemark.functions import text
from pacemark.operators.text_features import derived_features


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_cross_references(spark):
    assert one(spark, "Relates to #31 and #45, thread on https://forum.test/t with @dev", text.cross_reference_count) == 4
    assert one(spark, "Align the icons of the footer", text.cross_reference_count) == 0
    assert one(spark, "AB-12 closes #7, mail @é", text.cross_reference_count) == 3


def features(spark, title, body):
    df = spark.createDataFrame([(1, title, body)], "id long, title string, body string")
    return derived_features(df, ["id"], F.col("title"), F.col("body")).first()


def test_vague_text_is_more_ambiguous(spark):
    vague = features(spark, "Maybe something", "might be various stuff and things, possibly some problem")
    clear = features(spark, "Fix null check", "The parser crashes on empty input in module alpha")
    assert vague.ambiguity_index > clear.ambiguity_index == 0


def test_scope_counts_domains(spark):
    row = features(spark, "", "the server handler is slow, so add a database index and a unit test")
    assert row.technical_scope == 3


def test_length_and_words_of_joined_text(spark):
    row = features(spark, "A title", None)
    assert (row.text_length, row.word_count) == (len("A title "), 2)
    assert features(spark, None, None).word_count == 0


def test_more_texts_can_be_joined(spark):
    df = spark.createDataFrame([("a", None, "c", "d")], "t string, b string, pt string, pb string")
    joined = text.requirement_text(F.col("t"), F.col("b"), F.col("pt"), F.col("pb"))
    assert df.select(joined.alias("x")).first().x == "a  c d"


def test_every_kind_of_white_space(spark):
    codes = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [0xFEFF]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c long, t string")
    got = df.select("c", text.word_count(F.col("t")).alias("n"),
                    text.words_in(text.lower_words(F.col("t"))).alias("m")).collect()
    assert all(r.n == r.m == len(f"a{chr(r.c)}b".split()) for r in got)


def test_random_texts(spark):
    rng = random.Random(5)
    alphabet = ["a", "B", "#", "1", " ", "\n", "\r", " ", "@", "é", "https://x", "-", "Z", "\x1c", "_"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    t = F.col("t")
    patterns = (r"#\d+", r"https?://\S+", r"[A-Z]+-\d+", r"@\w+")
    for r in df.select("t", text.word_count(t).alias("n"), text.cross_reference_count(t).alias("refs"),
                       text.strip(t).alias("s"), text.is_blank(t).alias("blank"),
                       text.short_text(t, 10).alias("short")).collect():
        assert r.n == len(r.t.split())
        assert r.refs == sum(len(re.findall(p, r.t)) for p in patterns)
        assert (r.s, r.blank) == (r.t.strip(), not r.t.strip())
        tidy = r.t.replace("\r", "").replace("\n\n", "\n").strip()
        assert r.short == (tidy if len(tidy) <= 10 else tidy[:10].rstrip() + "...")
