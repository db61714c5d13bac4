"""Durations, buckets, parsing and verdicts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pacemark import fixed_values as fv
from pacemark.functions import durations, parsing, verdicts


def values(spark, numbers, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i long, x double")
    return [tuple(r)[1:] for r in df.select("i", *[c(F.col("x")) for c in columns]).orderBy("i").collect()]


def test_duration_bounds_are_inclusive(spark):
    kept = values(spark, [0.9, 1.0, 36.0, 700.0, 2160.0, 2160.5, 9000.0, None], durations.in_bounds)
    assert [k for (k,) in kept] == [False, True, True, True, True, False, False, False]
    assert values(spark, [5000.0], lambda x: durations.in_bounds(x, max_days=None)) == [(True,)]


def test_log_round_trip_and_clip(spark):
    hours = [0.25, 3.0, 42.0, 777.0, 2000.0]
    back = values(spark, hours, lambda x: durations.hours_from_log(durations.log_target(x)))
    assert [b for (b,) in back] == pytest.approx(hours, rel=1e-10)
    clipped = values(spark, [-1.0, -0.5, 0.0, 1.0], durations.hours_from_log)
    assert [c for (c,) in clipped] == pytest.approx([0.0, 0.0, 0.0, math.e - 1])


def test_buckets(spark):
    got = values(spark, [0.0, 7.99, 8.0, 72.0, 719.9, 720.0, 2160.0, -1.0, float("nan")],
                 durations.prediction_bucket, durations.quality_bucket)
    assert got == [("< 1 day", "< 1 day"), ("< 1 day", "< 1 day"), ("1 day", "1 day"), ("3-7 days", "3-7 days"),
                   ("1-4 weeks", "1-4 weeks"), ("> 4 weeks", "4-12 weeks"), ("> 4 weeks", "> 12 weeks"),
                   ("> 4 weeks", None), ("> 4 weeks", None)]


def test_tiers(spark):
    got = values(spark, [0.5, 1.0, 4.0, 16.0, 40.0, None], durations.effort_tier)
    assert [t for (t,) in got] == ["Trivial", "Small", "Medium", "Large", "XL", None]


def test_readable_hours_round_like_python(spark):
    rng = random.Random(3)
    hours = [0.5, 0.999, 1.25, 2.35, 23.95, 36.65, 36.0, 335.9, 336.0, 2.5, 1.05, 400.25]
    hours += [round(rng.uniform(1, 600), rng.choice([1, 2, 3, 9])) for _ in range(2000)]

    def expected(h):
        if h < 1:
            return f"{int(h * 60)} min"
        if h < 24:
            return f"{h:.1f}h"
        return f"{h / 24:.1f}d" if h / 24 < 14 else f"{h / 24 / 7:.1f}w"

    assert [r for (r,) in values(spark, hours, durations.readable_hours)] == [expected(h) for h in hours]
    months = values(spark, [24 * 7 * 9.0, 24 * 30.44 * 4], lambda x: durations.readable_hours(x, months=True))
    assert months == [("9.0w",), ("4.0mo",)]


def test_duration_falls_back_to_creation(spark):
    df = spark.sql("""SELECT timestamp'2025-01-01' c, cast(null as timestamp) a, timestamp'2025-01-03' m
                      UNION ALL SELECT timestamp'2025-01-01', timestamp'2025-01-02', timestamp'2025-01-03'
                      UNION ALL SELECT timestamp'2025-01-01', null, null""")
    got = df.select(durations.duration_hours(F.col("c"), F.col("a"), F.col("m")).alias("h")).collect()
    assert sorted((r.h for r in got), key=str) == [24.0, 48.0, None]


def test_relative_error_of_zero_hours(spark):
    got = values(spark, [0.0], lambda x: durations.relative_error(x, F.lit(1.0)))
    assert got == [(pytest.approx(1e6),)]


def test_age_is_never_negative(spark):
    df = spark.sql("select timestamp'2025-01-11' c, timestamp'2025-01-01' f, timestamp'2025-02-01' g")
    row = df.select(durations.age_days(F.col("f"), F.col("c")).alias("a"),
                    durations.age_days(F.col("g"), F.col("c")).alias("b"),
                    durations.age_days(F.lit(None).cast("timestamp"), F.col("c")).alias("d")).first()
    assert tuple(row) == (10.0, 0.0, 0.0)


def strings(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_lists(spark):
    assert strings(spark, ["a|b", "", None, "a||b"], parsing.split_list) == [["a", "b"], [], [], ["a", "b"]]
    assert strings(spark, ["a||b"], lambda t: parsing.split_list(t, keep_blank=True)) == [["a", "", "b"]]
    assert strings(spark, ["x.py,  y.py,,", None], parsing.comma_list) == [["x.py", "y.py"], []]


def test_owner_and_name(spark):
    got = strings(spark, ["https://github.com/own/nam.git", "own/nam/", "github.com/own/nam/issues", "single", " a/b "],
                  parsing.owner_and_name)
    assert [g and tuple(g) for g in got] == [("own", "nam"), ("own", "nam"), ("own", "nam"), None, ("a", "b")]


def test_stated_estimate(spark):
    answers = ['{"hours": 12, "reasoning": "r"}', 'text {"hours": 1.5} more {"hours": 9}', '{"reasoning": "x"}',
               "no block", "{broken}", '{"hours": "7"}', '{"hours": "many"}', None]
    got = strings(spark, answers, parsing.stated_estimate)
    assert [g.hours for g in got] == [12.0, 1.5, 0.0, None, None, 7.0, None, None]
    assert [g.reasoning for g in got][:4] == ["r", "", "x", None]


def test_prompt_parts(spark):
    row = spark.createDataFrame([("t" * 150, "b" * 3000)], "t string, b string").select(
        parsing.prompt_parts(F.col("t"), F.col("b")).alias("p")).first().p
    assert (len(row.title), len(row.body)) == (100, 2000)


def test_slug_and_keys(spark):
    assert strings(spark, ["org/name v1"], parsing.encoder_slug) == ["org__name_v1"]
    assert strings(spark, ["r"], lambda t: parsing.item_key(t, F.lit(5))) == ["r#5"]


def test_effect_sizes(spark):
    got = values(spark, [0.0, -0.146, 0.147, 0.33, -0.474], verdicts.effect_size)
    assert [g for (g,) in got] == ["negligible", "negligible", "small", "medium", "large"]


def test_significance_words(spark):
    got = values(spark, [0.049, 0.05, None, float("nan")], verdicts.significance_word)
    assert [g for (g,) in got] == ["YES", "no", "err", "err"]


def test_second_model_wins_a_tie(spark):
    got = values(spark, [5.0, 4.0], lambda x: verdicts.better_model(F.lit("A"), F.lit("B"), x, F.lit(5.0)),
                 lambda x: verdicts.improvement_percent(x, F.lit(5.0)))
    assert got == [("B", 0.0), ("A", pytest.approx(20.0))]


def test_error_function_tail(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 1.9, 2.0, 2.1, 3.0, 5.0, 10.0, 25.0]
    got = values(spark, xs, verdicts._error_function_tail)
    assert [g for (g,) in got] == pytest.approx([math.erfc(x) for x in xs], rel=1e-12)


def test_fixed_values_are_whole():
    assert len(fv.VAGUE_TERMS) == 25 and len(fv.DOMAIN_KEYWORDS) == 6
    assert len(fv.HISTORY_FEATURES) == 13 and len(fv.TEXT_FEATURES) == 6


# Statistic and p published for three comparisons on 896 test rows.
@pytest.mark.parametrize("w,p", [(166293.0, 7.832159592251924e-06), (191518.0, 0.22460236406361855),
                                 (162706.0, 8.112919150830756e-07)])
def test_published_rank_tests(spark, w, p):
    n = 896
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    df = spark.createDataFrame([(w, z, float(n))], "w double, z double, n double")
    got = df.select(verdicts.signed_rank_p(F.col("w"), F.col("z"), F.col("n"), F.lit(False)).alias("p")).first().p
    assert got == pytest.approx(p, rel=1e-3)
