"""Secret scans with a trigram inverted index, with DataFrame functions only.

A rule is a regular expression. Its Boolean trigram query is derived from the parsed expression:
every match contains all trigrams of at least one of the query's conjunctions. The index holds, for
each trigram that any query mentions, the rows whose text (in lower case) contains it. Postings of
a row meet again by key, conjunctions are intersected there, and only rows that satisfy a rule's
query are verified with the rule itself. Rules without mandatory trigrams are verified on every row.

Matches of a rule are leftmost and do not overlap; those that are too short are dropped without a
second try. Offsets count code points, ends are exclusive. Null texts are empty. Rows with the same
key, or without one, share postings and are verified one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.session import written


@dataclass(frozen=True)
class Rule:
    """``least``: shortest match that counts, measured on ``group``. Base rules have a count of their own."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    # runs below 32 never count, and a run that is cut off is no shorter than its rest
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A part of an expression with more spellings than this gives no literal strings.
SPELLINGS = 32
#: A query: any of these sets of trigrams. None: no trigram is mandatory.
Query = tuple[frozenset[str], ...] | None


def _both(a: Query, b: Query) -> Query:
    """Both queries hold. A product too large keeps the one that is easier to satisfy no more."""
    if a is None or b is None:
        return a or b
    if len(a) * len(b) > SPELLINGS:
        return min(a, b, key=len)
    return _least([x | y for x, y in product(a, b)])


def _any(queries: list[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    return _least([s for q in queries for s in q])


def _least(sets: list[frozenset[str]]) -> Query:
    """Without the sets that ask for more than another one."""
    return tuple(dict.fromkeys(s for s in sets if not any(o < s for o in sets)))


def _of_strings(strings: frozenset[str]) -> Query:
    return _any([(frozenset(s[i:i + 3] for i in range(len(s) - 2)),) if len(s) >= 3 else None for s in sorted(strings)])


def _spellings(node) -> frozenset[str] | None:
    """All strings a parsed element can match, in lower case, if there are few."""
    kind, value = node
    if kind is C.LITERAL:
        return frozenset([chr(value).lower()])
    if kind is C.IN:
        out = set()
        for k, v in value:
            if k is C.LITERAL:
                out.add(chr(v).lower())
            elif k is C.RANGE and v[1] - v[0] < SPELLINGS:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= 6 else None
    if kind is C.SUBPATTERN:
        return _product(value[3])
    if kind is C.BRANCH:
        parts = [_product(p) for p in value[1]]
        return None if any(p is None for p in parts) else frozenset().union(*parts)
    if kind in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT, C.MIN_REPEAT) and value[0] <= value[1] <= 8:
        one = _product(value[2])
        if one is None:
            return None
        out, run = set(), frozenset([""])
        for n in range(value[1] + 1):
            if n >= value[0]:
                out |= run
            run = frozenset(a + b for a, b in product(run, one)) if len(run) * len(one) <= SPELLINGS else None
            if run is None and n < value[1]:
                return None
        return frozenset(out) if len(out) <= SPELLINGS else None
    if kind is C.AT:
        return frozenset([""])
    return None


def _product(nodes) -> frozenset[str] | None:
    out = frozenset([""])
    for node in nodes:
        some = _spellings(node)
        if some is None or len(out) * len(some) > SPELLINGS:
            return None
        out = frozenset(a + b for a, b in product(out, some))
    return out


def _query(nodes) -> Query:
    """Literal stretches give trigrams; an element of unknown spelling ends a stretch and adds its own query."""
    query, run = None, frozenset([""])
    for node in nodes:
        some = _spellings(node)
        if some is not None and len(run) * len(some) <= SPELLINGS:
            run = frozenset(a + b for a, b in product(run, some))
            continue
        query, run = _both(query, _of_strings(run)), some or frozenset([""])
        kind, value = node
        if kind is C.SUBPATTERN:
            query = _both(query, _query(value[3]))
        elif kind is C.BRANCH:
            query = _both(query, _any([_query(p) for p in value[1]]))
        elif kind in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            query = _both(query, _query(value[2]))
    return _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that every match of a pattern contains."""
    return _query(_parser.parse(pattern))


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """``row_key``, ``trigram``: rows whose text in lower case contains one of the given trigrams."""
    low = docs.select(F.col(key).alias("row_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("row_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``row_key``, ``rules``: names of the rules whose query the row's trigrams satisfy."""
    held = index.groupBy("row_key").agg(F.collect_set("trigram").alias("held"))

    def holds(query) -> Column:
        out = F.lit(False)
        for some in query:
            all_of = F.lit(True)
            for t in sorted(some):
                all_of = all_of & F.array_contains("held", t)
            out = out | all_of
        return out

    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(n)) for n, q in queries.items() if q is not None]))
    return held.select("row_key", rules.alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches as an array of (start, order, end), from what lies between the matches."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"))
    length = lambda c: F.length(c).cast("long")
    kind = "array<struct<start: long, kind: int, end: long, ok: boolean>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + length(x["b"])
        end = start + length(x["m"])
        measured = F.regexp_extract(x["m"], rule.pattern, rule.group) if rule.group else x["m"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"),
                        (F.length(measured) >= rule.least).alias("ok"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).cast(kind).alias("out"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out")), step,
                         lambda acc: acc["out"])
    return F.transform(F.filter(walked, lambda s: s["ok"]),
                       lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: its key, ``n_<name>`` of every base rule, ``base_sha256`` and all ``spans``."""
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q is not None for s in q for t in s})
    plain = docs.select(F.col(key).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if trigrams:
        index = written(postings(docs, key, text, trigrams), "postings")
        chosen = written(candidates(index, queries), "secret-candidates").withColumnRenamed("row_key", "_key")
        plain = plain.join(chosen, F.col("row_key").eqNullSafe(F.col("_key")), "left").drop("_key")
    else:
        plain = plain.withColumn("rules", F.lit(None).cast("array<string>"))
    body, none = F.col("text"), F.array().cast("array<struct<start: long, kind: int, end: long>>")
    parts = {}
    for i, rule in enumerate(rules):
        asked = body.rlike(rule.pattern)
        if queries[rule.name] is not None:
            asked = F.coalesce(F.array_contains("rules", rule.name), F.lit(False)) & asked
        parts[rule.name] = F.when(asked, _spans(body, rule, i)).otherwise(none)
    found = plain.select("row_key", *[c.alias(f"s_{n}") for n, c in parts.items()])
    names = F.array(*[F.lit(r.name) for r in rules])

    def joined(chosen: list[Rule]) -> Column:
        spans = F.array_sort(F.concat(*[F.col(f"s_{r.name}") for r in chosen]))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = [r for r in rules if r.base]
    return found.select(F.col("row_key").alias(key),
                        *[F.size(f"s_{r.name}").cast("long").alias(f"n_{r.name}") for r in base],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(list(rules)).alias("spans"))


