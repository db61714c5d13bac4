"""Personal data by weak supervision: labelers vote on span candidates, EM weighs them, a classifier decides.

Candidates are all spans of four fixed patterns (email, ip, card, phone) and of looser ones
(written-out addresses, addresses with six groups of colons, national phone numbers, numbers of
card length with a wrong check digit, quads out of range). Six labelers (regex, checks, gazetteer,
context words, neighbouring characters, shape) vote yes, no or abstain. Expectation-maximisation
over the counts of vote patterns of all candidates estimates, for each kind, how often each
labeler is right; its posteriors train a logistic span classifier on votes and span features.

Spans of the fixed patterns always stay; other candidates are added if the classifier says so and
they overlap none of those. Matches are leftmost and do not overlap within a kind; those that fail
a check are dropped without a second try. Offsets count code points, ends are exclusive. Null
texts are empty. Every row is judged by itself, so keys may be null or repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.session import written

KINDS = ("email", "ip", "card", "phone")
#: Vote values: no, yes, abstain.
NO, YES, ABSTAIN = 0, 1, 2
LABELERS = ("regex", "check", "gazetteer", "context", "neighbours", "shape")

# Fixed patterns. Possessive runs give the same matches and keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser patterns.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,64})+")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_MAYBE = re.compile(r"[@0-9]|[\[(]at[\])]")

# Gazetteers: endings of addresses, leading digits of card issuers, country codes, cue words.
ENDINGS = frozenset("com org net edu gov mil int info biz io de fr es it uk us eu ch at nl be pl ru jp cn in br au ca".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 "
                      "81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 380 420 421 852 886 971 972".split())
CUES = {"email": "email mail contact write address".split(), "ip": "ip host server address login from".split(),
        "card": "card visa mastercard amex credit debit payment pay".split(),
        "phone": "phone tel call fax mobile cell contact".split()}
COUNTER_CUES = "version isbn issn order invoice ref sku page section chapter figure table id no build release".split()
_CUES = {k: re.compile(r"\b(?:" + "|".join(v) + r")\b", re.I) for k, v in CUES.items()}
_COUNTER = re.compile(r"\b(?:" + "|".join(COUNTER_CUES) + r")\b", re.I)

#: Characters before a span in which context words count.
CONTEXT = 40


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int
    base: bool


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, each from the first possible character of its local part."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            # nothing before this sign can be part of a later match
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _in_range(quad: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in quad.split("."))


def candidates(text: str) -> list[Span]:
    """All spans of the fixed patterns, and the looser ones that overlap none of them, by start and kind."""
    if not _MAYBE.search(text):
        return []
    base, loose = [], []
    if "@" in text:
        base += [Span(0, a, b, True) for a, b in emails(text)]
    for m in _IP.finditer(text):
        (base if _in_range(m[0]) else loose).append(Span(1, m.start(), m.end(), _in_range(m[0])))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        good = 14 <= len(digits) <= 19 and luhn(digits)
        if good or 13 <= len(digits) <= 19:
            (base if good else loose).append(Span(2, m.start(), m.end(), good))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_digits(m[0]))
            if 10 <= n <= 15:
                base.append(Span(3, m.start(), m.end(), True))
            elif 7 <= n <= 9:
                loose.append(Span(3, m.start(), m.end(), False))
    if "at)" in text or "at]" in text:
        loose += [Span(0, m.start(), m.end(), False) for m in _SPELT.finditer(text)]
    loose += [Span(1, m.start(), m.end(), False) for m in _COLONS.finditer(text)]
    loose += [Span(3, m.start(), m.end(), False) for m in _NATIONAL.finditer(text)]
    kept = sorted(base, key=lambda s: (s.start, s.kind))
    if loose:
        taken = np.array(sorted((s.start, s.end) for s in base), dtype=np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
        for s in loose:
            i = int(np.searchsorted(taken[:, 0], s.end))
            if i == 0 or reach[i - 1] <= s.start:
                kept.append(s)
        kept.sort(key=lambda s: (s.start, s.kind, s.end))
    return kept


def votes(text: str, s: Span) -> tuple[int, ...]:
    """What each labeler says about a candidate."""
    kind, body = KINDS[s.kind], text[s.start:s.end]
    digits = _digits(body)
    before = text[max(0, s.start - CONTEXT):s.start]
    left, right = text[s.start - 1:s.start], text[s.end:s.end + 1]
    regex = YES if s.base else ABSTAIN
    if kind == "email":
        end = re.split(r"[.\s\[\]()]+", body.rstrip(").] "))[-1].lower()
        check = YES if end.isalpha() and len(end) >= 2 else NO
        gazetteer = YES if end in ENDINGS else ABSTAIN
        shape = NO if ".." in body or len(body) > 254 else YES
    elif kind == "ip":
        quad = body.split(".") if "." in body else []
        check = YES if not quad or _in_range(body) else NO
        gazetteer = ABSTAIN if not quad else NO if int(quad[0][-4:]) in (0, 127, 255) or int(quad[0][-4:]) > 223 else YES
        shape = NO if any(len(p) > 3 for p in quad) else YES
    elif kind == "card":
        check = YES if luhn(digits) else NO
        gazetteer = YES if digits.startswith(ISSUERS) else NO
        shape = NO if len(set(digits)) <= 2 else YES if len(digits) in (15, 16) else ABSTAIN
    else:
        check = YES if 10 <= len(digits) <= 15 else NO
        plus = body.startswith("+")
        gazetteer = (YES if any(digits[:k] in COUNTRIES for k in (1, 2, 3)) else NO) if plus else ABSTAIN
        shape = NO if len(set(digits)) <= 2 else YES if "(" in body or plus else ABSTAIN
    context = YES if _CUES[kind].search(before) else NO if _COUNTER.search(before) else ABSTAIN
    glued = left.isalnum() or right.isalnum() or left in ("-", "/", ".", "_", "=") and left != ""
    return regex, check, gazetteer, context, NO if glued else YES, shape


def features(text: str, s: Span) -> int:
    """Length class and the classes of the neighbouring characters, as a number below 64."""
    kinds = [0 if c == "" or c.isspace() else 1 if c.isalnum() else 2 if c in ".,;:!?" else 3
             for c in (text[s.start - 1:s.start], text[s.end:s.end + 1])]
    length = int(np.searchsorted([12, 16, 20], s.end - s.start, side="right"))
    return length * 16 + kinds[0] * 4 + kinds[1]


def code(s: Span, v: tuple[int, ...], f: int) -> int:
    """Kind, votes and features of a candidate as one number: 4 * 3 ** 6 * 64 at most."""
    out = s.kind
    for x in v:
        out = out * 3 + x
    return out * 64 + f


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (one column per labeler) and features."""
    rest = codes // 64
    v = np.empty((len(codes), len(LABELERS)), dtype=np.int64)
    for j in range(len(LABELERS) - 1, -1, -1):
        v[:, j] = rest % 3
        rest = rest // 3
    return rest, v, codes % 64


def reliabilities(kinds: np.ndarray, v: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns: share of true spans by kind, P(vote | truth) as (kind, labeler, truth, vote), posteriors.

    It starts from the majority of the votes; a weak prior keeps every probability above zero.
    """
    posterior = np.clip(((v == YES).sum(axis=1) + 0.5) / ((v != ABSTAIN).sum(axis=1) + 1), 0.02, 0.98)
    prior, given = np.full(len(KINDS), 0.5), np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kinds == k
            true = np.stack(((1 - posterior[own]) * counts[own], posterior[own] * counts[own]))
            prior[k] = (true[1].sum() + 1) / (true.sum() + 2)
            for j in range(len(LABELERS)):
                for t in (0, 1):
                    n = np.bincount(v[own, j], weights=true[t], minlength=3) + np.array(
                        [0.6, 0.2, 0.2] if t == 0 else [0.2, 0.6, 0.2]) * 2
                    given[k, j, t] = n / n.sum()
        odds = np.log(prior[kinds]) - np.log1p(-prior[kinds])
        for j in range(len(LABELERS)):
            odds = odds + np.log(given[kinds, j, 1, v[:, j]]) - np.log(given[kinds, j, 0, v[:, j]])
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return prior, given, posterior


def design(codes: np.ndarray) -> np.ndarray:
    """Columns of the span classifier: kind, votes by kind, length and neighbours."""
    kinds, v, f = decode(codes)
    n = len(codes)
    x = np.zeros((n, 4 + 4 * 6 * 3 + 12))
    rows = np.arange(n)
    x[rows, kinds] = 1
    for j in range(6):
        x[rows, 4 + kinds * 18 + j * 3 + v[:, j]] = 1
    for j, part in enumerate((f // 16, f // 4 % 4, f % 4)):
        x[rows, 76 + 4 * j + part] = 1
    return x


@dataclass
class Model:
    prior: np.ndarray
    given: np.ndarray
    weights: np.ndarray

    def accepts(self, codes: np.ndarray) -> np.ndarray:
        return design(codes) @ self.weights >= 0


def train(codes: np.ndarray, counts: np.ndarray, rounds: int = 25) -> Model:
    """EM on all candidates, then logistic regression on its posteriors; both see counts of codes only."""
    if not len(codes):
        return Model(np.full(4, 0.5), np.full((4, 6, 2, 3), 1 / 3), np.zeros(88))
    kinds, v, _ = decode(codes)
    prior, given, posterior = reliabilities(kinds, v, counts)
    x, w = design(codes), np.zeros(88)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (posterior - p)) - 0.01 * w
        w = w + np.linalg.solve((x * (counts * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.01 * np.eye(88), grad)
    return Model(prior, given, w)


def voted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: ``row_key`` and its candidates as ``spans`` (kind, start, end, base, code)."""
    plain = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                               ("code", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for t in part.column(1).to_pylist():
                    t = t or ""
                    out.append([{"kind": s.kind, "start": s.start, "end": s.end, "base": s.base,
                                 "code": code(s, votes(t, s), features(t, s))} for s in candidates(t)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, type=kind)], names=["row_key", "spans"])

    return plain.mapInArrow(rows, f"row_key {dict(plain.dtypes)['row_key']}, "
                                  "spans array<struct<kind: int, start: long, end: long, base: boolean, code: long>>")


def fit(candidates: DataFrame) -> Model:
    """The model for a table of ``voted``; at most 4 * 3 ** 6 * 64 counts reach the driver."""
    counts = candidates.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).toPandas()
    counts = counts.sort_values("code")
    return train(counts["code"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=float))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, spans of the fixed patterns by kind and as a digest, and all spans."""
    found = written(voted(docs, key, text), "pii-candidates")
    given = docs.sparkSession.sparkContext.broadcast(fit(found))
    empty = hashlib.sha256(b"").hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        name = lambda s: f"{KINDS[s['kind']]}:{s['start']}:{s['end']}"
        for batch in batches:
            counts, digests, joined = np.zeros((4, batch.num_rows), dtype=np.int64), [], []
            for i, spans in enumerate(batch.column(1).to_pylist()):
                if not spans:
                    digests.append(empty)
                    joined.append("")
                    continue
                base = [s for s in spans if s["base"]]
                for s in base:
                    counts[s["kind"], i] += 1
                digests.append(hashlib.sha256(",".join(map(name, base)).encode()).hexdigest())
                take = model.accepts(np.array([s["code"] for s in spans]))
                joined.append(",".join(name(s) for s, t in zip(spans, take) if s["base"] or t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                names=["row_key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    out = found.mapInArrow(rows, f"row_key {dict(found.dtypes)['row_key']}, n_email long, n_ip long, n_card long, "
                                 "n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("row_key", key)
