"""Requirement text and the features derived from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacemark import fixed_values as fv

_EDGE_SPACE = f"^[{fv.SPACE}]+|[{fv.SPACE}]+$"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def requirement_text(title: Column, body: Column, *more: Column) -> Column:
    """Title and body (and, when given, further texts) joined by one space; null is ''."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, body, *more)]
    spaced = [p for part in parts for p in (F.lit(" "), part)][1:]
    return F.concat(*spaced)


def is_blank(text: Column) -> Column:
    """True when there is no visible character at all."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{fv.SPACE}]")


def strip(text: Column) -> Column:
    """Drop all white space at both ends, not only the space character."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def text_length(text: Column) -> Column:
    return F.length(text).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{fv.SPACE}]+")).cast("long")


def cross_reference_count(text: Column) -> Column:
    """All matches of all patterns; a text without a pattern's fixed part skips its search."""
    counts = [F.when(text.contains(fixed), F.regexp_count(text, F.lit(pattern))).otherwise(0)
              for fixed, pattern in zip(("#", "://", "-", "@"), fv.CROSS_REFERENCE_PATTERNS)]
    return reduce(Column.__add__, counts).cast("long")


def lower_words(text: Column) -> Column:
    """Lower-case words with their punctuation; '' stands at an end that is white space."""
    return F.split(F.lower(text), f"[{fv.SPACE}]+")


def words_in(words: Column) -> Column:
    """Number of words in ``lower_words``, without the blanks at its ends."""
    blank = (F.get(words, F.lit(0)) == "").cast("int") + (F.get(words, F.size(words) - 1) == "").cast("int")
    return F.greatest(F.size(words) - blank, F.lit(0)).cast("long")


def known_terms(words: Column) -> Column:
    """The distinct vague and domain words among ``words``.

    One pass leaves a short array, so the per-list tests below do not walk long
    texts again.
    """
    vocabulary = sorted({*fv.VAGUE_TERMS, *(w for ws in fv.DOMAIN_KEYWORDS.values() for w in ws)})
    return F.array_intersect(words, _words(vocabulary))


def ambiguity_index(terms: Column, words: Column) -> Column:
    vague = F.size(F.array_intersect(terms, _words(fv.VAGUE_TERMS)))
    return vague / F.greatest(words, F.lit(1))


def technical_scope(terms: Column) -> Column:
    hits = [F.arrays_overlap(terms, _words(ws)).cast("long") for ws in fv.DOMAIN_KEYWORDS.values()]
    return reduce(Column.__add__, hits)


def short_text(text: Column, limit: int) -> Column:
    """One display paragraph: tidy line ends, then cut with an ellipsis."""
    tidy = strip(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")),
                           F.lit("\n\n"), F.lit("\n")))
    cut = F.regexp_replace(F.substring(tidy, 1, limit), f"[{fv.SPACE}]+$", "")
    return F.when(F.length(tidy) <= limit, tidy).otherwise(F.concat(cut, F.lit("...")))
