"""Derived features of requirement texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.functions import text


def derived_features(rows: DataFrame, key: list[str], title: Column, body: Column,
                     *more: Column) -> DataFrame:
    """The derived text features of each row, without the complexity score; ``more`` are further texts, such as those of the
    pull request."""
    texts = rows.select(*key, text.requirement_text(title, body, *more).alias("_text"))
    # the words are split once and then only counted and matched
    split = texts.select(*key, text.text_length(F.col("_text")).alias("text_length"),
                         text.cross_reference_count(F.col("_text")).alias("cross_ref_density"),
                         text.lower_words(F.col("_text")).alias("_words"))
    counted = split.select(*key, "text_length", "cross_ref_density",
                           text.words_in(F.col("_words")).alias("word_count"),
                           text.known_terms(F.col("_words")).alias("_terms"))
    return counted.select(*key, "text_length", "word_count", "cross_ref_density",
                          text.ambiguity_index(F.col("_terms"), F.col("word_count")).alias("ambiguity_index"),
                          text.technical_scope(F.col("_terms")).alias("technical_scope"))
