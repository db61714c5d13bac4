"""Exact quantiles of groups of any size, of several columns at once.

``percentile`` keeps all values of a group in one buffer. Here a wanted rank is selected by
the digits of an order-preserving 64-bit key of the value: rows are counted per leading digit,
the digit that holds the rank is found from running counts, and the next digit is looked at
only among the rows below it. A digit has a fixed number of values, and that is all one task
ever sorts for a rank of a group, whatever the size of the group; nothing is estimated, and
the three digits are always walked. Rows are scanned twice: for the first digit, and to write
the distinct values that share it with a wanted rank, with their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark.operators.groups import side_by_side
from pacemark.session import written

#: Bits of the key below the first and below the second digit; a digit has at most 2^22 values.
_BELOW_FIRST, _BELOW_SECOND = 44, 22


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per ``by`` group: ``by``, ``n`` and one exact quantile per entry.

    Nulls and NaN are left out; between two ranks the value is interpolated linearly.
    ``probabilities`` maps output names to probabilities. Without any value a group
    gives no row, and an empty list of groups one row without quantiles.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    return _ranked(rows, list(by), probabilities)


def quantiles_of(df: DataFrame, by: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """One row per ``by`` group: the quantiles of several columns, found together.

    ``wanted`` maps each column to output names with their probabilities; ``n`` counts
    the values of the first column.
    """
    columns = list(wanted)
    rows = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])))
    shares = {p: f"_p{k}" for k, p in enumerate(sorted({p for w in wanted.values() for p in w.values()}))}
    ranked = _ranked(rows, [*by, "_i"], {name: p for p, name in shares.items()})
    picks = [F.max(F.when(F.col("_i") == i, F.col(shares[p]))).alias(name)
             for i, c in enumerate(columns) for name, p in wanted[c].items()]
    count = F.coalesce(F.max(F.when(F.col("_i") == 0, F.col("n"))), F.lit(0)).alias("n")
    return ranked.groupBy(*by).agg(count, *picks)


def with_order_key(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_key``, a long in the order of the doubles ``_v``: their stored bits, negated below zero.

    Equal values have one key, zeros of either sign included. Null and NaN are not expected. The steps are columns
    of their own, so that each is computed once.
    """
    one, smallest = 1 << 52, float.fromhex("0x1p-1022")
    stepped = (rows.withColumn("_size", F.abs("_v"))
               .withColumn("_near", F.least(F.greatest(F.floor(F.log2("_size")), F.lit(-1022)), F.lit(1023)))
               # dividing by a power of two is exact; the logarithm may be off by one next to such a power
               .withColumn("_part", F.col("_size") / F.pow(F.lit(2.0), "_near"))
               .withColumn("_off", F.when(F.col("_part") >= 2, 1).when(F.col("_part") < 1, -1).otherwise(0)))
    fraction = F.col("_part") * F.when(F.col("_off") > 0, 0.5).when(F.col("_off") < 0, 2.0).otherwise(1.0) - 1
    stored = (F.col("_near") + F.col("_off") + 1023) * F.lit(one) + (fraction * float(one)).cast("long")
    bits = (F.when(F.col("_size") < smallest, (F.col("_size") * 2.0 ** 537 * 2.0 ** 537).cast("long"))
            .when(F.col("_size") == float("inf"), F.lit(2047 * one)).otherwise(stored))
    return (stepped.withColumn("_bits", bits).withColumn("_key", F.when(F.col("_v") < 0, -F.col("_bits")).otherwise(F.col("_bits")))
            .drop("_size", "_near", "_part", "_off", "_bits"))


def _holds_rank(probabilities: list[float]) -> Column:
    """Whether a rank next to a wanted one lies among the ``_c`` ranks that end before ``_upto``."""
    out = F.lit(False)
    for p in probabilities:
        place = (F.col("_n") - 1) * F.lit(float(p))
        for rank in (F.floor(place), F.ceil(place)):
            out = out | ((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")))
    return out


def _descend(counts: DataFrame, within: list[str], digit: str, probabilities: list[float]) -> DataFrame:
    """Rows of ``counts`` whose digit holds a wanted rank; ``_base`` becomes the number of ranks before them."""
    upto = Window.partitionBy(*within).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (counts.withColumn("_upto", F.col("_base") + F.sum("_c").over(upto)).where(_holds_rank(probabilities))
            .withColumn("_base", F.col("_upto") - F.col("_c")))


def _inside(values: DataFrame, by: list[str], probabilities: list[float]) -> DataFrame:
    """Distinct values that share the first digit ``_cell`` with a wanted rank, with their counts ``_c``.

    ``_base`` ranks lie before the cell, of the ``_n`` ranks of the group.
    """
    present = values.where("_v is not null and not isnan(_v)").select(*by, (F.col("_v") + F.lit(0.0)).alias("_v"))
    keyed = with_order_key(present).withColumn("_cell", F.shiftright("_key", _BELOW_FIRST))
    counts = (keyed.groupBy(*by, "_cell").agg(F.count("*").alias("_c"))
              .withColumns({"_n": F.sum("_c").over(Window.partitionBy(*by)), "_base": F.lit(0).cast("long")}))
    # stored, so the planner knows how few cells there are when the rows meet them
    cells = written(_descend(counts, by, "_cell", probabilities).select(*by, "_cell", "_base", "_n"), "cells")
    # equal values meet in the map tasks already, so ties cost nothing
    return written(side_by_side(keyed, cells, [*by, "_cell"]).groupBy(*by, "_cell", "_key").agg(
        F.count("*").alias("_c"), F.first("_v").alias("_v"), F.first("_base").alias("_base"), F.first("_n").alias("_n")), "inside")


def _ranked(values: DataFrame, by: list[str], probabilities: dict[str, float]) -> DataFrame:
    shares = sorted(set(probabilities.values()))
    inside = _inside(values, by, shares).withColumn("_next", F.shiftright("_key", _BELOW_SECOND))
    counts = inside.groupBy(*by, "_cell", "_next").agg(
        F.sum("_c").alias("_c"), F.first("_base").alias("_base"), F.first("_n").alias("_n"))
    narrow = _descend(counts, [*by, "_cell"], "_next", shares).select(*by, "_next", "_base", "_n")
    last = side_by_side(inside.select(*by, "_next", "_key", "_v", "_c"), narrow, [*by, "_next"])
    found = _descend(last, [*by, "_next"], "_key", shares)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_base") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    picks, outs = [], []
    for name, p in probabilities.items():
        target = (F.col("_n") - 1) * F.lit(float(p))
        picks += [at(F.floor(target)).alias(f"_a_{name}"), at(F.ceil(target)).alias(f"_z_{name}")]
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_a_{name}"), F.col(f"_z_{name}")
        share = place - F.floor(place)
        outs.append(F.when(share == 0, low).otherwise(low + (high - low) * share).alias(name))
    return found.groupBy(*by).agg(F.first("_n").alias("n"), *picks).select(*by, "n", *outs)
