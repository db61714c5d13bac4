"""Durations, buckets, tiers and the target transform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacemark import fixed_values as fv

MICROS_PER_HOUR = 3.6e9


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, subtracted in whole microseconds; null if one is null."""
    return (F.unix_micros(end) - F.unix_micros(start)).cast("double") / F.lit(MICROS_PER_HOUR)


def duration_hours(created: Column, assigned: Column, merged: Column) -> Column:
    """From assignment, or creation when nobody was assigned, to the merge."""
    return hours_between(F.coalesce(assigned, created), merged)


def in_bounds(hours: Column, min_hours: float = fv.MIN_DURATION_HOURS,
              max_days: float | None = fv.MAX_DURATION_DAYS) -> Column:
    """Both bounds inclusive; null fails."""
    keep = hours >= F.lit(float(min_hours))
    if max_days is not None:
        keep = keep & (hours <= F.lit(float(max_days * 24)))
    return F.coalesce(keep, F.lit(False))


def _bucket(hours: Column, buckets: list[tuple], pick) -> Column:
    chain = None
    for ordinal, (low, high, label) in enumerate(buckets):
        test = hours >= F.lit(float(low))
        if high is not None:
            test = test & (hours < F.lit(float(high)))
        test = test & ~F.isnan(hours)
        chain = (F if chain is None else chain).when(test, F.lit(pick(ordinal, label)))
    return chain


def prediction_bucket(hours: Column) -> Column:
    """Six-way bucket; what fits nowhere (negative, missing) goes to the last one."""
    return _bucket(hours, fv.PREDICTION_BUCKETS, lambda _, label: label).otherwise(
        F.lit(fv.PREDICTION_BUCKETS[-1][2]))


def quality_bucket(hours: Column) -> Column:
    """Seven-way bucket of the quality report; null when nothing matches."""
    return _bucket(hours, fv.QUALITY_BUCKETS, lambda _, label: label)


def effort_tier(hours: Column) -> Column:
    chain = F.when(hours.isNull(), F.lit(None).cast("string"))
    for bound, tier in fv.EFFORT_TIERS:
        chain = chain.when(hours < F.lit(float(bound)), F.lit(tier))
    return chain.otherwise(F.lit(fv.TOP_EFFORT_TIER))


def _one_decimal(x: Column) -> Column:
    """``x`` to one decimal as text, rounding by its exact binary value.

    Only when ``x * 10`` lands on a half does the product's own rounding matter;
    its error is recovered exactly by splitting ``x`` into two short halves.
    """
    tenfold = x * F.lit(10.0)
    head = x.cast("float").cast("double")
    error = (head * F.lit(10.0) - tenfold) + (x - head) * F.lit(10.0)
    tie = (tenfold - F.floor(tenfold)) == F.lit(0.5)
    tenths = (F.when(tie & (error > 0), F.floor(tenfold) + 1)
              .when(tie & (error < 0), F.floor(tenfold))
              .otherwise(F.rint(tenfold)))
    return F.format_string("%.1f", tenths.cast("double") / F.lit(10.0))


def readable_hours(hours: Column, months: bool = False) -> Column:
    """Hours as minutes, hours, days or weeks (and months where a page shows them)."""
    days = hours / 24
    weeks = days / 7
    text = (F.when(hours.isNull(), F.lit(None).cast("string"))
            .when(hours < 1, F.concat((hours * 60).cast("long").cast("string"), F.lit(" min")))
            .when(hours < 24, F.concat(_one_decimal(hours), F.lit("h")))
            .when(days < 14, F.concat(_one_decimal(days), F.lit("d"))))
    if months:
        text = text.when(weeks >= 10, F.concat(_one_decimal(days / F.lit(30.44)), F.lit("mo")))
    return text.otherwise(F.concat(_one_decimal(weeks), F.lit("w")))


def log_target(hours: Column) -> Column:
    return F.log1p(hours)


def hours_from_log(log_hours: Column) -> Column:
    """Back to hours, never below zero."""
    return F.greatest(F.expm1(log_hours), F.lit(0.0))


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def relative_error(actual: Column, predicted: Column) -> Column:
    return absolute_error(actual, predicted) / F.greatest(actual, F.lit(1e-6))


def within_band(actual: Column, predicted: Column, share: float = 0.25) -> Column:
    return predicted.between(actual * F.lit(1 - share), actual * F.lit(1 + share))


def age_days(first_seen: Column, created: Column) -> Column:
    """Days a file had existed when the item was created; unknown or later files are 0."""
    days = (F.unix_micros(created) - F.unix_micros(first_seen)).cast("double") / F.lit(86400e6)
    return F.coalesce(F.greatest(days, F.lit(0.0)), F.lit(0.0))


def age_years(created: Column, today: Column) -> Column:
    """Whole days over 365.25, unrounded."""
    whole_days = F.floor((F.unix_micros(today) - F.unix_micros(created)).cast("double") / F.lit(86400e6))
    return whole_days / F.lit(365.25)
