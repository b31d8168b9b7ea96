"""Arithmetic with the zero rules the metrics need (the session runs in ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL where den is 0 or NULL."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den as double; 0 where the quotient does not exist."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def pct_change(value_a: Column, value_b: Column) -> Column:
    """Relative move in percent; NULL when the baseline is 0."""
    return ratio(value_b - value_a, value_a) * 100


def month_of(ts: Column) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(ts, "month")


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two month starts."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from start to end, at microsecond precision."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)
