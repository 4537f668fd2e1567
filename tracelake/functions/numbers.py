"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rnd(x: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def epoch(ts: Column) -> Column:
    """Whole epoch seconds."""
    return F.unix_timestamp(ts)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000.0)
