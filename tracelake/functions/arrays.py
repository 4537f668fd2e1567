"""Column helpers for fixed-width token arrays and per-action arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASKED = -1e9


def pad(tokens: Column, width: int, side: str = "left", fill: int = 0) -> Column:
    """Pad an int array (at most ``width`` long) with ``fill``."""
    filler = F.array_repeat(F.lit(fill), F.lit(width) - F.size(tokens))
    return F.concat(filler, tokens) if side == "left" else F.concat(tokens, filler)


def pad_mask(length: Column, width: int, side: str = "left") -> Column:
    """1 where a padded array holds a real token."""
    ones = F.array_repeat(F.lit(1).cast("tinyint"), length)
    zeros = F.array_repeat(F.lit(0).cast("tinyint"), F.lit(width) - length)
    return F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)


def last_n(arr: Column, n: int) -> Column:
    return F.when(F.size(arr) > n, F.slice(arr, -n, n)).otherwise(arr)


def first_n(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, n)


def at(arr: Column, index: Column) -> Column:
    """Zero-based element, NULL outside the array."""
    return F.get(arr, index.cast("int"))


def first_index(arr: Column, value: Column) -> Column:
    """Zero-based index of the first match."""
    return (F.array_position(arr, value) - 1).cast("int")


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def masked(q: Column, valid: Column) -> Column:
    """Action values with invalid actions pushed to -1e9."""
    return F.zip_with(q, valid, lambda x, v: F.when(v > 0, x.cast("double")).otherwise(F.lit(MASKED)))


def n_valid(valid: Column) -> Column:
    return F.aggregate(valid, F.lit(0), lambda acc, v: acc + F.when(v > 0, 1).otherwise(0))


def first_valid(valid: Column) -> Column:
    """Zero-based index of the first valid action, NULL when none is valid."""
    pos = F.array_position(F.transform(valid, lambda v: v > 0), F.lit(True))
    return F.when(pos > 0, (pos - 1).cast("int"))


def render(arr: Column, digits: int | None = None) -> Column:
    """Flatten an array to one comma-separated string (stable across engines)."""
    if digits is not None:
        arr = F.transform(arr, lambda x: F.format_string(f"%.{digits}f", x))
    else:
        arr = F.transform(arr, lambda x: x.cast("string"))
    return F.array_join(arr, ",")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x)
