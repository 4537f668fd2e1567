"""Seeded randomness from hashes: the same draw on every run, every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed: int | str, *keys: Column | str) -> Column:
    """32 hex digits that order rows in a random-looking but reproducible way."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def hash_int(digest: Column) -> Column:
    """The first eight hex digits of a digest as a number in [0, 2^32)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_long(digest: Column) -> Column:
    """The first fifteen hex digits of a digest as a number in [0, 2^60)."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_unit(seed: int | str, *keys: Column | str) -> Column:
    """Uniform number from 60 bits of a digest, as fine as a double holds."""
    return hash_long(seeded_md5(seed, *keys)) / F.lit(float(1 << 60))


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Order-preserving bucket of a digest: 16^digits evenly filled buckets."""
    return F.substring(digest, 1, digits)
