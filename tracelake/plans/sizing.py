"""Broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

BROADCAST_ROWS = 100_000


def stored_with_count(df: DataFrame) -> tuple[DataFrame, int]:
    """Store a stage and count its rows."""
    table = stored(df)
    return table, table.count()


def dimension(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store a derived lookup table once and broadcast it only when it proves small.

    The table is written to the shared checkpoint folder, so every consumer joins the same rows
    without recomputing them. Above ``max_rows`` it is returned without a hint and the join shuffles,
    with adaptive skew splitting for hot keys.
    """
    table, n = stored_with_count(df)
    return F.broadcast(table) if n <= max_rows else table
