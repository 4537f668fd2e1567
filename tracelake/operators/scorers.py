"""Action values from a model of the user: Arrow batches in, one array of values per row out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers

#: Rows that a model sees at once, whatever the session's Arrow batches hold.
BATCH = 4096


def checked(values: np.ndarray, rows: int, width: int) -> np.ndarray:
    """The values of a batch as doubles, one row per state and one column per action, all finite."""
    values = np.asarray(values, dtype=np.float64)
    if values.shape != (rows, width):
        raise ValueError(f"the scorer returned shape {values.shape} for {rows} states and {width} actions")
    if not np.isfinite(values).all():
        raise ValueError("the scorer returned a value that is not finite")
    return values


def scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch: int = BATCH):
    """A column function from an array of doubles to the ``width`` action values of a user's model.

    ``load`` builds the model once for each Python worker and task; the model maps a matrix with one state per row
    to a matrix with one action per column. A state without vector has no values. A model that returns another shape or
    values that are not finite fails the query.
    """

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for states in parts:
            out: list = [None] * len(states)
            there = np.flatnonzero(states.notna().to_numpy())
            for at in range(0, len(there), batch):
                rows = there[at:at + batch]
                matrix = np.vstack([np.asarray(states.iloc[i], dtype=np.float64) for i in rows])
                for i, values in zip(rows, checked(model(matrix), len(rows), width), strict=True):
                    out[i] = values
            yield pd.Series(out, dtype=object)

    return run


def with_values(states: DataFrame, features: Sequence[str | Column], load: Callable[[], Callable[[np.ndarray], np.ndarray]], n_actions: int, name: str = "q", batch: int = BATCH) -> DataFrame:
    """Add ``q``, the contract of all operators on values, from a model over the feature columns; NULL features count as 0.

    One Python call per batch of rows; nothing is shuffled and a worker holds one model and one batch.
    """
    reach_workers(states.sparkSession)
    vector = F.array(*[F.coalesce((F.col(f) if isinstance(f, str) else f).cast("double"), F.lit(0.0)) for f in features])
    return states.withColumn(name, scorer(load, n_actions, batch)(vector))
