"""Cases from activity gaps: events of one key belong together until nothing happens for a while."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sequence import SEGMENT, ordered
from .cases import ORDER
from .clean import ACTIVITY, CASE, TIME


def session_cases(log: DataFrame, gap_seconds: int, order: Sequence[str] = ORDER, max_rows: int = 1_000_000) -> DataFrame:
    """The log with ``session`` (1, 2, ... per case), a new one wherever an event follows the one before by more than the gap.

    Both passes are ordered by case, so an uncut log is shuffled once; cut cases carry gap and number across their
    segments. Events without time open no session.
    """
    stamp = F.unix_micros(TIME)
    gaps = ordered(log, order, lag={"_before": stamp}, position="_pos", count="_size")
    opened = F.when(F.col("_before").isNull() & (F.col("_pos") == 1), 1).when(stamp - F.col("_before") > gap_seconds * 1_000_000, 1).otherwise(0)
    marked = gaps.withColumn("_opened", opened)
    if SEGMENT in log.columns:
        # the first pass has used up the cuts; positions are known now and give new ones
        marked = marked.withColumn(SEGMENT, F.floor(F.col("_pos") / max_rows).cast("int"))
    numbered = ordered(marked, order, running={"session": F.col("_opened")}, position="_pos2", count="_size2")
    return numbered.select(*[c for c in log.columns if c != SEGMENT], F.col("session").cast("long").alias("session"))


def session_summary(events: DataFrame, gap: str, counted: Sequence[str] = (), largest: Sequence[str] = (), key: str = CASE) -> DataFrame:
    """One row per session: key, start, end, duration, events, counts of activities, largest values.

    Spark merges session windows of events up to ``gap`` apart; partial sessions are merged on the map side and, in a
    stream, in the state, so late events join sessions they bridge. The same function serves batch and stream.
    """
    own = events.groupBy(key, F.session_window(TIME, gap).alias("w")).agg(
        F.min(TIME).alias("start_ts"), F.max(TIME).alias("end_ts"), F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col(ACTIVITY) == a).alias(f"count_{a}") for a in counted], *[F.max(c).alias(f"max_{c}") for c in largest])
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6
    return own.select(key, "start_ts", "end_ts", seconds.alias("duration"), "n_events", *[f"count_{a}" for a in counted], *[f"max_{c}" for c in largest])
