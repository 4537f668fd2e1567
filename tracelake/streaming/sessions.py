"""Session cases in a stream: a session is written once the watermark has passed its end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import CASE, TIME
from ..operators.sessions import session_summary
from .cases import setting


def start_sessions(
    events: DataFrame, gap: str, path: str, checkpoint: str, delay: str = "1 hour", counted: Sequence[str] = (), largest: Sequence[str] = (),
    partitions: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Append closed sessions as Parquet. State holds the open sessions only; events may be up to ``delay`` late.

    A row with a NULL case is a heartbeat: it moves the watermark and belongs to no session.
    """
    spark = events.sparkSession
    # the condition needs the aggregate: on the key alone it would be pushed below the watermark, which then missed the heartbeats
    found = session_summary(events.withWatermark(TIME, delay), gap, counted, largest).where(F.when(F.col("n_events") > 0, F.col(CASE)).isNotNull())
    writer = found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    with setting(spark, spark__sql__shuffle__partitions=None if partitions is None else str(partitions)):
        return (writer.trigger(availableNow=True) if available_now else writer).start()
