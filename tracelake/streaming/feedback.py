"""Feedback stream: consolidated into transitions as cases grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.transitions import feedback_transitions
from ..sources.generations import GenerationStore


def consolidate(rows: DataFrame, features: Sequence[str], since: str | None = None, until: str | None = None, min_cases: int = 1) -> DataFrame:
    """Transitions of feedback rows, optionally of one half-open time range (a week)."""
    if since:
        rows = rows.where(F.col("timestamp") >= F.to_timestamp(F.lit(since)))
    if until:
        rows = rows.where(F.col("timestamp") < F.to_timestamp(F.lit(until)))
    return feedback_transitions(rows, features, min_cases)


def stored_feedback(spark: SparkSession, store: GenerationStore, schema: T.StructType | str) -> DataFrame:
    """Everything stored so far."""
    return store.read(spark, schema, store.latest(spark))


def start_consolidation(stream: DataFrame, store: GenerationStore, out: str, checkpoint: str, features: Sequence[str], available_now: bool = True) -> StreamingQuery:
    """Each batch is stored, then the cases it touches are rebuilt from what is stored of them.

    Versions are batch numbers and replaced on replay. Untouched cases are not recomputed; the folders of
    the touched buckets come from the store's manifest, so a batch lists no history.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = store.append(batch, batch_id, F.xxhash64("t")).distinct()
        touched = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most as many as the store has buckets
        rows = store.read(spark, batch.schema, batch_id, touched).join(keys.select("case_id"), "case_id", "left_semi")
        feedback_transitions(rows, features).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_transitions(spark: SparkSession, out: str) -> DataFrame:
    """Latest version of every (case_id, t)."""
    w = Window.partitionBy("case_id", "t").orderBy(F.desc("batch"))
    return spark.read.parquet(out).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "batch")
