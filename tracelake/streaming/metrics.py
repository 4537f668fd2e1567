"""Streaming daily metrics with late data handled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_stream(decisions: DataFrame, delay: str = "1 day", accuracy: int = 10_000, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) event-time metrics.

    State is one small row per open window: counts, sums and a percentile sketch.
    """
    src = F.col("source")
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)

    def n(cond) -> object:
        return F.count_if(cond)

    agg = decisions.withWatermark("timestamp", delay).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("total_requests"), n(src == "surrogate").alias("n_surrogate"), n(src == "baseline").alias("n_baseline"),
        n(src == "override").alias("n_override"), n(F.coalesce(F.col("ood"), F.lit(False))).alias("n_ood"), F.avg("confidence").alias("confidence_mean"), F.stddev_samp("confidence").alias("confidence_std"),
        F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(accuracy)).alias("_p"))
    total = F.col("total_requests")
    return agg.select(
        F.to_date("w.start").alias("date"), F.col("w.end").alias("window_end"), "total_requests", (F.col("n_surrogate") / total).alias("coverage"),
        (F.col("n_baseline") / total).alias("fallback_rate"), (F.col("n_override") / total).alias("override_rate"), (F.col("n_ood") / total).alias("ood_rate"),
        "confidence_mean", "confidence_std", F.col("_p")[0].alias("latency_p50"), F.col("_p")[1].alias("latency_p95"), F.col("_p")[2].alias("latency_p99"))


def start_daily(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write changed windows per batch. A replayed batch overwrites its own folder, so retries are harmless."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed their window, over the batches the query remembers."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Latest version of every window end."""
    rows = spark.read.parquet(path)
    w = Window.partitionBy("window_end").orderBy(F.desc("batch"))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "batch")
