"""Sinks for the artefacts of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitor import DAY


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_log(log: DataFrame, path: str, order: Sequence[str] = ("timestamp", "activity"), mode: str = "overwrite") -> None:
    """Clean log in case order; range partitioning keeps files even when one case dominates."""
    from ..operators.clean import sort_for_write

    sort_for_write(log, order).write.mode(mode).parquet(path)


def write_bucketed_log(log: DataFrame, table: str, path: str, buckets: int, order: Sequence[str] = ("timestamp", "activity", "event_id"), mode: str = "overwrite") -> None:
    """Clean log bucketed and sorted by case: later windows and joins on the case need no shuffle.

    Meant for logs without oversized cases, as a bucket is read by one task.
    """
    log.write.mode(mode).option("path", path).bucketBy(buckets, "case_id").sortBy("case_id", *order).saveAsTable(table)


def write_transitions(tr: DataFrame, splits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Transition arrays, one folder per split."""
    tr.join(splits.select("case_id", "split"), "case_id").write.mode(mode).partitionBy("split").parquet(path)


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite", **meta: str) -> None:
    """(token, id, cnt) with run metadata as columns."""
    vocab.withColumns({k: F.lit(v) for k, v in meta.items()}).write.mode(mode).parquet(path)


def write_splits(splits: DataFrame, manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    splits.write.mode(mode).parquet(f"{path}/cases")
    manifest.write.mode(mode).json(f"{path}/manifest")


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long metrics as JSON lines."""
    report.write.mode(mode).json(path)


def write_json_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append records to a decision or feedback log."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_daily(spark: SparkSession, update: DataFrame, path: str) -> DataFrame:
    """Upsert by date into a parquet table: the days of the update replace their partition."""
    update.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return spark.read.parquet(path)


