"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Adaptive execution splits the partitions of a hot join key. Forcing it also covers joins whose result
# is aggregated on the same key: the aggregate then shuffles partial results instead of trusting the
# join's partitioning.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on to an existing session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tracelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps."""
    settings = {**RUNTIME, "spark.ui.showConsoleProgress": "false"}
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started.

    Executors on other machines get it as usual, by an installed package or --py-files.
    """
    known = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for stages and checkpoints, which every executor must reach.

    ``spark.checkpoint.dir`` names it. Where it is unset, the session gets a folder of its own beside
    its tables, under ``spark.sql.warehouse.dir``, which is deleted when the driver ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), f"_stages-{sc.applicationId}")
        path = sc._jvm.org.apache.hadoop.fs.Path(configured)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame) -> DataFrame:
    """Write a stage to the shared checkpoint folder and read it back with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """Like :func:`stored` for stages that grow with the data: Parquet in the shared folder."""
    path = scratch_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
