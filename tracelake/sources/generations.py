"""A growing keyed table: rows appended per batch, read by the buckets of their keys, merged in generations."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Folder:
    """Rows of one bucket; ``level`` counts how often they were merged."""

    bucket: int
    level: int
    name: str


@dataclass(frozen=True)
class GenerationStore:
    """Folders per bucket and a manifest per version that names those in use.

    A version adds one folder to each bucket that its rows touch. As soon as a bucket has ``fan`` folders of a
    level they become one of the next, so a bucket has fewer than ``fan`` folders per level and every row is
    written once per level. Readers take the folders from the manifest and list nothing else.
    Writing a version again replaces it; what the version before needs is kept until then.
    """

    path: str
    key: str = "case_id"
    buckets: int = 256
    fan: int = 8

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def live(self, spark: SparkSession, version: int) -> list[Folder]:
        """Folders in use after ``version``."""
        return [f for f, used in self._manifest(spark, version) if used]

    def _manifest(self, spark: SparkSession, version: int) -> list[tuple[Folder, bool]]:
        """Folders and whether they are in use: fewer than 2 x buckets x fan x levels rows."""
        if version < 0:
            return []
        rows = spark.read.schema("bucket int, level int, name string, used boolean").parquet(f"{self.path}/manifest/{version}")
        return sorted(((Folder(*r[:3]), r[3]) for r in rows.collect()), key=lambda e: (e[0].bucket, e[0].level, e[0].name))

    def latest(self, spark: SparkSession) -> int:
        """The newest version, -1 for an empty store; at most three manifests exist."""
        path, files = self._files(spark, "manifest")
        return max((int(s.getPath().getName()) for s in files.listStatus(path)), default=-1) if files.exists(path) else -1

    def read(self, spark: SparkSession, schema: T.StructType | str, version: int, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        return self._rows(spark, schema, [f for f in self.live(spark, version) if wanted is None or f.bucket in wanted])

    def append(self, batch: DataFrame, version: int, spread: Column | None = None) -> DataFrame:
        """Store a batch as ``version`` and return (bucket, key) of its rows.

        ``spread`` deals the rows of one bucket to four tasks, so a key that fills a batch is written by several.
        """
        spark = batch.sparkSession
        schema = batch.schema
        live = self.live(spark, version - 1)
        fresh = f"data/{version}-0"
        salt = F.pmod(F.lit(0) if spread is None else spread, F.lit(4))
        self._write(batch.withColumn("_salt", salt).withColumn("bucket", self.bucket()).repartition("bucket", "_salt").drop("_salt"), fresh)
        new = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{fresh}")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        live += [Folder(b, 0, f"{fresh}/bucket={b}") for b in touched]
        gone: list[Folder] = []
        level = 0
        while any(f.level >= level for f in live):
            due = defaultdict(list)
            for f in live:
                if f.level == level:
                    due[f.bucket].append(f)
            old = [f for own in due.values() if len(own) >= self.fan for f in own]
            if old:
                merged = f"data/{version}-{level + 1}"
                self._write(self._rows(spark, schema, old).withColumn("bucket", self.bucket()), merged)
                gone += old
                live = [f for f in live if f not in old] + [Folder(b, level + 1, f"{merged}/bucket={b}") for b in {f.bucket for f in old}]
            level += 1
        entries = spark.createDataFrame([(f.bucket, f.level, f.name, f not in gone) for f in [*live, *gone]], "bucket int, level int, name string, used boolean")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        self._forget(spark, version, live)
        return new.select("bucket", self.key)

    def _forget(self, spark: SparkSession, version: int, live: list[Folder]) -> None:
        """Delete what neither this version nor the one before uses."""
        if version < 2:
            return
        path, files = self._files(spark, f"manifest/{version - 2}")
        if not files.exists(path):
            return
        kept = {f.name for f in [*live, *self.live(spark, version - 1)]}
        for f, _ in self._manifest(spark, version - 2):
            if f.name not in kept:
                files.delete(self._files(spark, f.name)[0], True)
        files.delete(path, True)

    def _files(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _rows(self, spark: SparkSession, schema: T.StructType | str, folders: list[Folder]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/{f.name}" for f in folders])

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
