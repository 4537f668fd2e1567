"""Pieces shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_workers

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handled at once by a Python worker, so that memory follows the texts and not the batch size.
SLICE = 256


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def place(columns: list[str], name: str) -> int:
    """Where the column of this name stands: of exactly this name, else in other case."""
    return columns.index(name) if name in columns else [c.lower() for c in columns].index(name.lower())


def bundled(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns ``apart`` and a struct ``_rest`` of all others by their place, whose names cannot clash any more."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    places = [place(docs.columns, n) for n in apart]
    return docs.toDF(*names).select(*[F.col(names[i]).alias(n) for n, i in zip(apart, places, strict=True)], F.struct(*[n for i, n in enumerate(names) if i not in places]).alias("_rest"))


def unbundled(docs: DataFrame, names: list[str], without: Iterable[str] = (), **apart: Column) -> DataFrame:
    """The columns ``names`` of the table that was bundled: those in ``apart`` as given, others as they were, none that is called like ``without`` in any case."""
    given = {place(names, n): c for n, c in apart.items() if n.lower() in {x.lower() for x in names}}
    left = {x.lower() for x in without}
    return docs.select(*[given.get(i, F.col(f"_rest._{i}")).alias(n) for i, n in enumerate(names) if n.lower() not in left], *without)


def extended(docs: DataFrame, needed: list[str], added: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with the columns ``added`` that ``compute`` adds to the columns ``needed``, replacing those of the same name in any case.

    ``compute`` returns the needed columns and ``_rest`` as they were.
    """
    return unbundled(compute(bundled(docs, *needed)), docs.columns, added, **{n: F.col(n) for n in needed})


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these names, whatever else the table holds: names with dots or in other case."""
    places = [place(df.columns, n) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(places, names, strict=True)])


def finite_vectors(vectors: DataFrame, vec_id: str, embedding: str, *others: str) -> DataFrame:
    """(vec_id, vec) and the columns ``others`` of rows whose vector is there with finite components only."""
    rows = picked(vectors, vec_id, embedding, *others).withColumnsRenamed({vec_id: "vec_id", embedding: "vec"})
    whole = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.withColumn("vec_id", F.col("vec_id").cast("long")).where(F.col("vec").isNotNull() & whole)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL ids have no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def seeded_unit(seed: int, *columns: Column) -> Column:
    """Uniform number in [0, 1) from a seeded hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def lines_of(text: Column) -> Column:
    """All lines of a text; a NULL or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
