"""Vector codes: product quantisation by Lloyd rounds whose members stay where they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .common import finite_vectors, partitions, read_table, slices

POSITIONS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts of an owner, when there are more of them than shuffle partitions can hold.
OWNER_PARTS = 250_000
#: Integers beyond this are set to it, so that all of them are longs.
LIMIT = 1 << 62
ROWS_AT_ONCE = 4096
MEMBER = "position int, entry int, salt int, part binary"

Books = list[np.ndarray]


def whole_numbers(batch: pa.RecordBatch | pa.Table, dims: int) -> np.ndarray:
    """floor(1024 x) of the vectors of a batch; scaling by a power of two is exact."""
    flat = batch["vec"]
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * SCALE), -float(LIMIT), float(LIMIT)).astype(np.int64).reshape(batch.num_rows, dims)


def cuts(dims: int) -> list[slice]:
    """Consecutive parts; where the length is no multiple, the first ones have one component more."""
    size, more = divmod(dims, POSITIONS)
    ends = np.cumsum([0, *[size + (i < more) for i in range(POSITIONS)]])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]


def nearest_entry(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equal ones, and the squared distance as exact integers.

    Doubles hold every sum exactly while it stays below 2^53; larger numbers are Python integers.
    """
    largest = max((int(np.abs(x).max(initial=0)) for x in (parts, book)), default=0)
    if max(1, parts.shape[1]) * 4 * largest * largest < 1 << 53:
        x, c = parts.astype(np.float64), book.astype(np.float64)
        away = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    else:
        x, c = parts.astype(object), book.astype(object)
        away = np.array([[((a - b) ** 2).sum() for b in c] for a in x], dtype=object)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(parts)), best]


def members(batches: Iterable[pa.RecordBatch], dims: int, books: Books, salts: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The parts of every vector with their nearest entry; rows are salted in turn."""
    seen = 0
    for batch in slices(batches, ROWS_AT_ONCE):
        values = whole_numbers(batch, dims)
        salt = ((seen + np.arange(len(values))) % salts).astype(np.int32)
        seen += len(values)
        for position, cut in enumerate(cuts(dims)):
            part = values[:, cut]
            entry = nearest_entry(part, books[position])[0]
            yield member_batch(np.full(len(part), position), entry, salt, packed(part, kind))


def member_batch(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, part: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), part], names=["position", "entry", "salt", "part"])


def packed(part: np.ndarray, kind: str) -> pa.Array:
    raw = np.ascontiguousarray(part.astype(kind))
    size = raw.shape[1] * raw.itemsize
    offsets = pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * np.int32(size))
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, offsets, pa.py_buffer(raw.tobytes())])


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.int64)


def moved(batches: Iterable[pa.RecordBatch], books: Books, kind: str) -> Iterator[pa.RecordBatch]:
    """Members with the entry they belong to now beside the one they came from."""
    for batch in slices(batches, ROWS_AT_ONCE):
        position, entry = batch["position"].to_numpy(), batch["entry"].to_numpy()
        now = entry.copy()
        for p in np.unique(position):
            at = np.flatnonzero(position == p)
            now[at] = nearest_entry(unpacked(batch["part"].take(pa.array(at)), kind), books[p])[0]
        yield batch.append_column("now", pa.array(now, pa.int32()))


def resident_sums(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Per position, entry and component the sum of the members that live in this partition, as two halves."""
    totals: dict[tuple[int, int], list] = {}
    for batch in slices(batches, ROWS_AT_ONCE):
        owner = batch["position"].to_numpy().astype(np.int64) * ENTRIES + batch["entry"].to_numpy()
        for p in np.unique(owner // ENTRIES):
            at = np.flatnonzero(owner // ENTRIES == p)
            values = unpacked(batch["part"].take(pa.array(at)), kind)
            entry = owner[at] % ENTRIES
            order = np.argsort(entry, kind="stable")
            names, first = np.unique(entry[order], return_index=True)
            high, low = np.add.reduceat(values[order] >> 31, first), np.add.reduceat(values[order] & 0x7FFFFFFF, first)
            for e, h, l, n in zip(names.tolist(), high, low, np.diff(np.append(first, len(at))).tolist(), strict=True):
                have = totals.get((int(p), e))
                totals[int(p), e] = [h, l, n] if have is None else [have[0] + h, have[1] + l, have[2] + n]
    for (p, e), (high, low, n) in totals.items():
        width = len(high)
        whole = lambda v: pa.array(np.full(width, v), pa.int32())  # noqa: B023, E731
        yield pa.record_batch([whole(p), whole(e), pa.array(np.arange(width), pa.int32()), pa.array(high), pa.array(low), pa.array(np.full(width, n, np.int64))], names=["position", "entry", "k", "high", "low", "n"])


def updated(books: Books, sums: Iterable[Row]) -> Books:
    """Entries replaced by floor(sum / count) of their members; unused ones stay."""
    out = [b.copy() for b in books]
    for r in sums:
        out[r.position][r.entry, r.k] = ((r.high << 31) + r.low) // r.n
    return out


def fitted(vectors: DataFrame, dims: int, books: Books, kind: str, owners: int, rounds: int) -> Books:
    """Codebooks after ``rounds`` rounds over (vec_id, vec).

    Parts are dealt once to owners of (position, entry, salt). In every later round they are assigned where
    they live; those that keep their entry stay in their partition, the others travel to the partition
    of their new owner. An owner sums its residents, so sums, never parts, leave it. Members are kept
    by persist(); a lost executor's are computed again from the table.
    """
    spark = vectors.sparkSession
    owner = ["position", "entry", "salt"]
    living = vectors.mapInArrow(lambda b: members(b, dims, books, owners, kind), MEMBER).repartition(owners, *owner).persist()
    held = [living]
    for left in range(rounds - 1, -1, -1):
        sums = living.mapInArrow(lambda b: resident_sums(b, kind), "position int, entry int, k int, high long, low long, n long")
        books = updated(books, sums.groupBy("position", "entry", "k").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect())
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
        if left:
            model = spark.sparkContext.broadcast(books)
            seen = living.mapInArrow(lambda b, m=model: moved(b, m.value, kind), MEMBER + ", now int").persist()
            stay = seen.where("now = entry").drop("now")
            gone = seen.where("now != entry").select("position", F.col("now").alias("entry"), "salt", "part").repartition(owners, *owner)
            living = stay.unionByName(gone).persist()
            held += [seen, living]
    for old in held:
        old.unpersist()
    return books


def coded(batches: Iterable[pa.RecordBatch], dims: int, books: Books) -> Iterator[pa.RecordBatch]:
    """Code and squared error of every vector; an error beyond a long is the largest long."""
    for batch in slices(batches, ROWS_AT_ONCE):
        values = whole_numbers(batch, dims)
        found = [nearest_entry(values[:, cut], book) for cut, book in zip(cuts(dims), books, strict=True)]
        codes = np.column_stack([best for best, _ in found]).astype(np.uint8)
        errors = [min(sum(int(away[i]) for _, away in found), (1 << 63) - 1) for i in range(len(values))]
        yield pa.record_batch([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector with finite components.

    Rows whose vector is NULL or holds a NULL or non-finite component are dropped. A codebook starts as the parts
    of the 256 smallest ids: NULL ids come last, repeated ids in the order of their vectors, and
    fewer rows give fewer entries. Repeated rows count as often as they occur. Vectors of every
    length have codebooks of their own; where a length is no multiple of four, the first parts are
    one longer. Integers beyond 2^62 are set to it, errors beyond a long to the largest long. An
    empty table gives an empty result. Codebooks hold at most 256 entries of a vector's length, whatever the table's size.
    """
    spark = vectors.sparkSession
    rows = finite_vectors(vectors, vec_id, embedding, label).withColumnsRenamed({label: "label"})
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"
    lengths = rows.groupBy(F.size("vec").alias("dims")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.coalesce(F.array_max("vec"), F.lit(0.0)), -F.coalesce(F.array_min("vec"), F.lit(0.0)))).alias("most"))
    done = [spark.createDataFrame([], schema + ", codebooks_sha256 string")]
    for dims, n, most in sorted(tuple(r) for r in lengths.collect()):
        own = rows.where(F.size("vec") == dims)
        first = own.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(ENTRIES).toArrow()
        start = whole_numbers(first, dims)
        packing = "<i2" if most * SCALE < 1 << 15 else "<i4" if most * SCALE < 1 << 31 else "<i8"
        owners = max(partitions(spark), -(-n * POSITIONS // OWNER_PARTS))
        books = fitted(own.select("vec"), dims, [start[:, c] for c in cuts(dims)], packing, owners, rounds)
        model = spark.sparkContext.broadcast(books)
        codes = own.select("vec_id", "vec", "label").mapInArrow(lambda b, d=dims, m=model: coded(b, d, m.value), schema)
        done.append(codes.withColumn("codebooks_sha256", F.lit(digest(books))))
    coded_rows = stored_table(reduce(DataFrame.unionByName, done))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = dimension(coded_rows.groupBy("label").agg(F.coalesce(total.try_cast("long"), F.lit((1 << 63) - 1)).alias("label_error")))
    c, t = coded_rows.alias("c"), by_label.alias("t")
    return c.join(t, F.col("c.label").eqNullSafe(F.col("t.label"))).select("c.vec_id", "c.label", "c.code", "c.error", "t.label_error", "c.codebooks_sha256")


def query(spark, folder: str) -> DataFrame:
    """Codes of all embeddings."""
    return vector_codes(read_table(spark, folder, "embeddings")).drop("label")


def _rounds(n: int) -> str:
    """Codebooks c0 to cn and assignments a1 to a(n + 1) as chained statements."""
    text = ""
    for i in range(1, n + 2):
        text += f""",
a{i} AS (
  SELECT rid, p, any_value(x) AS x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS m
  FROM parts JOIN c{i - 1} USING (p) GROUP BY rid, p)"""
        if i <= n:
            text += f""",
m{i} AS (
  SELECT p, e, list(v ORDER BY k) AS c FROM (
    SELECT p, m.e AS e, k, floor(sum(x[k]) / count(*)) AS v FROM a{i}, (SELECT unnest(range(1, len(x) + 1)) AS k FROM (SELECT any_value(x) AS x FROM parts)) GROUP BY ALL)
  GROUP BY p, e),
c{i} AS (SELECT p, e, coalesce(m{i}.c, c{i - 1}.c) AS c FROM c{i - 1} LEFT JOIN m{i} USING (p, e))"""
    return text


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT rid, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS t(p)),
c0 AS (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= 256){_rounds(ROUNDS)},
coded AS (
  SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS + 1} GROUP BY rid),
shas AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS h FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS k FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid), shas"""
