"""Document fingerprints by winnowing, with positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, picked, slices

#: Code points of a k-gram, and k-grams of a window: any passage of K + WINDOW - 1 is matched for certain.
K = 12
WINDOW = 40
BASE = 0x9E3779B97F4A7C15
PART = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n, modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


UP, DOWN = _powers(PART)


def rolling_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Mixed 64-bit polynomial hash of every k-gram, from differences of running sums modulo 2^64."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * UP[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * DOWN[:n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h >> np.uint64(32)


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions: the minimum of every window, the rightmost of equal ones.

    Texts of at least k + window - 1 equal code points in common share a selected hash. A text with
    fewer k-grams than a window selects the minimum of all; one shorter than k is hashed whole at
    position 0; an empty text selects nothing. Long texts are read in overlapping stretches.
    """
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) < k:
        codes = np.concatenate([codes, np.zeros(k - len(codes), np.uint32)])
    hashes, places = [], []
    step = PART - k - window
    for at in range(0, max(1, len(codes) - k - window + 2), step):
        h = rolling_hashes(codes[at:at + PART], k)
        low, where = h, np.arange(len(h))
        span = min(window, len(h))
        width = 1
        while width < span:
            move = min(width, span - width)
            a, b = low[:-move], low[move:]
            right = b <= a
            low, where = np.where(right, b, a), np.where(right, where[move:], where[:-move])
            width += move
        chosen = np.unique(where)
        hashes.append(h[chosen])
        places.append(chosen + at)
    spots, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], spots


def digest(hashes: np.ndarray) -> str:
    """The set of selected hashes as sorted 8-digit hex numbers."""
    return np.unique(hashes).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of common hashes among all hashes of two digests; two empty ones are alike."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (a, b))
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def with_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``selected``: (hash, position) pairs in order of position (replaced if it exists).

    A NULL or empty text selects nothing; repeated rows select alike. Positions are code points from 0.
    """

    @F.pandas_udf("array<struct<hash:long,position:long>>")
    def select(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[{"hash": x, "position": y} for x, y in zip(*(a.tolist() for a in winnow(t, k, window)), strict=True)] for t in texts], dtype=object)

    return docs.select(*[c for c in docs.columns if c != "selected"], select(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("selected"))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of another."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and positions of every row.

    ``positions`` are the places of the selected hashes in the text, ascending: any k + window - 1 code points
    in a row hold the whole k-gram of at least one, and texts that share such a passage share its hash.

    The next document follows by (doc_id, text); after the last comes the first. Rows are dealt into
    ranges of doc_id, and the first row of a range is also sent, as a look-ahead, to the range before;
    a worker streams its sorted rows and holds two texts. NULL text is empty, NULL ids come first, a
    single row follows itself, and an empty table gives no row.
    """
    n = partitions(docs.sparkSession)
    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = rows.select(F.percentile_approx(ids, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    ranged = rows.withColumn("part", F.expr(_range_of("coalesce(doc_id, -9223372036854775807L - 1)", cuts)))
    # one row per range: its smallest id, and the smallest text hash of the rows with that id
    firsts = {r["part"]: r["low"] for r in ranged.groupBy("part").agg(F.min(ids).alias("low")).collect()}
    used = sorted(firsts)
    if not used:
        return _compared(rows.withColumns({"part": F.lit(0), "ahead": F.lit(False)}), n, k, window)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    lead = F.create_map(*[F.lit(x) for p in used for x in (p, firsts[p])])
    to = F.create_map(*[F.lit(x) for p in used for x in (p, before[p])])
    ahead = ranged.where(ids == F.element_at(lead, F.col("part"))).groupBy("part").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text")).select(
        "doc_id", "text", F.element_at(to, F.col("part")).alias("part"), F.lit(True).alias("ahead"))
    return _compared(ranged.withColumn("ahead", F.lit(False)).unionByName(ahead), n, k, window)


def _range_of(value: str, cuts: list[int]) -> str:
    """SQL for the number of cuts up to a value, in two steps of about the square root of their number."""
    if not cuts:
        return "0"
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    long = lambda x: f"cast('{x}' as bigint)"
    array = lambda xs: "array(" + ", ".join(map(long, xs)) + ")"
    coarse = f"size(filter({array([g[0] for g in groups])}, c -> c <= {value}))"
    inside = f"size(filter(element_at(array({', '.join(map(array, groups))}), greatest(1, {coarse})), c -> c <= {value}))"
    return f"cast(greatest(0, {coarse} - 1) * {step} + {inside} as int)"


def _compared(dealt: DataFrame, n: int, k: int, window: int) -> DataFrame:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held = None
        for part in slices(batches, 128):
            out: list[list] = [[] for _ in names]
            for doc, text, ahead in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                hashes, places = winnow(text, k, window)
                own = digest(hashes)
                if held is not None:
                    last, before, mark, spots = held
                    changed = edited(before, text)
                    near = digest(winnow(changed, k, window)[0])
                    row = (last, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), mark, near, likeness(mark, near), likeness(mark, own), spots)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                held = None if ahead else (doc, text, own, places.astype(np.int32))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    sent = dealt.repartitionById(max(n, 1), F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "text")
    return sent.select("doc_id", "text", "ahead").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>")


def query(spark, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from .common import read_table

    return compare_with_next(read_table(spark, folder, "documents"))
