"""Best-fit packing with certified bounds: partitions with gaps exchange documents and are packed again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored_table
from .common import picked, slices
from .tokens import VOCABULARY, text_ids

CAPACITY = 4096
#: Pieces packed by one task.
GROUP = 20_000
END = np.array([1], "<u4").tobytes()


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins for ``counts[x]`` items of each size x, by dual feasible functions.

    Volume; the threshold functions that count items over capacity - t as whole and drop those under t;
    and the rounding functions x -> floor((k + 1) x / capacity) / k, unchanged where that is whole.
    """
    sizes = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    bounds = [-(-int((sizes * counts).sum()) // capacity)]
    n, volume = np.cumsum(counts[::-1])[::-1], np.cumsum((sizes * counts)[::-1])[::-1]
    n, volume = np.append(n, 0), np.append(volume, 0)
    for t in range(1, capacity // 2 + 1):
        if t < len(counts):
            over = min(capacity - t + 1, len(counts))
            bounds.append(int(n[over]) - (-int(volume[t] - volume[over]) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # in units of capacity * k, so that everything stays integer
        value = np.where(whole, sizes * k, scaled // capacity * capacity)
        bounds.append(-(-int((value * counts).sum()) // (capacity * k)))
    return max(bounds)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every item, and the room left in every bin.

    A bit mask of the rooms in use finds the fullest bin with enough room.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: dict[int, list[int]] = {}
    mask, n = 0, 0
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= size
        left[b] = room
        if room:
            rooms.setdefault(room, []).append(b)
            mask |= 1 << room
    return bins, offsets, np.array(left, np.int64)


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end id 1, cut if too long.

    NULL texts are empty: one piece that holds the end id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = (text_ids(text, name) if text else b"") + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    for column, value in zip(rows, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    lengths = pdf["length"].to_numpy()
    bins, offsets, left = best_fit(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    return pdf.assign(_bin=bins, _offset=offsets, _room=left[bins], _bins=len(left), _bound=bound)


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 6) -> DataFrame:
    """``items`` with sequence_id, offset, group_bins and group_bound; ``length`` is between 1 and ``capacity``.

    Items of full length are sequences of their own. The others are dealt evenly into groups of about
    ``group`` items, as many as their number asks for, and each is packed by best-fit decreasing. Dual-feasible bounds
    certify the bin count of every group and of all items together; ``group_bins`` and ``group_bound`` are those of the group
    that packed the item last, equal where its packing is proven best. While the total is above the bound of all
    items, items of bins with room are exchanged: dealt anew into fewer groups and packed again. If the
    groups' bounds add up to the bound of all items, only groups with a gap can save a bin, so only these exchange; else
    all do, as bins may be saved between them. It ends when certified, when one group is left, when a round gains
    nothing, or after ``rounds`` rounds, which the certificates then show. Items are dealt by their row number in a stored table, so
    neither equal lengths nor repeated ids fill one group. An empty table gives no row. Columns of the added names are replaced.
    """
    names = [c for c in items.columns if c.lower() not in ("sequence_id", "offset", "group_bins", "group_bound")]
    items = items.select(*[F.col(f"`{c}`") for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    packed_type = f"{fields}, _group int, _bin long, _offset long, _room long, _bins long, _bound long"
    done = [items.where(F.col("length") == capacity).select(
        *names, F.lit(0).cast("long").alias("offset"), (F.monotonically_increasing_id() * 2).alias("sequence_id"), *[F.lit(1).cast("long").alias(c) for c in ("group_bins", "group_bound")])]

    def placed(packed: DataFrame, base: int) -> DataFrame:
        # odd ids: a group has far fewer than 2^22 bins
        number = (F.lit(base).cast("long") + F.col("_group")) * F.lit(1 << 22) + F.col("_bin")
        return packed.select(*names, F.col("_offset").alias("offset"), (number * 2 + 1).alias("sequence_id"), F.col("_bins").alias("group_bins"), F.col("_bound").alias("group_bound"))

    rest = items.where(F.col("length") < capacity)
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in rest.groupBy("length").count().collect():  # at most capacity - 1 rows
        histogram[length] = n
    target, total = lower_bound(histogram, capacity), int(histogram.sum())
    groups = max(1, -(-total // group))
    base, closed, before, earlier = 1, 0, None, None
    for turn in range(rounds if total else 0):
        row = F.monotonically_increasing_id()
        dealt = rest.withColumn("_group", F.pmod(row + F.shiftright(row, 33), F.lit(groups)).cast("int"))
        packed = stored_table(dealt.groupBy("_group").applyInPandas(lambda pdf: pack_group(pdf, capacity), packed_type))
        bins, bounds = packed.groupBy("_group").agg(F.first("_bins").alias("_bins"), F.first("_bound").alias("_bound")).agg(F.sum("_bins"), F.sum("_bound")).first()
        if before is not None and closed + bins > before:
            done.append(earlier)
            break
        gained = before is None or closed + bins < before
        if closed + bins <= target or groups == 1 or not gained or turn == rounds - 1:
            done.append(placed(packed, base))
            break
        opened = "_room > 0" if closed + bounds > target else "_room > 0 AND _bins > _bound"
        kept, rest = packed.where(f"NOT ({opened})"), packed.where(opened).select(*names)
        done.append(placed(kept, base))
        earlier = placed(packed.where(opened), base)
        before, closed = closed + bins, closed + kept.select("_group", "_bin").distinct().count()
        base, total = base + groups, rest.count()
        groups = -(-total // group)
    return reduce(DataFrame.unionByName, done)


def query(spark, folder: str) -> DataFrame:
    """Sequences of all documents."""
    from .common import read_table

    return pack(stored_table(pieces(read_table(spark, folder, "documents"))))
