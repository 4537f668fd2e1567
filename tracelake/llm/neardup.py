"""Near-duplicates by 5-word shingles: pairs of Jaccard similarity 0.8 or more, found without loss and verified exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .common import partitions, picked, slices
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
#: Words of a fingerprint. 256 bits tell 0.8 (39 bits apart, deviation 6) from unrelated texts (128, deviation 8), which 64 bits do not.
PARTS = 4
#: 5.8 deviations above the distance of the least favourable pair of similarity 0.8, four shingles out of five (48 bits, deviation 6.2).
RADIUS = 84
#: Rows of a run whose distances to all others discard pairs; a run of fewer rows than twice that compares outright.
PIVOTS = 8
RUN_LIMIT = 4096
SHINGLES_AT_ONCE = 1 << 16


def shingle_set(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle, one without words has none."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set, PARTS words of 64 bits; each word mixes the hashes anew."""
    out = np.zeros(PARTS, np.uint64)
    for k in range(PARTS):
        sums = np.zeros(64, np.int64)
        for at in range(0, len(hashes), SHINGLES_AT_ONCE):
            h = hashes[at:at + SHINGLES_AT_ONCE] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(sums * 2 > len(hashes)).view(np.uint64)[0]
    return out


def prefix_size(n: int, similarity: float) -> int:
    """So many smallest hashes of a set of n meet those of any set that is similar enough."""
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def set_rows(docs: DataFrame, words: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """(doc_id, node, size, fp0..., prefix): ``node`` names the shingle set."""
    names = ["doc_id", "node", "size", *(f"fp{k}" for k in range(PARTS)), "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
            fps = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, PARTS).view(np.int64)
            firsts = [s[:prefix_size(len(s), similarity)].view(np.int64) for s in sets]
            yield pa.record_batch([
                part.column(0), pa.array(np.array([set_name(s) for s in sets], np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array(fps[:, k]) for k in range(PARTS)), pa.array(firsts, pa.list_(pa.int64()))], names)

    kinds = ", ".join(f"fp{k} long" for k in range(PARTS))
    return picked(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, node long, size long, {kinds}, prefix array<long>")


def set_name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def spanning_links(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which ``near`` gives those of some rows that are next to a row."""
    alive = np.ones(n, bool)
    links = []
    for root in range(n):
        if not alive[root]:
            continue
        alive[root] = False
        todo = [root]
        while todo:
            rest = np.flatnonzero(alive)
            if not len(rest):
                return links
            found = near(todo.pop(), rest)
            alive[found] = False
            todo.extend(found.tolist())
            links.extend((root, y) for y in found.tolist())
    return links


def pivot_table(fps: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Hamming distance of every fingerprint to ``n`` of them, one row per fingerprint.

    At this radius random references discard nothing, as all fingerprints are about 128 bits away. Rows of the run do: a
    near copy of one is 39 bits from it, any other text about 128.
    """
    refs = fps[np.linspace(0, len(fps) - 1, n).astype(int)]
    return np.stack([np.bitwise_count(fps ^ ref).sum(axis=1, dtype=np.int16) for ref in refs], axis=1)


def close_fingerprints(columns: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of rows (size, fp0...) that can be similar by their sizes and fingerprints.

    By the triangle inequality, rows within the radius differ by no more than it in their distance to any pivot.
    """
    size, fps = columns[0], np.stack([c.view(np.uint64) for c in columns[1:]], axis=1)
    table = pivot_table(fps) if len(fps) >= 2 * PIVOTS else None

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        fit = np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]) - 1e-9
        rest = rest[fit]
        if table is not None:
            rest = rest[np.abs(table[rest] - table[x]).max(axis=1, initial=0) <= RADIUS]
        return rest[np.bitwise_count(fps[rest] ^ fps[x]).sum(axis=1, dtype=np.int64) <= RADIUS]

    return spanning_links(len(size), near)


def similar_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of sets whose Jaccard similarity is large enough, by exact overlaps."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(hashes, sets[x]), np.searchsorted(hashes, sets[x], "right")
        both = np.zeros(len(sets), np.int64)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            both[owner[a:b]] += 1  # a set has a hash once
        return rest[both[rest] >= similarity * (size[rest] + size[x] - both[rest]) - 1e-9]

    return spanning_links(len(sets), near)


def linked_runs(rows: DataFrame, key: str, link: Callable[[list], list[tuple[int, int]]], run_limit: int) -> DataFrame:
    """Links (a, b) of the rows (node, key, ...) that have a key in common; ``link`` gets the other columns of a run.

    A run of more than ``run_limit`` rows is dealt into pieces of that size and every two pieces meet in
    a task of their own. Links are those of a spanning forest.
    """
    others = [c for c in rows.columns if c not in ("node", key)]
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > run_limit)
    hot = dimension(sizes.select(key, F.ceil(F.col("_n") / run_limit).cast("int").alias("_pieces")))
    own = F.pmod(F.xxhash64("node"), F.col("_pieces")).cast("int")
    met = rows.join(hot, key, "left").withColumn(
        "_other", F.explode(F.when(F.col("_pieces").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_pieces") - 1))))
    met = met.select(key, F.coalesce(F.least(own, "_other"), F.lit(0)).alias("_lo"), F.coalesce(F.greatest(own, "_other"), F.lit(0)).alias("_hi"), "node", *others)

    def solve(run: list[np.ndarray]) -> list[tuple[int, int]]:
        node = run[0]
        return [(int(node[i]), int(node[j])) for i, j in link(run[1:])] if len(node) > 1 else []

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], ["a", "b"])

        held: list[np.ndarray] | None = None
        for part in slices(batches, 2048):
            now = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            if not len(held[0]):
                continue
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[:3]], axis=0)) + 1
            ends = change.tolist()
            found = []
            for s, e in zip([0, *ends], ends, strict=False):
                found += solve([x[s:e] for x in held[3:]])
            if ends:
                held = [x[ends[-1]:] for x in held]
            yield batch(found)
        if held and len(held[0]):
            yield batch(solve(held[3:]))

    run_key = [key, "_lo", "_hi"]
    return met.repartition(partitions(rows.sparkSession), *run_key).sortWithinPartitions(*run_key).mapInArrow(links, "a long, b long")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """The rows (key, node) whose key another row has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, node, whether a row before has the key
        for batch in batches:
            key, node = (c.to_numpy() for c in batch.columns)
            if last is not None:
                key, node = np.append(last[0], key), np.append(last[1], node)
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            keep = np.append(same, False) | np.append(last is not None and last[2], same)
            yield pa.record_batch([pa.array(key[:-1][keep[:-1]]), pa.array(node[:-1][keep[:-1]])], ["key", "node"])
            last = key[-1], node[-1], bool(keep[-1])
        if last is not None and last[2]:
            yield pa.record_batch([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["key", "node"])

    return rows.select("key", "node").repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "key long, node long")


def similar_documents(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, run_limit: int = RUN_LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row; component_id is the smallest doc_id reachable by links.

    Rows are linked if the sets of their word shingles have a Jaccard similarity of at least
    ``similarity``. The smallest hashes of two such sets, as many as ``prefix_size`` says, have one in
    common, so documents meet by those. Documents that meet and whose sizes and wide fingerprints allow it
    are candidates; components of candidates are verified by the exact similarity of their texts. Equal
    sets are one node, also the empty one. Rows without doc_id link nothing.
    """
    made = stored_table(set_rows(docs, words, similarity, doc_id, text))
    fps = [f"fp{k}" for k in range(PARTS)]
    nodes = stored_table(made.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", *fps, "prefix")]))
    shared = stored_table(repeated_keys(nodes.select("node", F.explode("prefix").alias("key"))))
    met = shared.join(nodes.select("node", "size", *fps), "node")
    maybe = connected_components(linked_runs(met, "key", lambda run: close_fingerprints(run, similarity), run_limit))
    wanted = dimension(maybe.withColumnRenamed("component", "key").join(nodes.select("node", "rep"), "node"))
    texts = picked(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text")).join(wanted, "rep").select("node", "key", "text")

    def verified(run: list[np.ndarray]) -> list[tuple[int, int]]:
        return similar_sets([shingle_set(t, words) for t in run[0]], similarity)

    # rows of one id with other texts than the node's are left out
    @F.pandas_udf("long")
    def name_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: set_name(shingle_set(t, words)))

    texts = texts.where(name_of("text") == F.col("node"))
    groups = connected_components(linked_runs(texts, "key", verified, run_limit))
    labels = nodes.join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("label"))
    least = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    return made.select("doc_id", "node").join(labels.join(least, "label").select("node", "component_id"), "node", "left").select("doc_id", "component_id")
