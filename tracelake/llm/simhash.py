"""SimHash fingerprints and near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .common import partitions, picked, slices
from .components import connected_components

SHINGLES_AT_ONCE = 1 << 16
PIVOTS = 24


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
        n = len(found) - words + 1
    sums = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        size = min(SHINGLES_AT_ONCE, n - at)
        raw = b"".join([xxhash.xxh64_digest(next(shingles), seed) for _ in range(size)])
        sums += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(size, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long. NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(t, words, seed) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return picked(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def pivots(n: int = PIVOTS, seed: int = 42) -> np.ndarray:
    """Reference fingerprints: seeded random words."""
    return np.frombuffer(np.random.default_rng(seed).bytes(8 * n), np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference, one row per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def link_run(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links fingerprints within ``radius`` bits.

    By the triangle inequality two fingerprints within ``radius`` differ by no more than that in their
    distance to any reference. Rows are sorted by the first coordinate; a visited row looks at the
    unvisited rows of its window, drops those whose largest coordinate difference is too big and
    verifies the survivors bit by bit. Only the links that reach a new row are returned.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0]
    alive = np.ones(len(fps), bool)
    links = []
    for root in range(len(fps)):
        if not alive[root]:
            continue
        alive[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            lo, hi = np.searchsorted(first, first[x] - radius), np.searchsorted(first, first[x] + radius, "right")
            near = lo + np.flatnonzero(alive[lo:hi])
            near = near[np.abs(table[near] - table[x]).max(axis=1, initial=0) <= radius]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            alive[near] = False
            todo.extend(near.tolist())
            links.extend((int(order[root]), int(order[y])) for y in near)
    return links


def link_pairs(distinct: DataFrame, radius: int = 3, blocks: int | None = None, run_limit: int = 4096, n_pivots: int = PIVOTS, seed: int = 42) -> DataFrame:
    """Edges (a, b) between representatives whose fingerprints differ in at most ``radius`` bits.

    ``distinct`` has (rep, fp), one row per fingerprint. The 64 bits are cut into ``blocks`` blocks
    (radius + 2 if None); two fingerprints within ``radius`` agree on at least ``blocks - radius`` of them, so rows meet
    under every choice of that many blocks. Rows that meet are compared through their pivot tables.
    A run of more than ``run_limit`` rows is dealt into pieces of that size and every two pieces meet
    in a task of their own, so no task holds an unbounded run and no pair is lost. The edges keep the
    components of the full link graph; not every link is listed.
    """
    spark = distinct.sparkSession
    blocks = blocks or radius + 2
    bounds = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [sum(((1 << int(bounds[i + 1] - bounds[i])) - 1) << int(bounds[i]) for i in chosen)
             for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = distinct.select("rep", "fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("way", "mask")).select(
        "rep", "fp", F.col("way").cast("short").alias("way"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = dealt.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run_limit)
    hot = dimension(sizes.select("way", "key", F.ceil(F.col("n") / run_limit).cast("int").alias("pieces")))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    met = dealt.join(hot, ["way", "key"], "left").withColumn(
        "other", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))))
    met = met.select("rep", "fp", "way", "key", F.coalesce(F.least(own, "other"), F.lit(0)).alias("lo"), F.coalesce(F.greatest(own, "other"), F.lit(0)).alias("hi"))
    run_key = ["way", "key", "lo", "hi"]
    refs = pivots(n_pivots, seed)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
            """Runs are complete here: five aligned columns sorted by key."""
            rep, fp, *keys = rows
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(rep)]])
            a, b = [], []
            many = np.flatnonzero(ends - starts > 1)
            for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                values = fp[s:e].view(np.uint64)
                for i, j in link_run(values, pivot_table(values, refs), radius):
                    a.append(rep[s + i])
                    b.append(rep[s + j])
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            if not len(held[0]):
                continue
            open_run = np.all([k == k[-1] for k in held[2:]], axis=0)
            cut = len(open_run) - int(np.argmin(open_run[::-1])) if not open_run.all() else 0
            if cut:
                yield solve([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield solve(held)

    return met.repartition(partitions(spark), *run_key).sortWithinPartitions(*run_key).mapInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, run_limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id reachable. NULL and empty texts have fingerprint 0 and are linked like any other. Equal
    fingerprints are one node, so a group of copies costs one row. A NULL doc_id takes part under the
    ids of its equals; if none has an id, its component_id is NULL. An empty table gives no row.
    """
    fps = stored_table(fingerprints(docs, words, doc_id=doc_id, text=text))
    nodes = stored_table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = connected_components(link_pairs(nodes.where("rep IS NOT NULL").select("rep", "fp"), radius, run_limit=run_limit))
    named = nodes.join(groups, nodes.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, folder: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    from .common import read_table

    out = near_duplicates(read_table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
