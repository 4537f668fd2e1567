"""Near-duplicate vectors: int8 tile products with rigorous error bounds, then full precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .components import connected_components

TILE = 2048
#: Covers the rounding of the double-precision bound itself.
SLACK = 1e-9
VERIFY_AT_ONCE = 1 << 16


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and the exact residual norm of every unit vector."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1) * (1 + SLACK)


def similar_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two tiles of vectors whose cosine in double precision is at least ``threshold``.

    With u = s q + e for unit vectors, cos(u, v) differs from s t (q . p) by at most
    |e| + |f| + |e| |f|. Pairs that cannot reach the threshold within this bound are dropped; the rest
    are computed again from the vectors. The integer products are exact: int8 codes are multiplied as
    float32 while every sum stays below 2^24, as float64 for longer vectors.
    """
    # by the largest component first, so that no square overflows or vanishes
    units = [x / np.abs(x).max(axis=1, keepdims=True) for x in (left, right)]
    units = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in units]
    (q, s, e), (p, t, f) = (quantise(u) for u in units)
    kind = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    rows, cols = [], []
    step = 512
    for at in range(0, len(q), step):
        top = (q[at:at + step].astype(kind) @ p.astype(kind).T) * s[at:at + step, None] * t[None, :]
        bound = e[at:at + step, None] + f[None, :] + e[at:at + step, None] * f[None, :] + SLACK
        i, j = np.nonzero(top + bound >= threshold)
        for k in range(0, len(i), VERIFY_AT_ONCE):
            a, b = i[k:k + VERIFY_AT_ONCE] + at, j[k:k + VERIFY_AT_ONCE]
            ok = np.einsum("ij,ij->i", units[0][a], units[1][b]) >= threshold
            rows.append(a[ok])
            cols.append(b[ok])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def tile_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Weighted link counts and the component roots within one pair of tiles."""
    pdf = pdf.sort_values("rep", ignore_index=True)
    same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
    own = pdf["own"].to_numpy() == pdf["lo"].iloc[0]
    vectors = np.vstack(pdf["vec"].to_numpy()).astype(np.float64)
    left = np.flatnonzero(own)
    right = left if same else np.flatnonzero(~own)
    rep, weight = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
    if not len(left) or not len(right):
        return pd.DataFrame({"rep": rep[:0], "links": weight[:0], "root": rep[:0]})
    i, j = similar_pairs(vectors[left], vectors[right], threshold)
    a, b = left[i], right[j]
    if same:
        a, b = a[a < b], b[a < b]
    links = np.bincount(a, weight[b], len(rep)) + np.bincount(b, weight[a], len(rep))
    hit = links > 0
    root = forest(len(rep), a, b)
    return pd.DataFrame({"rep": rep[hit], "links": links[hit].astype(np.int64), "root": rep[root[hit]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors of equal label with cosine >= threshold.

    Exact copies are folded into one weighted vector. The vectors of a label are dealt into tiles of
    about ``tile`` rows; every two tiles meet in one task, which returns a link count and a component
    root per vector, never pairs. A hot label only has more tiles. Every pair of a label is covered.

    NULL, zero or non-finite vectors, NULL labels and NULL ids link with nothing and stand for
    themselves (a NULL id has component NULL and is not kept). Vectors of different length never
    link. Repeated rows count as separate vectors; one with a repeated id keeps the smallest id.
    """
    x = F.col("vec")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    keyed = rows.where(usable).select("vec_id", "vec", "label", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    key = ["label", "h1", "h2"]
    distinct = stored_table(keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
                            .withColumn("dims", F.size("vec")))
    counts = distinct.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = distinct.join(dimension(counts), ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("rep", "h1"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dims", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "copies", "vec")
    found = stored_table(met.groupBy("label", "dims", "lo", "hi").applyInPandas(lambda pdf: tile_links(pdf, threshold), "rep long, links long, root long"))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    nodes = distinct.select(*key, "rep", "copies").join(counted, "rep", "left").join(groups, "rep", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.select("vec_id", *key).join(nodes, key).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, folder: str) -> DataFrame:
    """Links and components of all embeddings."""
    from .common import read_table

    return near_vectors(read_table(spark, folder, "embeddings"))


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reached(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
components AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN components c ON c.x = e.vec_id"""
