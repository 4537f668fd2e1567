"""Nearest vectors by inner product: vantage-point trees per shard, pruning relaxed by a factor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .common import finite_vectors, read_table

#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS = 8192
QUERY_ROWS = 8192
LEAF = 64
EPS = float(np.finfo(np.float64).eps)
#: Least and largest angle from a vantage point to its inner and to its outer half.
BOUNDS = ("inner_least", "inner_most", "outer_least", "outer_most")
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def on_sphere(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows scaled by the longest one, with one more component that puts each on the unit sphere.

    The inner product of a unit query (last component 0) with such a row is its inner product with
    the vector divided by both lengths, so the smallest angle is the largest inner product.
    """
    top = np.abs(vectors).max()
    scaled = vectors / top
    longest = np.linalg.norm(scaled, axis=1).max()
    unit = scaled / longest
    rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", unit, unit), 0.0))
    return np.column_stack([unit, rest]), top * longest


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b, -1.0, 1.0))


def split_points(start: int, end: int, leaf: int) -> int | None:
    """Where the outer half of node [start, end) begins; None for a leaf. Place ``start`` is its vantage point."""
    return None if end - start <= leaf else start + 1 + (end - start - 1) // 2


def grown(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points in the tree and, for vantage points, the least and largest angle to either half."""
    order = np.arange(len(points))
    bounds = np.full((len(points), 4), np.nan)
    todo = [(0, len(points))]
    while todo:
        start, end = todo.pop()
        middle = split_points(start, end, leaf)
        if middle is None:
            continue
        part = order[start:end]
        # far from an arbitrary member: points at the rim tell the others apart better
        pick = int(np.argmin(points[part] @ points[part[0]]))
        part[[0, pick]] = part[[pick, 0]]
        away = angles(points[part[1:]], points[part[0]])
        ranked = np.argsort(away, kind="stable")
        part[1:] = part[1:][ranked]
        away = away[ranked]
        half = middle - start - 1
        bounds[start] = away[0], away[half - 1], away[half], away[-1]
        todo += [(start + 1, middle), (middle, end)]
    return order, bounds


def shadowed(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that no list of k can need: k + 1 smaller ids of the shard have the same vector."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.lexsort((ids, group))
    first = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1])
    sizes = np.diff(np.append(first, len(ids)))
    place = np.arange(len(ids)) - np.repeat(first, sizes)
    out = np.zeros(len(ids), bool)
    out[order] = place > k
    return out


def matrix(table: pa.Table, column: str, dims: int) -> np.ndarray:
    flat = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(table.num_rows, dims)


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed from the first component to the last: equal vectors tie exactly."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j] * right[:, j]
    return total


class Best:
    """The k best candidates of every query so far, by product and then smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.own, self.vectors, self.ids, self.k = queries, own, vectors, ids, k
        self.floor = np.full(len(queries), -np.inf)
        self.forget()

    def forget(self) -> None:
        self.score = np.full((len(self.queries), self.k), -np.inf)
        self.place = np.full((len(self.queries), self.k), -1)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """Score that a candidate must reach."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, places: np.ndarray) -> None:
        """Candidate pairs of query row and place; pairs of one query stand together."""
        keep = self.own[rows] != self.ids[places]
        rows, places = rows[keep], places[keep]
        if not len(rows):
            return
        score = exact_products(self.queries[rows], self.vectors[places])
        touched, start, count = np.unique(rows, return_index=True, return_counts=True)
        width = self.k + int(count.max())
        scores, spots = np.full((len(touched), width), -np.inf), np.full((len(touched), width), -1)
        scores[:, :self.k], spots[:, :self.k] = self.score[touched], self.place[touched]
        at = np.arange(len(rows)) - np.repeat(start, count) + self.k
        line = np.repeat(np.arange(len(touched)), count)
        scores[line, at], spots[line, at] = score, places
        named = np.where(spots < 0, np.iinfo(np.int64).max, self.ids[spots])
        order = np.lexsort((named, -scores), axis=1)[:, :self.k]
        self.score[touched] = np.take_along_axis(scores, order, 1)
        self.place[touched] = np.take_along_axis(spots, order, 1)


def searched(index: pa.Table, queries: pa.Table, dims: int, k: int, factor: float, leaf: int, seen: list | None = None) -> pa.Table:
    """The k best rows of one shard for one block of queries.

    Every query first descends to one leaf, which gives it a k-th best angle. Then the nodes are
    visited with the queries that still need them: one is skipped where ``factor`` times the least
    angle the triangle inequality allows exceeds that angle. Products of leaves are filtered in one
    matrix product with room for its rounding and computed again one by one.
    """
    index = index.filter(pc.is_valid(index["place"])).sort_by("place")
    if not index.num_rows or not queries.num_rows:
        return FOUND.empty_table()
    vectors, ids = matrix(index, "vec", dims), index["vec_id"].to_numpy()
    asked, own = matrix(queries, "vec", dims), queries["vec_id"].to_numpy()
    points, length = on_sphere(vectors)
    top = np.abs(asked).max(axis=1, keepdims=True)
    unit = asked / top
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    whole = np.linalg.norm(asked / top, axis=1) * top[:, 0] * length
    unit = np.column_stack([unit, np.zeros(len(unit))])
    bounds = np.column_stack([index[c].to_numpy(zero_copy_only=False) for c in BOUNDS]).astype(np.float64)
    best = Best(asked, own, vectors, ids, k)
    loose, room = 8 * (dims + 8) * EPS, 4 * np.sqrt((dims + 8) * EPS)

    def reach(rows: np.ndarray) -> np.ndarray:
        """Angle beyond which a point cannot be among the k best of these queries."""
        with np.errstate(invalid="ignore"):
            return np.arccos(np.clip(best.least(rows) / whole[rows] - loose, -1.0, 1.0)) + room

    def leaf_visit(rows: np.ndarray, start: int, end: int) -> None:
        products = unit[rows] @ points[start:end].T
        line, at = np.nonzero(products >= (best.least(rows) / whole[rows] - loose)[:, None])
        best.offer(rows[line], at + start)

    def descend(rows: np.ndarray, start: int, end: int) -> None:
        while len(rows):
            middle = split_points(start, end, leaf)
            if middle is None:
                return leaf_visit(rows, start, end)
            away = angles(unit[rows], points[start])
            inside = away <= (bounds[start, 1] + bounds[start, 2]) / 2
            descend(rows[inside], start + 1, middle)
            rows, start = rows[~inside], middle

    def visit(rows: np.ndarray, least: np.ndarray, start: int, end: int) -> None:
        wanted = factor * least <= reach(rows)
        rows, least = rows[wanted], least[wanted]
        if not len(rows):
            return
        if seen is not None:
            seen.append(len(rows) * (1 if split_points(start, end, leaf) is not None else end - start))
        middle = split_points(start, end, leaf)
        if middle is None:
            return leaf_visit(rows, start, end)
        away = angles(unit[rows], points[start])
        best.offer(rows, np.full(len(rows), start))
        near, far, near_out, far_out = bounds[start]
        for (a, b), (lo, hi) in (((start + 1, middle), (near, far)), ((middle, end), (near_out, far_out))):
            visit(rows, np.maximum(least, np.maximum(np.maximum(lo - away, away - hi) - room, 0.0)), a, b)

    everyone = np.arange(len(asked))
    descend(everyone, 0, len(ids))
    # what the descent found is found again: only its k-th score stays, as a floor
    best.floor = best.score[:, -1].copy()
    best.forget()
    visit(everyone, np.zeros(len(asked)), 0, len(ids))
    line, at = np.nonzero(best.place >= 0)
    place = best.place[line, at]
    return pa.table([pa.array(own[line]), pa.array(ids[place]), pa.array(best.score[line, at])], schema=FOUND)


def tree_rows(shard: pa.Table, dims: int, k: int, leaf: int) -> pa.Table:
    """The rows of a shard with their place in its tree and the bounds of the vantage points."""
    ids = shard["vec_id"].to_numpy()
    # by id and content, so that a repeated run grows the same tree
    vectors = matrix(shard, "vec", dims)
    order = np.lexsort((*vectors.T[::-1], ids))
    shard, vectors, ids = shard.take(pa.array(order)), vectors[order], ids[order]
    hidden = shadowed(vectors, ids, k)
    kept = np.flatnonzero(~hidden)
    kept = kept[np.random.default_rng(len(ids)).permutation(len(kept))]
    inside, bounds = grown(on_sphere(vectors[kept])[0], leaf)
    tree = shard.take(pa.array(kept[inside]))
    columns = [pa.array(np.arange(len(inside), dtype=np.int32)), *[pa.array(bounds[:, i], from_pandas=True) for i in range(4)]]
    for name, column in zip(["place", *BOUNDS], columns, strict=True):
        tree = tree.append_column(name, column)
    rest = shard.take(pa.array(np.flatnonzero(hidden)))
    return pa.concat_tables([tree, *([rest] if rest.num_rows else [])], promote_options="default")


def build_index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The index: one row per distinct (vec_id, vector) with its shard, its place in the shard's tree and bounds.

    Rows are dealt to shards of about ``shard_rows`` by hash, so a vector or label that fills a third of
    the table fills a third of every shard. Of more than k + 1 equal vectors in a shard only those with
    the smallest ids have a place; the others stay in the index without one, because no list of k
    needs them. NULL vectors or ids, zero vectors and vectors with NULL or non-finite components
    take no part; rows that repeat id and vector are one; vectors of each length have trees of their own.
    """
    rows = finite_vectors(vectors, vec_id, embedding).where(F.col("vec_id").isNotNull() & F.exists("vec", lambda v: v != 0)).distinct().withColumn("dims", F.size("vec"))
    rows = stored_table(rows)
    sizes = dimension(rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")))
    dealt = rows.join(sizes, "dims").withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), "shards").cast("int"))
    kind = rows.schema["vec"].dataType.simpleString()
    schema = f"vec_id long, vec {kind}, dims int, shards int, shard int, place int, " + ", ".join(f"{c} double" for c in BOUNDS)

    def grow(shard: pa.Table) -> pa.Table:
        return tree_rows(shard, shard["dims"][0].as_py(), k, leaf)

    return stored_table(dealt.select("vec_id", "vec", "dims", "shards", "shard").groupBy("dims", "shard").applyInArrow(grow, schema))


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, leaf: int = LEAF, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the index with the largest inner product with every query.

    ``queries`` has (vec_id, vec). Rows of the query's own id are no candidates; a repeated id asks once, with its
    smallest vector. Blocks of about ``query_rows`` queries meet every shard of their length in a task of its own, which
    returns k rows a query. Ties go to the smaller id. ``k`` and ``leaf`` are at most and exactly those of the index.

    A node is skipped where ``factor`` times the least possible angle exceeds the k-th best angle so far:
    1 finds exactly the nearest; with a larger factor fewer nodes are visited, and every row that is missed is at
    more than 1/factor of the angle of the k-th row returned.
    """
    asked = stored_table(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dims", F.size("vec")))
    shards = index.groupBy("dims").agg(F.max("shards").alias("shards"))
    blocks = asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
    grid = dimension(shards.join(blocks, "dims"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.select("vec_id", "vec", "dims", "shard", "place", *BOUNDS).join(grid, "dims").withColumn("block", every("blocks"))
    right = asked.join(grid, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("shard", every("shards"))
    cell = ["dims", "shard", "block"]

    def search(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        return searched(shard, block, key[0].as_py(), k, factor, leaf)

    found = left.drop("shards", "blocks").groupBy(*cell).cogroup(right.drop("shards", "blocks").groupBy(*cell)).applyInArrow(
        search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, folder: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20, found exactly."""
    index = build_index(read_table(spark, folder, "embeddings"))
    return nearest(index, index.where("vec_id % 20 = 0"))


ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
asked AS (SELECT vec_id, min(e) AS e FROM usable WHERE vec_id % 20 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM asked q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""
