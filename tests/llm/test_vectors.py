"""Vantage-point trees and resident Lloyd codes against brute force."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import lloyd, vptree

SCHEMA = "vec_id long, embedding array<float>, label int, `a.b` string, VEC_ID string, rank int, part string"


def table(spark, rows):
    """Vectors beside columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, v, y, "x", "y", 3, "z") for i, v, y in rows], SCHEMA)


def clustered(n, dims, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, dims))
    x = centres[draw.integers(0, 8, n)] + draw.normal(scale=0.05, size=(n, dims))
    return (x * draw.uniform(0.2, 3.0, size=(n, 1))).astype(np.float32)


ODD = [(900, None, 0), (920, [0.0] * 8, 0), (940, [float("nan")] * 8, 1), (960, [None] * 8, 0), (980, [float("inf")] * 8, 1), (1000, [], None), (None, [1.0] * 8, 2)]


def brute_nearest(rows, k):
    usable = {(i, tuple(np.float32(v).astype(float))) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        own = min(v for i, v in usable if i == q)
        scored = []
        for i, v in usable:
            if i != q and len(v) == len(own):
                s = 0.0
                for a, b in zip(own, v, strict=True):
                    s += a * b
                scored.append((-s, i))
        out |= {(q, r): (i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def answers(df):
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return got


@pytest.mark.parametrize("shard_rows, query_rows", [(8192, 8192), (90, 5)])
def test_nearest_against_brute_force(spark, shard_rows, query_rows):
    x = clustered(400, 8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    # a hot vector with ties, repeated rows, a repeated id, other lengths
    rows += [(2000 + i, x[5].tolist(), 0) for i in range(200)] + [(40, x[40].tolist(), 0)] * 30 + [(60, x[7].tolist(), 0)]
    rows += [(3000 + 20 * i, [1.0 + i, 2.0, -1.0], 1) for i in range(4)] + ODD
    index = vptree.build_index(table(spark, rows), k=6, shard_rows=shard_rows, leaf=8)
    got = answers(vptree.nearest(index, index.where("vec_id % 20 = 0"), k=6, leaf=8, query_rows=query_rows))
    assert got == brute_nearest(rows, 6)
    assert index.count() == len({(i, tuple(v)) for i, v, _ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})


def test_nearest_of_empty_and_lonely_tables(spark):
    for rows in ([], ODD, [(20, [1.0, 0.0], 0)]):
        index = vptree.build_index(table(spark, rows))
        assert vptree.nearest(index, index.where("vec_id % 20 = 0")).count() == 0
    few = vptree.build_index(table(spark, [(20, [1.0, 0.0], 0), (21, [-3.0, 0.0], 0), (1, [-3.0, 0.0], 0)]))
    assert answers(vptree.nearest(few, few.where("vec_id = 20"))) == {(20, 1): (1, -3.0), (20, 2): (21, -3.0)}


def one_shard(x, leaf, k=20):
    rows = pa.table({"vec_id": np.arange(len(x)), "vec": pa.array(x.tolist(), pa.list_(pa.float32()))})
    return vptree.tree_rows(rows, x.shape[1], k, leaf), rows.take(pa.array(range(0, len(x), 10)))


@pytest.mark.parametrize("factor", [1.0, 1.5, 3.0])
def test_factor_one_is_exact_and_others_keep_their_bound(factor):
    x = clustered(1500, 6, 9)
    tree, asked = one_shard(x, 16)
    seen = []
    found = vptree.searched(tree, asked, 6, 20, factor, 16, seen)
    got = {}
    for q, i, s in zip(*(found[c].to_pylist() for c in found.column_names), strict=True):
        got.setdefault(q, []).append((s, i))
    d = x.astype(float)
    longest = np.linalg.norm(d, axis=1).max()
    hits = 0
    for q, pairs in got.items():
        score = d @ d[q]
        score[q] = -np.inf
        best = set(np.argsort(-score, kind="stable")[:20].tolist())
        hits += len(best & {i for _, i in pairs})
        angle = np.arccos(np.clip(score / longest / np.linalg.norm(d[q]), -1, 1))
        last = max(angle[i] for _, i in pairs)
        assert all(angle[i] * factor >= last - 1e-6 for i in best - {i for _, i in pairs})
    assert factor > 1.0 or hits == 20 * len(got)
    # clustered vectors are pruned, without loss at factor 1
    assert sum(seen) < 0.6 * len(asked) * len(x)


def test_numbers_of_any_size():
    for scale in (1e-30, 1e30):
        x = (clustered(200, 5, 4) * np.float32(scale)).astype(np.float32)
        tree, asked = one_shard(x, 8, 3)
        found = vptree.searched(tree, asked, 5, 3, 1.0, 8)
        d = x.astype(float)
        for q, i in zip(found["query_id"].to_pylist(), found["vec_id"].to_pylist(), strict=True):
            score = d @ d[q]
            score[q] = -np.inf
            assert score[i] >= np.sort(score)[-3] - 1e-12 * abs(score[np.isfinite(score)]).max()


def brute_codes(rows, rounds=4):
    """code, error, label_error and digest per vector length, with Python integers."""
    out = []
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], [float(np.float32(x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for dims in {len(v) for _, v, _, _ in kept}:
        own = sorted([k for k in kept if len(k[1]) == dims], key=lambda k: (k[0] is None, k[0] or 0, k[2]))
        cut = lloyd.cuts(dims)
        books = [[v[c] for _, v, _, _ in own[:256]] for c in cut]

        def best(part, book):
            return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), n) for n, e in enumerate(book))

        for _ in range(rounds):
            for p, c in enumerate(cut):
                groups = {}
                for _, v, _, _ in own:
                    groups.setdefault(best(v[c], books[p])[1], []).append(v[c])
                for e, parts in groups.items():
                    books[p][e] = [sum(col) // len(parts) for col in zip(*parts, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, _, y in own:
            found = [best(v[c], b) for c, b in zip(cut, books, strict=True)]
            out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), y, sha))
    totals = {}
    for _, _, e, y, _ in out:
        totals[y] = totals.get(y, 0) + e
    top = (1 << 63) - 1
    return sorted(((i, c, min(e, top), min(totals[y], top), s) for i, c, e, y, s in out), key=str)


def codes(df):
    assert df.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_codes_against_brute_force(spark):
    x = clustered(330, 8, 5)
    rows = [(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)]
    rows += [(5, x[5].tolist(), 1)] * 3 + [(7, x[8].tolist(), 2), (2000, x[0].tolist(), 0)] + [(3000 + i, x[9].tolist(), 0) for i in range(60)]
    rows += ODD + [(4000, [0.5] * 7, 1), (4001, [0.25, 0.1, 3.0, -2.0, 0.0, 0.5, 1.0], 1), (4002, [9.0], 4)]
    assert codes(lloyd.vector_codes(table(spark, rows))) == brute_codes(rows)


def test_codes_of_huge_components_and_empty_tables(spark):
    rows = [(i, [float(i) * 1e7, -3e6 * i, 2e6, float(i)], 0) for i in range(20)] + [(i, [1.5e8 * i, 1.0, 1.0, 1.0], 1) for i in range(300, 330)]
    assert codes(lloyd.vector_codes(table(spark, rows))) == brute_codes(rows)
    assert lloyd.vector_codes(table(spark, [])).count() == 0
    assert lloyd.vector_codes(table(spark, [(1, None, 0), (2, [None], 0)])).count() == 0
    # beyond 2^62 integers are set to it, and errors to the largest long
    assert {r.error >= 0 for r in lloyd.vector_codes(table(spark, [(i, [3e38 * (-1) ** i, 1.0, 2.0, 3.0], 0) for i in range(300)])).collect()} == {True}


def test_members_move_only_when_their_entry_changes(spark):
    """Residents stay in their partition: what a round ships is what changed its entry."""
    draw = np.random.default_rng(2)
    part = draw.integers(-1000, 1000, (500, 4))
    book = draw.integers(-1000, 1000, (16, 4))
    entry = lloyd.nearest_entry(part, book)[0]
    batch = lloyd.member_batch(np.zeros(500, int), entry, np.zeros(500, int), lloyd.packed(part, "<i2"))
    shifted = book.copy()
    shifted[3] += 400
    (out,) = lloyd.moved(iter([batch]), [shifted], "<i2")
    now = lloyd.nearest_entry(part, shifted)[0]
    assert out["now"].to_pylist() == now.tolist() and 0 < (now != entry).sum() < 250
    (sums,) = [pa.Table.from_batches(list(lloyd.resident_sums(iter([batch]), "<i2"))).to_pandas()]
    for e, own in sums.groupby("entry"):
        have = part[entry == e]
        assert [(int(h) << 31) + int(lo) for h, lo in zip(own.high, own.low, strict=True)] == have.sum(axis=0).tolist() and set(own.n) == {len(have)}
