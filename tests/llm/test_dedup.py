"""SimHash, vectors, components and lines against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tests.compare import compare, connect
from tests.llm.helpers import AWKWARD, components, cosine_links, docs, simhash
from tracelake.llm import embeddings, linededup, simhash as sh
from tracelake.llm.components import connected_components
from tracelake.llm.queries import ORACLES, QUERIES


def test_components_of_chains_hubs_and_noise(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 700)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(80)]
    links += [(7, 7), (None, 4), (4, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == components({n for x in real for n in x}, real)


def test_components_without_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_equals_definition():
    for text in ("", None, "Two words", "A b\tC d\x0bE  f\x0cg\rh", "É é stays É é", "a a a a a a a", "one word two three four"):
        assert sh.fingerprint(text) == simhash(text)


def test_runs_link_exactly_the_reachable():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (400, 4), dtype=np.uint64)
    fps = np.unique(base[draw.integers(0, 6, 400)] ^ np.bitwise_xor.reduce(flips, axis=1))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    got = sh.link_run(fps, sh.pivot_table(fps, sh.pivots()), 3)
    assert len(got) < len(fps)
    assert components(range(len(fps)), got) == components(range(len(fps)), links)
    for i in range(0, len(fps), 7):
        table = sh.pivot_table(fps, sh.pivots()).astype(int)
        for j in range(0, len(fps), 11):
            assert np.abs(table[i] - table[j]).max() <= int(fps[i] ^ fps[j]).bit_count()


@pytest.mark.parametrize("run_limit", [4096, 5])
def test_near_duplicates_of_a_table(spark, sf, run_limit):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    # a large group of near copies, dealt over several pieces when the limit is small
    rows += [(10_000 + i, " ".join(f"w{j}" if j != i else "edit" for j in range(300))) for i in range(60)]
    fps = {i: simhash(t) for i, t in rows}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3]
    got = sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), run_limit=run_limit).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == components(ids, links)


def test_near_duplicates_of_awkward_rows(spark):
    got = sh.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[9] == by_id[8] == by_id[7] == 7 and by_id[5] == 5
    assert sh.near_duplicates(docs(spark, AWKWARD[:0]) if False else spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_int8_bound_never_loses_a_pair():
    draw = np.random.default_rng(5)
    base = draw.normal(size=(40, 64))
    x = np.concatenate([base + draw.normal(scale=s, size=base.shape) for s in (0.1, 0.26, 0.28, 0.3, 0.5)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for scale in (1e-200, 1e200):
        a, b = embeddings.similar_pairs(x[:50] * scale, x[:50], 0.93)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(u[:50] @ u[:50].T >= 0.93)), strict=True))
    want = set(zip(*map(list, np.nonzero(u @ u.T >= 0.93)), strict=True))
    a, b = embeddings.similar_pairs(x, x, 0.93)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    q, s, e = embeddings.quantise(u)
    assert (np.abs(u @ u.T - (q.astype(int) @ q.T.astype(int)) * s[:, None] * s) <= e[:, None] + e + e[:, None] * e + 1e-12).all()


@pytest.mark.parametrize("tile", [2048, 7])
def test_vectors_against_brute_force(spark, tile):
    draw = np.random.default_rng(8)
    rows = [(i, (draw.normal(size=8) * 0.15 + np.eye(8)[i % 3]).tolist(), i % 2) for i in range(90)]
    rows += [(100 + i, rows[4][1], 0) for i in range(20)] + [(5, rows[5][1], 1), (200, [1.0, 2.0], 0), (201, [2.0, 4.0], 0)]
    odd = [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] * 8, 0), (304, rows[0][1], None), (None, rows[0][1], 0), (305, [float("inf")] * 8, 1), (306, [], 1)]
    links = cosine_links(rows)
    count = np.bincount([x for p in links for x in p], minlength=len(rows))
    comp = components({r[0] for r in rows}, [(rows[i][0], rows[j][0]) for i, j in links])
    table = spark.createDataFrame([(*r, "k") for r in rows + odd], "vec_id long, embedding array<float>, label int, kept string")
    got = embeddings.near_vectors(table, tile=tile).collect()
    want = sorted([(r[0], int(n), comp[r[0]], r[0] == comp[r[0]]) for r, n in zip(rows, count, strict=True)] + [(r[0], 0, r[0], r[0] is not None) for r in odd], key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert embeddings.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    ok, message = compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name])
    assert ok, message


def test_lines_of_awkward_rows(spark):
    out = linededup.dedup_lines(docs(spark, AWKWARD))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "th", "component_id", "n_lines", "n_dropped"]
    got = {}
    for r in out.collect():
        assert (r.score, r.th, r.component_id) == ("x", "y", -1)
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert got[3] == [("  SHARED line of text\t\nown words here are long", 2, 0)]
    assert got[5] == [("one two three four five six", 3, 2)] * 2
    assert got[6] == [("", 1, 1)] and got[8] == [("", 1, 0)] and got[7] == [("\n\n", 3, 0)]
    assert got[None] == [("shared line of text\nnobody", 2, 0)]
    assert linededup.dedup_lines(docs(spark, AWKWARD).limit(0)).count() == 0
    odd = docs(spark, AWKWARD).selectExpr("doc_id", "text", "'a' as words", "'b' as `lines`", "'c' as kept", "'d' as `dense`", "'e' as `a.b`", "'f' as N_LINES")
    assert {tuple(r)[2:7] for r in linededup.dedup_lines(odd).collect()} == {tuple("abcde")}
    bare = linededup.dedup_lines(docs(spark, AWKWARD).select("text", "doc_id"))
    assert bare.columns == ["text", "doc_id", "n_lines", "n_dropped"] and bare.count() == len(AWKWARD)


def test_a_hot_line_over_many_partitions(spark):
    rows = [(i, "\n".join(["the same long line"] * (1 + i % 3) + [f"own line number {i} {j}" for j in range(70)] + ["the same long line"])) for i in range(300)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    for i, text in rows:
        lines = text.split("\n")
        kept = lines if i == 0 else [x for x in lines if x != "the same long line"]
        assert got[i] == ("\n".join(kept), len(lines) - len(kept))
    assert hashlib.sha256(got[0][0].encode()).hexdigest() == hashlib.sha256(rows[0][1].encode()).hexdigest()
