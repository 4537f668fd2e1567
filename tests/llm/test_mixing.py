"""Apportionment, mixing, packing and the pipeline."""

import heapq
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import AWKWARD, components, docs, simhash
from tests.llm.test_text import ids
from tracelake.llm import mixing, packing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        out = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def seats(weights, n):
    got = dict.fromkeys(weights, 0)
    heap = [(-w, k) for k, w in weights.items() if w > 0]
    heapq.heapify(heap)
    for _ in range(n if heap else 0):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def test_apportionment_is_sainte_lague(spark):
    draw = random.Random(7)
    rows, want = [], {}
    for g in range(25):
        n = draw.randrange(1, 30)
        weights = {k: draw.choice((0.0, draw.random(), draw.random() * 100)) for k in range(n)}
        total = draw.randrange(0, 400)
        rows += [(g, k, w, total) for k, w in weights.items()]
        want |= {(g, k): s for k, s in seats(weights, total).items()}
    got = mixing.apportion(spark.createDataFrame(rows, "g int, k int, w double, n long"), "k", "w", "n", "g").collect()
    assert {(r.g, r.k): r.quota for r in got} == want


def check_mix(rows, plan):
    sizes = Counter()
    for i, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    taken = Counter()
    for r in plan:
        assert r.target == pytest.approx(want[r.src], rel=1e-9, abs=1e-6) and r.source_size == sizes[r.src]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.src] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * mixing.BLOCK + 0.02 * want[s], s


def test_mix_of_a_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix(table).collect()
    check_mix([(r.doc_id, r.text, r.lang, r.source) for r in table.collect()], plan)
    again = mixing.mix(table.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in plan) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_with_a_hot_source_and_many_shards(spark):
    draw = random.Random(9)
    rows = [(i, "w " * draw.randrange(0, 90), "en", "hot" if i % 3 else draw.choice("abc")) for i in range(900)] + [(10_000, "z", "en", "tiny"), (10_001, "", "en", "zero")]
    plan = mixing.mix(docs(spark, rows), shard=2000).collect()
    check_mix(rows, plan)
    written = mixing.mixed_documents(docs(spark, rows), shard=2000)
    words = Counter()
    for r in written.collect():
        words[r.source] += len(r.text.split())
    want = {r.src: r.target for r in plan}
    assert written.columns == docs(spark, rows).columns
    assert all(abs(words[s] - want[s]) <= 60 + 0.06 * want[s] for s in ("hot", "a", "b", "c"))


def test_mix_of_awkward_rows(spark):
    plan = mixing.mix(docs(spark, AWKWARD)).collect()
    assert len(plan) == len(AWKWARD)
    check_mix(AWKWARD, plan)
    assert all(r.taken == 0 for r in plan if not r.size) and all(r.taken <= 3 * r.size for r in plan)
    assert mixing.mix(docs(spark, AWKWARD).limit(0)).count() == 0


def test_bounds_and_best_fit():
    draw = np.random.default_rng(11)
    for capacity, high in ((10, 10), (50, 26), (100, 60), (100, 100)):
        for n in (1, 7, 40, 300):
            lengths = draw.integers(1, high + 1, n)
            bins, offsets, left = packing.best_fit(lengths, capacity)
            used = np.bincount(bins, lengths)
            assert (used <= capacity).all() and (capacity - used == left).all()
            for b in range(len(left)):
                mine = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
                assert [o for o, _ in mine] == np.cumsum([0] + [x for _, x in mine])[:-1].tolist()
            bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            assert -(-lengths.sum() // capacity) <= bound <= len(left)
    # volume says 2, but no two of these share a bin
    assert packing.lower_bound(np.bincount([51, 51, 51], minlength=101), 100) == 3


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("group", [20_000, 40])
def test_packing_near_the_bound(spark, group):
    draw = np.random.default_rng(12)
    lengths = np.minimum(draw.lognormal(3.2, 0.8, 900).astype(int) + 1, 100).tolist()
    table = spark.createDataFrame(
        [(i % 50, 0, n, "k", "l", "m") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, bin string, room string, offset string").repartition(4)
    packed = packing.pack(table, capacity=100, group=group)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "piece", "length", "bin", "room", "offset", "sequence_id", "group_bins", "group_bound"] and {(r.bin, r.room) for r in rows} == {("k", "l")}
    assert Counter(r.length for r in rows) == Counter(lengths)
    assert all(r.group_bound <= r.group_bins for r in rows) and {r.group_bins for r in rows if r.length == 100} <= {1}
    if group > 900:
        # one group packed all items that do not fill a sequence: its certificate is that of the result
        assert {(r.group_bins, r.group_bound) for r in rows if r.length < 100} == {(len({r.sequence_id for r in rows if r.length < 100}), packing.lower_bound(np.bincount([n for n in lengths if n < 100], minlength=101), 100))}
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert check_packing(rows, 100) <= bound + 1 + 0.01 * bound


def test_pieces_of_awkward_rows(spark):
    import zlib

    rows = packing.pieces(docs(spark, AWKWARD), capacity=64).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, text, _, _ in AWKWARD:
        if i == 5:
            continue
        want = np.array(ids(text or "") + [1], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, 64 * k, min(64, len(want) - 64 * k)) for k in range(-(-len(want) // 64))]
        assert all(r.ids_crc32 == zlib.crc32(want[r.start:r.start + r.length].tobytes()) for r in got)
    assert len(by_doc[5]) == 2
    check_packing(packing.pack(packing.pieces(docs(spark, AWKWARD), capacity=64), capacity=64).collect(), 64)
    assert packing.pack(packing.pieces(docs(spark, AWKWARD[:1]).limit(0))).count() == 0


def test_pipeline_stage_by_stage(spark, sf):
    """Every stage against brute force on its own input."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    names = table.columns
    quality, lines, copies, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    good = quality(spark, table, sf)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    judged = [i for i in label if label[i] in (0, 1)]
    assert good.columns == names and sum((i in kept) == (label[i] == 1) for i in judged) >= 0.95 * len(judged)

    good = good.cache()
    cut = lines(spark, good, sf)
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        for x in r.text.split("\n"):
            first.setdefault(x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), r.doc_id)
    for r, s in zip(*(sorted(t.collect(), key=lambda r: r.doc_id) for t in (good, cut)), strict=True):
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        assert s.text == "\n".join(x for x in r.text.split("\n") if len(key(x)) < 10 or first[key(x)] == r.doc_id) and s.n_chars == len(s.text)

    cut = cut.cache()
    fps = {r.doc_id: simhash(r.text) for r in cut.collect()}
    order = sorted(fps)
    comp = components(order, [(a, b) for k, a in enumerate(order) for b in order[:k] if (fps[a] ^ fps[b]).bit_count() <= 3])
    single = copies(spark, cut, sf).cache()
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == [i for i in order if comp[i] == i]

    mixed = mix(spark, single, sf).cache()
    words, size = Counter(), Counter()
    for r in single.collect():
        size[r.source] += len(r.text.split())
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert mixed.columns == names and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    want = targets(size)
    assert abs(sum(words.values()) - sum(want.values())) <= 0.1 * sum(want.values())
    rows = pack(spark, mixed, sf).collect()
    check_packing(rows, packing.CAPACITY)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    assert sum(r.length for r in rows) == sum(len(ids(r.text)) + 1 for r in mixed.select(F.coalesce("text", F.lit("")).alias("text")).collect())


def test_stages_keep_columns_of_any_name(spark, sf):
    added = {"score": "a", "predicted": "b", "words": "c", "n_lines": "d", "th": "e", "fp": "f", "component_id": "g", "taken": "h", "shard": "i", "_rest": "j", "_row": "k"}
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumns({k: F.lit(v) for k, v in added.items()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf).cache()
        assert out.columns == table.columns and [tuple(r) for r in out.select(*added).distinct().collect()] == [tuple(added.values())]
        table = out
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() >= table.count() > 0


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
