"""Near-duplicates of the pipeline against exact Jaccard similarities."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import AWKWARD, components, docs, simhash
from tracelake.llm import neardup


def shingles(text, words=5):
    found = (text or "").lower().split()
    return {" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted():
    """Originals of several lengths with copies of several similarities, and texts that share a passage only."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = []
    passage = [word() for _ in range(60)]
    for i in range(60):
        text = [word() for _ in range(draw.choice((6, 9, 30, 120, 400)))]
        rows.append((10 * i, text))
        for j in range(1, 4):
            copy = list(text)
            for at in draw.sample(range(len(copy)), max(1, len(copy) // draw.choice((20, 40, 60, 100)))):
                copy[at] = word()
            rows.append((10 * i + j, copy))
        rows.append((10 * i + 5, passage + [word() for _ in range(80)]))
    rows += [(5000 + i, [f"w{j}" if j != i else "edit" for j in range(300)]) for i in range(60)]
    return [(i, " ".join(t)) for i, t in rows]


@pytest.mark.parametrize("run_limit", [4096, 7])
def test_every_pair_of_similarity_is_linked(spark, run_limit):
    rows = planted()
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if jaccard(sets[a], sets[b]) >= 0.8]
    assert sum(1 for a, b in links if a < 5000) >= 40
    got = neardup.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), run_limit=run_limit).collect()
    assert {r.doc_id: r.component_id for r in got} == components(ids, links)


def test_stage_drops_copies_beyond_three_bits_and_keeps_clean_texts(spark, sf):
    rows = [(i, t) for i, t in planted() if i < 5000]
    sets, texts = {i: shingles(t) for i, t in rows}, dict(rows)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if jaccard(sets[a], sets[b]) >= 0.8]
    assert sum((simhash(texts[a]) ^ simhash(texts[b])).bit_count() > 3 for a, b in links) > len(links) / 2
    comp = components(ids, links)
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, [(i, t, "en", "s") for i, t in rows]), sf)
    assert sorted(r.doc_id for r in got.collect()) == [i for i in ids if comp[i] == i]


def test_similar_documents_of_awkward_rows(spark):
    got = neardup.similar_documents(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[9] == by_id[8] == by_id[7] == 7 and by_id[5] == 5 and by_id[None] is None
    twice = spark.createDataFrame([(1, "a b c d e f g"), (1, "some other text of that id"), (2, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in neardup.similar_documents(twice).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert neardup.similar_documents(twice.limit(0)).count() == 0


def test_wide_fingerprints_of_the_least_favourable_sets():
    draw = np.random.default_rng(4)
    apart = []
    for n in (5, 10, 50, 400):
        for _ in range(100):
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            apart.append(int(np.bitwise_count(neardup.wide_fingerprint(a) ^ neardup.wide_fingerprint(a[:-(n // 5)])).sum()))
    assert max(apart) <= neardup.RADIUS


def test_pivots_of_the_run_discard_texts_that_are_not_near_and_lose_no_link():
    draw = np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(6)]
    sets = [np.append(s[draw.random(200) < 0.97], draw.integers(0, 1 << 63, 2, dtype=np.uint64)) for s in sets for _ in range(8)]
    fps = np.array([neardup.wide_fingerprint(s) for s in sets])
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=np.int64)
    table = neardup.pivot_table(fps)
    kept = np.abs(table[:, None] - table[None]).max(axis=2) <= neardup.RADIUS
    assert kept[apart <= neardup.RADIUS].all()
    unlike = apart > neardup.RADIUS
    assert kept[unlike].sum() < unlike.sum() / 2
    links = neardup.close_fingerprints([np.array([len(s) for s in sets]), *(fps[:, k].copy().view(np.int64) for k in range(neardup.PARTS))], 0.8)
    assert components(range(48), links) == components(range(48), [(i, j) for i in range(48) for j in range(i) if i // 8 == j // 8])
