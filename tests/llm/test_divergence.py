"""Source divergence against a plain count over all documents."""

import re
from collections import Counter

import pytest

from tests.llm.helpers import AWKWARD, docs
from tracelake.llm import divergence


def lowered(term):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)


def found_terms(text):
    return [lowered(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, threshold, top=50):
    rows = [(t or "", lang or "", src or "") for _, t, lang, src in rows]
    held = Counter((lang, t) for text, lang, _ in rows for t in set(found_terms(text)))
    kept = {}
    for (lang, t), n in held.items():
        if n >= threshold:
            kept.setdefault(lang, set()).add(t)
    counts = {}
    for text, lang, src in rows:
        counts.setdefault((lang, src), Counter()).update(t for t in found_terms(text) if t in kept.get(lang, ()))
    out = {}

    def p(count, t, v):
        return 1 + 10**9 * (count[t] + 5) // (sum(count.values()) + 5 * v)

    for (lang, src), own in counts.items():
        terms = kept.get(lang, set())
        whole = sum((c for (x, _), c in counts.items() if x == lang), Counter())
        pairs = [(-sum(abs(p(own, t, len(terms)) - p(c, t, len(terms))) for t in terms), o.encode()) for (x, o), c in counts.items() if x == lang and o != src]
        above = [(p(whole, t, len(terms)) - p(own, t, len(terms)), t.encode()) for t in terms if own[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(x for x in above if x[0] < 0)[:top])):
            out |= {(lang, src, part, i): (item.decode(), -value) for i, (value, item) in enumerate(items, 1)}
    return out


def answers(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = df.collect()
    got = {(r.lang, r.source, r.part, r["rank"]): (r.item, r.value) for r in rows}
    assert len(got) == len(rows)
    return got


ROWS = AWKWARD + [
    (100 + i, f"Common words éèÉ{'x' * (i % 3)} straße Straße internationalisation{'s' * (i % 2)} tok{i % 4}end a{chr(1)}b_c\x7fd only{i}", "en" if i % 3 else "fr", f"s{i % 5}") for i in range(40)] + [
    (200 + i, "antidisestablishmentarianism and pneumonoultramicroscopicsilicovolcanoconiosis 東京都 " * (1 + i % 2), "de", "s1" if i % 2 else None) for i in range(6)]


@pytest.mark.parametrize("threshold, first", [(1, 4), (3, 1), (5, 64)])
def test_against_a_plain_count(spark, threshold, first):
    rows = [(i, t if len(t or "") < 100_000 else t[:400], lang, src) for i, t, lang, src in ROWS]
    table = docs(spark, rows)
    kept = {(r.lang, bytes(r.term).decode()) for r in divergence.frequent_terms(table.selectExpr("coalesce(lang, '') AS lang", "coalesce(text, '') AS text"), threshold, first).collect()}
    held = Counter((lang or "", t) for _, text, lang, _ in rows for t in set(found_terms(text)))
    assert kept == {k for k, n in held.items() if n >= threshold}
    assert answers(divergence.source_divergence(table, threshold)) == brute(rows, threshold)


def test_blocks_of_sources_and_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 7)
    odd = docs(spark, ROWS).selectExpr("text", "lang", "source", "1 AS `a.b`", "2 AS TEXT", "3 AS term", "4 AS value", "5 AS part")
    assert answers(divergence.source_divergence(odd, 2, 3)) == brute(ROWS, 2, 3)


def test_languages_without_terms_and_empty_tables(spark):
    got = answers(divergence.source_divergence(docs(spark, ROWS), 1000))
    assert {v for _, v in got.values()} == {0} and {k[2] for k in got} == {"pair"}
    assert got == brute(ROWS, 1000)
    assert divergence.source_divergence(docs(spark, [])).count() == 0


def test_units_cut_between_rows_only(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "UNIT", 10)
    texts = ["", "aa bb", "c" * 35, "", "Dd", "e f g h", "é"]
    batch = pa.record_batch([pa.array(texts)], names=["text"]).slice(1)
    out = []
    for unit in divergence.units([batch]):
        row, code, terms = divergence.terms_of(unit["text"])
        out += [(unit["text"][int(r)].as_py(), terms[int(c)].as_py().decode()) for r, c in zip(row, code, strict=True)]
    assert out == [(t, lowered(w)) for t in texts[1:] for w in found_terms(t)]
