"""Extraction, tokens, classifiers and fingerprints."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs
from tracelake.llm import html, langid, quality, tokens, winnow
from tracelake.llm.vocab import library, word_ids

NAME = tokens.VOCABULARY


def ids(text):
    return library(NAME).encode(text, add_special_tokens=False).ids


def decoded(raw):
    return np.frombuffer(raw, "<u4").tolist()


LATIN = [chr(c) for c in range(1, 256)]
TEXTS = ["", " ", "it's we'll THEY'RE i'm 'D x'd", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "İstanbul ΣΑΣ ǅ ﬁ", "é ẖ H̱", "".join(LATIN), " ".join(LATIN), " a　b​ c", "\x1cA\x1dB\x85C\xa0D", "東京 🙂🙂!! 12 ½²", "Long" * 30 + " a " + "Long" * 30, "Σ" * 70 + " b " + "Σ" * 70]


@pytest.mark.parametrize("text", TEXTS)
def test_word_ids_equal_the_library(text):
    assert decoded(word_ids(NAME).encode(text)) == ids(text)


def test_word_ids_of_random_texts():
    draw = random.Random(4)
    for _ in range(300):
        pool = draw.choice((LATIN, LATIN + ["Σ", "İ", "́", "🙂", "<|endoftext|>"], list("abcABC'strdml12 \n!?é")))
        text = "".join(draw.choice(pool) for _ in range(draw.randrange(60)))
        assert decoded(word_ids(NAME).encode(text)) == ids(text)


def test_splices_equal_one_call():
    draw = random.Random(6)
    words = ["The", "of", "anné", "x" * 90, "it's", "12345", "🙂", "ΑΣ", "!!", "\n", "é", "<|endoftext|>"]
    for chunk, overlap in ((64, 16), (200, 40), (37, 5)):
        for _ in range(12):
            text = draw.choice((" ", "  ", "")).join(draw.choice(words) for _ in range(draw.randrange(1, 200)))
            assert tokens.spliced_ids(text, library(NAME), chunk, overlap).tolist() == ids(text)
    for text in ("a" * 900, "ab " * 400, "!?" * 300 + " end"):
        assert tokens.spliced_ids(text, library(NAME), 64, 16).tolist() == ids(text)


def test_splicing_without_blanks():
    draw = random.Random(12)
    parts = ["ab1,x", "3.14", "x=y", "it's", "!!'s", "<|endoftext|>", "<|endoftext|", "|>9", "é́a", "東京、都。", "a≠b", "=\u0338", "Q7", "''re", "word", "ΑΣ,", "½1", "_z", "İ!", "1\u20e3"]
    for chunk, overlap in ((24, 4), (64, 16), (200, 32)):
        for _ in range(60):
            text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 200)))
            assert tokens.spliced_ids(text, library(NAME), chunk, overlap).tolist() == ids(text)


def test_texts_without_blanks_take_linear_time():
    import time

    def seconds(text):
        start = time.perf_counter()
        assert len(tokens.text_ids(text)) // 4 == len(ids(text))
        return time.perf_counter() - start

    for part in ("ab1,x", "function(a){return(a)}"):
        seconds(part * 1000)
        small, large = seconds(part * (300_000 // len(part))), seconds(part * (2_400_000 // len(part)))
        assert large < 25 * small


def test_token_counts_of_a_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs(spark, AWKWARD).select("doc_id", "text"))
    got = tokens.with_token_counts(table.withColumn("n_tokens", F.lit("clash"))).collect()
    assert all(r.n_tokens == len(ids(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)
    assert len(got) == table.count() and tokens.with_token_counts(table.limit(0)).count() == 0


def test_language_of_held_out_rows(spark):
    rows = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    learned = docs(spark, [(i, t, x, "s") for i, (t, x) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 5)])
    model = langid.learn_languages(learned)
    got = {r.doc_id: r for r in langid.with_language(docs(spark, AWKWARD), model).collect()}
    assert [got[i].lang_pred for i in (9, 8, 7, 4)] == ["und"] * 4 and got[9].score == 0
    assert got[1].lang_pred in ("en", "de") and got[10].lang_pred in ("en", "de")
    none = langid.learn_languages(learned.where("false"))
    assert none is None and {r.lang_pred for r in langid.with_language(learned, none).collect()} == {"und"}
    one = langid.learn_languages(learned.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in langid.with_language(learned, one).collect()} == {("de", 1.0)}
    assert langid.with_language(learned.limit(0), model).count() == 0


@pytest.mark.parametrize("k", range(1, 41))
def test_codewords_differ(k):
    code = langid.codewords(k)
    assert len(code) == k and len({tuple(r) for r in code}) == k
    assert all(len(set(c)) == 2 for c in code.T)


def test_positions_keep_the_match_guarantee(spark):
    """Any shared passage of K + WINDOW - 1 code points holds a selected k-gram at its place in both texts."""
    draw, long = random.Random(8), winnow.K + winnow.WINDOW - 1
    rows = []
    for i in range(20):
        passage = "".join(draw.choice("abcdefgh ") for _ in range(long))
        rows += [(2 * i + k, "".join(draw.choice("xyz ") for _ in range(draw.randrange(90))) + passage + "tail" * k, passage) for k in (0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, passage string")
    places = {r.doc_id: r.positions for r in winnow.compare_with_next(table).collect()}
    inside = {i: {p - text.index(passage) for p in places[i] if 0 <= p - text.index(passage) <= winnow.WINDOW - 1} for i, text, passage in rows}
    assert all(inside[2 * i] & inside[2 * i + 1] for i in range(20))
    own = {r.doc_id: [tuple(x) for x in r.selected] for r in winnow.with_fingerprints(table.withColumn("selected", F.lit(1))).collect()}
    assert {i: [p for _, p in s] for i, s in own.items()} == places
    empty = winnow.with_fingerprints(docs(spark, AWKWARD)).where("coalesce(text, '') = ''").collect()
    assert len(empty) == 2 and all(r.selected == [] for r in empty)


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_awkward_rows(spark):
    learned = docs(spark, [(i, "good plain words here" if i % 2 else "BAD!! BAD!! BAD!! BAD!!", "en", "s") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn_quality(learned, labels)
    assert {(r.doc_id % 2, r.predicted) for r in quality.with_quality(learned, model).collect()} == {(0, 0), (1, 1)}
    got = {r.doc_id: r.score for r in quality.with_quality(docs(spark, AWKWARD), model).collect()}
    assert got[9] == got[8] and all(0 <= s <= 1 for s in got.values())
    none = quality.learn_quality(learned, labels.where("false"))
    assert none is None and {r.score for r in quality.with_quality(learned, none).collect()} == {0.5}
    only = quality.learn_quality(learned, labels.where("quality = 1"))
    assert {r.predicted for r in quality.with_quality(learned, only).collect()} == {1}


def brute_winnow(text, k, window):
    h = winnow.rolling_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k).tolist()
    out = set()
    for i in range(max(1, len(h) - window + 1)):
        part = h[i:i + window]
        out.add(i + max(j for j, x in enumerate(part) if x == min(part)))
    return sorted(out)


def test_winnowing_picks_rightmost_minima(monkeypatch):
    draw = random.Random(2)
    for n in (12, 13, 30, 51, 52, 200, 700):
        text = "".join(draw.choice("ab é") for _ in range(n))
        h, p = winnow.winnow(text)
        assert p.tolist() == brute_winnow(text, winnow.K, winnow.WINDOW)
        monkeypatch.setattr(winnow, "PART", 150)
        h2, p2 = winnow.winnow(text)
        assert p2.tolist() == p.tolist() and h2.tolist() == h.tolist()
        monkeypatch.undo()
    assert winnow.winnow("")[0].size == 0 and winnow.winnow("ab")[1].tolist() == [0]


def test_shared_passages_share_a_hash():
    draw = random.Random(3)
    for _ in range(30):
        passage = "".join(draw.choice("abcdefgh ") for _ in range(winnow.K + winnow.WINDOW - 1))
        a, b = ("".join(draw.choice("xyz") for _ in range(draw.randrange(80))) + passage + "".join(draw.choice("uvw") for _ in range(50)) for _ in range(2))
        assert set(winnow.winnow(a)[0].tolist()) & set(winnow.winnow(b)[0].tolist())


def test_fingerprints_of_neighbours(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs(spark, AWKWARD).select("doc_id", "text"))
    rows = sorted(((-(1 << 63) if r[0] is None else r[0]), r[1] or "", r[0]) for r in table.collect())
    want = []
    for i, (_, text, doc) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        changed = winnow.edited(text, after)
        a, b, c = (winnow.digest(winnow.winnow(t)[0]) for t in (text, changed, after))
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, winnow.likeness(a, b), winnow.likeness(a, c), winnow.winnow(text)[1].tolist()))
    got = [tuple(r) for r in winnow.compare_with_next(table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert winnow.compare_with_next(table.limit(0)).count() == 0
    (only,) = winnow.compare_with_next(spark.createDataFrame([(1, "just one text of some length to compare", "c")], "doc_id long, text string, part string")).collect()
    assert only.near_next == 1.0


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def text_of(markup):
    return html.extract(markup, frozenset(), frozenset(), frozenset())


def test_extraction_of_markup():
    long = "word " * 20
    assert text_of(page("<nav><a href=x>Home</a></nav><article><h1>T&amp;t</h1><p><b>A  b\n c<br>d<p>e &lt;f&gt; &quot;g&#39;</p><div class='ad'>Buy</div><script>var a='</p>';</script></article><footer>&copy; x")) == "T&t\nA b c d\ne <f> \"g'"
    assert text_of(page(f"<header>H</header><main><p>{long}</p><form><p>mail</p></form><section id=comments><p>nice</p></section></main><aside>x</aside>")) == long.strip()
    assert text_of("<p>a<!-- <p>no</p> -->b<style>p{}</style></p>c < d &amp e&amp") == "ab\nc < d & e&"
    assert text_of("<div class='cookie-notice'>ok</div><div hidden>h</div><ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == "one\ntwo\nx\ny"
    assert text_of(None) == text_of("") == text_of("<html><head><title>x</title></head></html>") == ""
    assert text_of("<head><meta charset=utf-8><p>no body tag</p>") == "no body tag"
    assert text_of('<p title="a > b">in</p><p data-x=\'>\'>out</p>tail<p') == "in\nout\ntail"


def test_template_of_pages_without_roles(spark):
    """Menus, link lists and fixed lines are told apart by the pages alone."""
    draw = random.Random(5)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        paragraphs = [words(draw.randrange(14, 40)) for _ in range(draw.randrange(1, 4))]
        title = words(3)
        menu = "<div class=x1><a href=/>Start</a> <a href=/n>News of today</a></div>"
        see = "".join(f"<a href=/{j}>{words(15)}</a> " for j in range(3))
        rows.append((i, f"http://h.example/{i}", page(f"{menu}<div class=x2><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class=x3>{see}</div><div class=x4>All rights kept by us</div>"), "c"))
        want[i] = "\n".join([title, *paragraphs])
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(table).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_extraction_of_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "nonsense", "<p>x</p>"), (3, "http://a/b", "<p>" + "long text " * 50_000), (3, "http://a/b", "<p>twice"), (4, "//A:80/c", "plain text only")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 5), (3, 499_999), (4, 15)]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
