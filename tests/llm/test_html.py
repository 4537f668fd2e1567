"""Extraction of pages whose tags or names mislead, against the known article."""

import random
import re
from collections import Counter

from tests.llm.test_text import page, text_of
from tracelake.llm import html


class Draw:
    def __init__(self, seed):
        self.draw = random.Random(seed)

    def words(self, n):
        return " ".join("".join(self.draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    def paragraphs(self):
        return [self.words(self.draw.randrange(14, 40)) for _ in range(self.draw.randrange(1, 4))]


def extracted(spark, rows):
    table = spark.createDataFrame([(i, u, h) for i, u, h in rows], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.main_text(table).collect()}


def built(seed, n, body, url="http://h.example/{}"):
    """Rows and wanted texts; ``body`` gives the markup around paragraphs."""
    draw, rows, want = Draw(seed), [], {}
    for i in range(n):
        title, paragraphs = draw.words(3), draw.paragraphs()
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, url.format(i), page(body(inner, draw))))
        want[i] = "\n".join([title, *paragraphs])
    return rows, want


MENU = "<div class=x1><a href=/>Start</a> <a href=/n>News of today</a></div>"
FOOT = "<div class=x4>All rights kept by us</div>"


def test_bodies_beside_a_teaser_article_are_kept(spark):
    rows, want = built(1, 30, lambda inner, d: f"{MENU}<div class=x2>{inner}</div><div class=x3><article><a href=/t>{d.words(13)}</a></article></div>{FOOT}")
    assert extracted(spark, rows) == want
    rows, want = built(2, 30, lambda inner, d: f"{MENU}<div class=x2>{inner}</div><article class=card><p>{d.words(13)}</p></article>{FOOT}")
    got = extracted(spark, rows)
    assert all(got[i].startswith(want[i]) for i in want)


def test_slots_decide_with_and_without_the_article_tag(spark):
    around = lambda tag: lambda inner, d: f"{MENU}<{tag} class=x2>{inner}</{tag}><div class=x3><a href=/a>{d.words(20)}</a></div>{FOOT}"
    for tag in ("article", "div"):
        rows, want = built(3, 30, around(tag))
        assert extracted(spark, rows) == want
    # one page of a host of article pages has its body in a plain div
    rows, want = built(4, 30, around("article"))
    rows[7] = (7, rows[7][1], rows[7][2].replace("article", "div"))
    assert extracted(spark, rows) == want


def test_shared_headings_of_articles_are_kept(spark):
    for tag in ("article", "div"):
        rows, want = built(5, 30, lambda inner, d, tag=tag: f"{MENU}<{tag} class=x2>{inner.replace('</h1>', '</h1><h2>Short summary</h2>')}</{tag}>{FOOT}")
        want = {i: t.replace("\n", "\nShort summary\n", 1) for i, t in want.items()}
        assert extracted(spark, rows) == want


def test_copies_of_a_page_are_one_page(spark):
    rows, want = built(6, 2, lambda inner, d: f"<div class=x2>{inner}</div><p>{d.words(3)}</p>")
    short = {i: re.search(r"<p>([a-h ]+)</p></body>", r[2])[1] for i, r in enumerate(rows)}
    copies = [(100 + k, f"http://h.example/c{k}", rows[0][2]) for k in range(30)]
    got = extracted(spark, rows + copies)
    assert all(got[i] == f"{want[0 if i >= 100 else i]}\n{short[0 if i >= 100 else i]}" for i in got)
    assert len(got) == 32
    three = extracted(spark, [(i, "http://h.example/", rows[0][2]) for i in range(3)])
    assert set(three.values()) == {f"{want[0]}\n{short[0]}"}


def test_layout_names_and_page_wide_forms_are_no_chrome():
    long, comment = "word " * 20, "other " * 15
    for start, end in (("<div id=content class='content right-sidebar'>", "</div>"), ("<article class='post comment-open'>", "</article>"), ("<form>", "</form>"), ("<form><div class=with-nav>", "</div></form>")):
        assert text_of(page(f"<nav>Menu</nav>{start}<p>{long}</p><div class=comments><p>short one</p></div>{end}")) == long.strip()
    for body in ("<body class='has-sidebar'>", "<body class=no-sidebar>", "<body id=with-nav>"):
        assert text_of(f"<html class=nav>{body}<p>{long}</p>") == long.strip()
    assert text_of(page(f"<article><p>{long}</p></article><form>Your mail</form><div class=sidebar><p>{comment}</p></div>")) == long.strip()
    assert text_of(page("<article><p>Short text</p></article><div class=promo>Buy</div>")) == "Short text"


def test_hosts_of_few_pages_have_their_own_template(spark):
    rows, want = [], {}
    for host, n in enumerate((3, 5, 19, 20)):
        name = "".join("abcdefghij"[host] * 4)
        body = lambda inner, d, name=name: f"<div class={name}1><a href=/>Start {name}</a></div><div class={name}2>{inner}</div><div class={name}4>Some notice by {name} here</div>"
        some, texts = built(10 + host, n, body, f"http://{name}.example/{{}}")
        rows += [(1000 * host + i, u, h) for i, u, h in some]
        want |= {1000 * host + i: t for i, t in texts.items()}
    assert extracted(spark, rows) == want


def test_threads_and_boxes_longer_than_the_article_are_left_out(spark):
    """What is named as comments, related or sidebar goes however long it is; so does a column beside the article."""
    thread = lambda d, name: f"<div class='{name}'>{''.join(f'<p>{d.words(40)}</p>' for _ in range(10))}</div>"
    kinds = [("article", "comments"), ("div", "comments"), ("div", "comment-list replies"), ("article", "sidebar"), ("div", "sidebar"), ("article", "col2")]
    for seed, (tag, name) in enumerate(kinds):
        rows, want = built(20 + seed, 30, lambda inner, d, tag=tag, name=name: f"{MENU}<{tag} class=x2>{inner}</{tag}>{thread(d, name)}{FOOT}")
        assert extracted(spark, rows) == want, (tag, name)
    draw, rows, want = Draw(40), [], {}
    for i in range(30):
        want[i] = draw.words(15)
        rows.append((i, f"http://h.example/{i}", page(f"{MENU}<div class=x2><p>{want[i]}</p></div>{thread(draw, 'related')}{FOOT}")))
    assert extracted(spark, rows) == want


def test_threads_inside_the_article_and_in_front_of_it():
    long, thread = "word " * 20, "<p>" + "other " * 200 + "</p>"
    for body in (f"<article><h1>T</h1><p>{long}</p><div class=comments>{thread}<article>{thread}</article></div></article>",
                 f"<div class=sidebar>{thread}</div><main><h1>T</h1><p>{long}</p></main>", f"<div class=ads>{thread}</div><div><h1>T</h1><p>{long}</p></div>"):
        assert text_of(page(body)) == f"T\n{long.strip()}"


def test_classes_equal_a_plain_deduction(spark):
    draw = random.Random(7)
    rows = []
    for i in range(200):
        host = draw.randrange(12) ** 2 // 12
        parts = [f"<div class=c{k}><a>t{k} u{k}</a></div>" * draw.choice((1, 1, 1, 2)) for k in range(6) if k < 3 or draw.random() < 0.7]
        rows.append((host, page(f"<div class=h{host}>{''.join(parts)}<p>{draw.choice('xyz')}</p></div>")))
    groups, classes = html.equivalence_classes(html.distinct_contents(spark.createDataFrame(rows, "host long, html string")))
    of = {r.host: r.group for r in groups.collect()}
    got = {(r.group, r.once, frozenset(r.tokens)) for r in classes.collect()}
    pages = {}
    for host, text in set(rows):
        pages.setdefault(of[host], []).append(text)
    assert set(of.values()) > {0}
    want = set()
    for group, texts in pages.items():
        counts = [Counter(html._signed(t) for t, _, _ in html.page_tokens(html.events(x))) for x in texts]
        vectors = {}
        for token in {t for c in counts for t in c if t}:
            vectors.setdefault(tuple(c[token] for c in counts), set()).add(token)
        for vector, tokens in vectors.items():
            n, once = sum(v > 0 for v in vector), set(vector) == {1}
            if n >= max(3, len(texts) * html.MIN_SHARE) and (once or len(tokens) >= html.MIN_TOKENS):
                want.add((group, once, frozenset(tokens)))
    assert got == want
