"""Main text of web pages by deducing the template that pages of one host share.

Tokens of a page are its opening tags, told apart by their path, and the words of short text nodes. Tokens
with the same occurrence vector over the pages of a host form an equivalence class; large and frequent
classes whose tokens keep their order and their place on every page make up the template. The text
between template tokens fills slots, and the slots that hold the article are extracted.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .common import extended, picked, slices

#: Text nodes of more words are data; their words are no tokens.
SHORT = 12
#: Hosts with fewer distinct pages are pooled; three that agree tell template from data.
FEW_PAGES = 3
#: A class needs this share of the host's pages and this many tokens.
MIN_SHARE = 0.5
MIN_TOKENS = 3
#: Share of the pages from which on a constant text counts as template, also inside the article.
CONSTANT = 0.9
MASK = (1 << 64) - 1
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
#: Groups whose templates are broadcast; more are joined by a shuffle. A template holds few kilobytes.
FEW_TEMPLATES = 5_000

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta script style title noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title|svg|select"
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Elements that never hold article text, and class or id words of elements that do not unless most of the page's text is inside.
CHROME = frozenset("head nav header footer aside button script style noscript template select textarea iframe svg dialog menu".split())
CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|login|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notices?|overlay|pagination|popup|promo\w*|related|replies|reply|share|sharing|sidebar|signup|social|"
    r"sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])", re.I)
#: Names that tell what an element has around it, not what it is: right-sidebar, with-nav, comment-open.
LAYOUT = re.compile(r"(?:has|have|no|with|without|left|right|one|two|show|hide)[-_](?:\w+)|(?:comments?|replies|reply|sidebar)[-_](?:open|closed|on|off|enabled|disabled|left|right|none)", re.I)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
MAIN = frozenset(("article", "main"))
#: Elements that hold a piece of an article, not the whole.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th".split())

LEXER = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-z][^\s/>]*+(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-z][^>]*>|<[!?/][^>]*>|</?[a-z][^<>]*\Z", re.I | re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@lru_cache(1 << 14)
def _read_tag(tag: str) -> tuple[str, bool, int, str, bool]:
    """Name, whether it closes, whether it is chrome (2 for certain, 1 by a name or as a form), the name with its first class or id, whether it is the article."""
    closing = tag.startswith("</")
    name = re.match(r"</?([^\s/>]+)", tag)[1].lower()
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(tag)} if not closing and " " in tag else {}
    words = f"{found.get('class', '')} {found.get('id', '')}".split()
    named_by = [w for w in words if CHROME_WORDS.search(w)]
    # beside other names, one that describes the layout says nothing about the element
    told = [w for w in named_by if not LAYOUT.fullmatch(w)] if len(named_by) < len(words) else named_by
    role = found.get("role", "").lower()
    certain = name in CHROME or role in CHROME_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    mark = re.sub(r"\d{3,}", "0", (found.get("class") or found.get("id") or "").split(" ")[0])
    main = name in MAIN or role == "main" or found.get("itemprop", "").lower() == "articlebody"
    named = name == "form" or role == "form" or bool(told)
    chrome = 2 if certain else int(named and not main and name not in ("html", "body"))
    return name, closing, chrome, f"{name}.{mark}" if mark else name, main


class Doubt:
    """An element that looks like chrome by its class, id or as a form; ``on`` as long as it does not hold the article."""

    __slots__ = ("key", "on", "text", "headed", "mains")

    def __init__(self, key: int) -> None:
        self.key, self.on, self.text, self.headed, self.mains = key, True, False, False, 0


class Node:
    """An open element."""

    __slots__ = ("name", "path", "certain", "doubts", "main", "starts", "link", "box")

    def __init__(self, name: str, path: str, certain: bool, doubts: tuple[Doubt, ...], main: bool, starts: bool, link: bool, box: str) -> None:
        self.name, self.path, self.certain, self.doubts, self.main, self.starts, self.link, self.box = name, path, certain, doubts, main, starts, link, box

    @property
    def chrome(self) -> bool:
        return self.certain or any(d.on for d in self.doubts)


ROOT = Node("", "", False, (), False, False, False, "")


def events(page: str) -> Iterator[tuple]:
    """("open", node), ("text", node, text) and ("break",) in page order.

    Elements are closed as the standard says for paragraphs, list items and table cells; an end tag
    without its start is ignored, unclosed elements end with the one around them, and raw text
    elements, comments and declarations are skipped.
    """
    stack = [ROOT]
    at = 0
    for m in LEXER.finditer(page):
        if m.start() > at:
            yield "text", stack[-1], page[at:m.start()]
        at = m.end()
        tag = m[0]
        if tag.startswith(("<!", "<?")):
            continue
        if m[1]:
            if m[1].lower() not in INLINE:
                yield ("break",)
            continue
        if not tag[1].isalpha() and not (tag[1] == "/" and tag[2:3].isalpha()):
            continue
        name, closing, chrome, mark, main = _read_tag(tag)
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if name in INLINE and stack[i].name not in INLINE:
                    break
            if name not in INLINE:
                yield ("break",)
            continue
        if stack[-1].name == "head" and name not in HEAD_ONLY:
            stack.pop()
        if name not in INLINE:
            yield ("break",)
            close = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in close:
                    del stack[i:]
                    break
                if stack[i].name not in INLINE and stack[i].name not in close:
                    break
        top = stack[-1]
        path = f"{top.path}>{mark}"
        node = Node(name, path, top.certain or chrome == 2, (*top.doubts, Doubt(_signed(_hash(path)))) if chrome == 1 else top.doubts, top.main or main, main and not top.main, top.link or name == "a",
                    top.box if name in INLINE or name in BLOCKS else path)
        yield "open", node
        if name == "br":
            yield "text", top, " "
        if name not in VOID:
            stack.append(node)
    if at < len(page):
        yield "text", stack[-1], page[at:]


def judged(page: str, chromes: frozenset = frozenset(), cleared: frozenset = frozenset()) -> list[tuple]:
    """The events of a page, with its doubtful elements judged by what they hold and where they sit, never by size.

    What most pages of the group say of an element's path comes first. Else it holds the article, and is no chrome, if
    it has a heading (h1) and text; or all article and main elements of a page without text outside doubtful elements; or the first
    text of such a page, if neither heading nor article lies outside it. Text is that of long nodes, or of all where none is long.
    """
    found = list(events(page))
    texts = [e[1] for e in found if e[0] == "text" and not e[1].certain and not e[1].link and len(e[2].split()) > SHORT]
    texts = texts or [e[1] for e in found if e[0] == "text" and not e[1].certain and not e[1].link and e[2].strip()]
    doubts = {d for e in found if e[0] == "open" for d in e[1].doubts}
    if not doubts:
        return found
    plain = any(not n.doubts for n in texts)
    first = texts[0].doubts if texts and not plain else ()
    headings = [e[1] for e in found if e[0] == "open" and e[1].name == "h1" and not e[1].certain]
    mains = [e[1] for e in found if e[0] == "open" and e[1].starts and not e[1].certain]
    for n in texts:
        for d in n.doubts:
            d.text = True
    for n in headings:
        for d in n.doubts:
            d.headed = True
    for n in mains:
        for d in n.doubts:
            d.mains += 1
    for d in doubts:
        holds = d.headed and d.text or not plain and d.mains == len(mains) > 0 or (
            d in first and d.mains == len(mains) and all(d in n.doubts or n.doubts for n in headings))
        d.on = d.key in chromes or d.key not in cleared and not holds
    return found


def in_article(found: list[tuple]) -> bool:
    """Whether article or main elements hold the article: the first heading, or the first text after it, or of a page without heading."""
    shown = [e for e in found if e[0] != "break" and not e[1].chrome and not e[1].link]
    start = next((i for i, e in enumerate(shown) if e[0] == "open" and e[1].name == "h1"), None)
    if start is not None and shown[start][1].main:
        return True
    texts = [e for e in shown[start or 0:] if e[0] == "text" and e[2].strip() and e[1].name != "h1" and not e[1].path.startswith(">html>head")]
    return next((e[1].main for e in texts if len(e[2].split()) > SHORT), next((e[1].main for e in texts), False))


@lru_cache(1 << 14)
def around(path: str) -> tuple[int, ...]:
    """Hashes of the paths of an element and all around it, outermost first."""
    names = path.split(">")
    return tuple(_signed(_hash(">".join(names[:i]))) for i in range(1, len(names) + 1))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def page_tokens(found: Iterable[tuple]) -> list[tuple[int, Node, str]]:
    """(token, node, text) of a page's events in order; token 0 is data. Text of the head is left out."""
    out = []
    for e in found:
        if e[0] == "open":
            out.append((_hash(e[1].path), e[1], ""))
        elif e[0] == "text" and not e[1].path.startswith(">html>head"):
            words = e[2].split()
            if len(words) > SHORT:
                out.append((0, e[1], e[2]))
            else:
                out.extend((_hash(f"{e[1].path} {w}"), e[1], w) for w in words)
    return out


def host_key(url: Column) -> Column:
    """Hash of the host name of a URL; one for all that have none."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for (host, token): pages, occurrences, and an additive hash of the occurrence vector.

    The vector's hash adds a hash of (page, count) for every page that has the token, so partial sums of
    any pages can be added up, and tokens get equal sums if and only if (but for chance) their vectors
    are equal. Token 0 counts the pages.
    """
    names = ["host", "token", "pages", "times", "high", "low"]
    sums: dict[tuple[int, int], list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = [[k[0] for k in sums], [k[1] for k in sums], *([v[i] for v in sums.values()] for i in range(4))]
        sums.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

    for part in slices(batches, 64):
        for host, page in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
            identity = _hash(page or "")
            counts = Counter(t for t, _, _ in page_tokens(events(page or "")))
            counts[0] = 1
            for token, n in counts.items():
                v = ((identity ^ (n * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & MASK
                v ^= v >> 32
                s = sums.setdefault((host, _signed(token)), [0, 0, 0, 0])
                s[0] += 1
                s[1] += n
                s[2] += v >> 32
                s[3] += v & 0xFFFFFFFF
        if len(sums) > 100_000:
            yield flush()
    yield flush()


def distinct_contents(pages: DataFrame) -> DataFrame:
    """(host, html), each content of a host once. Only pages that have copies are shuffled."""
    pages = pages.select("host", F.coalesce("html", F.lit("")).alias("html"))
    copied = stored_table(pages.groupBy("host", F.xxhash64("html").alias("content")).count().where("count > 1").select("host", "content"))
    if copied.isEmpty():
        return pages
    copied, keyed = dimension(copied), pages.withColumn("content", F.xxhash64("html"))
    firsts = keyed.join(copied, ["host", "content"]).groupBy("host", "content").agg(F.first("html").alias("html"))
    return keyed.join(copied, ["host", "content"], "left_anti").select("host", "html").unionByName(stored_table(firsts.select("host", "html")))


def equivalence_classes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, group) and (group, class, once, constant, tokens).

    Hosts with enough pages are a group of their own, the others form one pool, whose vectors are the sums
    of theirs. Kept are the classes of frequent tokens that are large, and the class of tokens that are on every page just
    once. A group keeps at most 1 / MIN_SHARE times the tokens of a mean page, whatever its size.
    """
    rows = pages.select("host", "html").mapInArrow(occurrence_rows, "host long, token long, pages long, times long, high long, low long")
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "high", "low")]
    by_host = stored_table(rows.groupBy("host", "token").agg(*sums))
    own = by_host.where("token = 0").select("host", F.when(F.col("pages") >= FEW_PAGES, F.col("host")).alias("group"), F.col("pages").alias("n_pages"))
    pooled = own.where("group IS NULL").agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    groups = dimension(own.select("host", F.coalesce("group", F.lit(0)).alias("group"), F.when(F.col("group").isNull(), F.lit(pooled)).otherwise(F.col("n_pages")).alias("n_pages")))
    tokens = by_host.where("token != 0").join(groups, "host").groupBy("group", "n_pages", "token").agg(*sums)
    frequent = tokens.where(F.col("pages") >= F.greatest(F.lit(3), F.col("n_pages") * MIN_SHARE))
    vector = ["pages", "times", "high", "low"]
    classes = frequent.groupBy("group", "n_pages", *vector).agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    once = (F.col("pages") == F.col("n_pages")) & (F.col("times") == F.col("n_pages"))
    return groups.select("host", "group"), stored_table(classes.where(once | (F.size("tokens") >= MIN_TOKENS)).select(
        "group", F.xxhash64(*vector).alias("class"), once.alias("once"), (F.col("pages") >= F.col("n_pages") * CONSTANT).alias("constant"), "tokens"))


def class_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages of a task say about the classes of their group.

    Kind 0: smallest and largest hash of the order of a class's tokens on a page; its occurrences must
    repeat one order without overlap. Kind 1: the same for the template slots it occurs in. Kind 2: for
    every slot, named by the template token before it, characters of data and of data inside links.
    Kind 4: smallest and largest slot of a word that all pages have once. Kind 5: pages whose article is in article
    or main elements, and all. Kind 6: how often a doubtful element is chrome, and is there. Kind 100 and up: characters of data outside links in an element, by its depth.
    """
    seen: dict[tuple[int, int, int], list[int]] = {}

    def note(key: tuple[int, int, int], value: int) -> None:
        v = seen.setdefault(key, [value, value])
        v[0], v[1] = min(v[0], value), max(v[1], value)

    def flush() -> pa.RecordBatch:
        columns = [[k[i] for k in seen] for i in range(3)] + [[v[i] for v in seen.values()] for i in range(2)]
        seen.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["group", "kind", "key", "lo", "hi"])

    for part in slices(batches, 64):
        for group, page, classes in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            if not classes:
                continue
            member = {t: c["class"] for c in classes for t in c["tokens"]}
            size = {c["class"]: len(c["tokens"]) for c in classes}
            root = next((c["class"] for c in classes if c["once"]), None)
            orders: dict[int, list[int]] = {}
            places: dict[int, set[int]] = {}
            slot = 0
            doubts: set[Doubt] = set()
            found = judged(page or "")
            v = seen.setdefault((group, 5, 0), [0, 0])
            v[0] += in_article(found)
            v[1] += 1
            for token, node, text in page_tokens(found):
                token = _signed(token)
                doubts.update(node.doubts if text else ())
                of = member.get(token)
                if of is None:
                    if text and not node.chrome:
                        v = seen.setdefault((group, 2, slot), [0, 0])
                        v[0] += len(text)
                        v[1] += len(text) * node.link
                        if not node.link:
                            for depth, key in enumerate(around(node.box)):
                                seen.setdefault((group, 100 + depth, key), [0, 0])[0] += len(text)
                    continue
                if of == root and text:
                    note((group, 4, token), slot)
                    continue
                if of == root and not text:
                    slot = token
                orders.setdefault(of, []).append(token)
                if of != root:
                    places.setdefault(of, set()).add(slot)
            for d in doubts:
                v = seen.setdefault((group, 6, d.key), [0, 0])
                v[0] += d.on
                v[1] += 1
            for of, order in orders.items():
                n = size[of] if of != root else len(order)
                regular = len(order) % n == 0 and len(set(order[:n])) == n and order == order[:n] * (len(order) // n)
                note((group, 0, of), _signed(_hash(str(order[:n] if regular else order))))
            for of, slots in places.items():
                note((group, 1, of), _signed(_hash(str(sorted(slots)))))
        if len(seen) > 50_000:
            yield flush()
    yield flush()


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, group) and (group, root, fixed, links): the template of every group.

    ``root`` are the tokens that every page has once and in one order; they bound the slots. ``fixed``
    are the tokens of valid classes, the root's too, that nearly all pages have. ``links`` names the
    slots whose data is mostly link text. If on most pages article or main elements hold the article, ``trusted`` says so.
    ``chromes`` and ``cleared`` are the paths of doubtful elements as most pages judge them. ``box`` is the innermost element below body that holds at least half of the data. A class is valid if all pages agree on
    its order and slots; words that all pages have once need the same slot everywhere.
    """
    pages = distinct_contents(pages)
    groups, classes = equivalence_classes(pages)
    known = classes.groupBy("group").agg(F.collect_list(F.struct("class", "once", "tokens")).alias("classes"))
    read = pages.join(groups, "host").join(dimension(known, FEW_TEMPLATES), "group").select("group", "html", "classes")
    evidence = stored_table(read.mapInArrow(class_evidence, "group long, kind long, key long, lo long, hi long"))
    agreed = evidence.where("kind < 2").groupBy("group", F.col("key").alias("class"), "kind").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    valid = agreed.groupBy("group", "class").agg(F.bool_and(F.col("lo") == F.col("hi")).alias("valid")).where("valid")
    moved = evidence.where("kind = 4").groupBy("group", F.col("key").alias("token")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi")
    loose = moved.groupBy("group").agg(F.collect_list("token").alias("loose"))
    kept = classes.join(valid.drop("valid"), ["group", "class"]).groupBy("group").agg(
        F.flatten(F.collect_list(F.when(F.col("once"), F.col("tokens")))).alias("root"), F.flatten(F.collect_list(F.when(F.col("constant"), F.col("tokens")))).alias("fixed"))
    none = F.array().cast("array<bigint>")
    kept = kept.join(loose, "group", "left").select("group", *[F.array_except(c, F.coalesce("loose", none)).alias(c) for c in ("root", "fixed")])
    names = lambda where: F.collect_list(F.when(F.expr(where), F.col("key")))
    slots = evidence.where("kind = 2").groupBy("group", "key").agg(F.expr("sum(hi) * 2 > sum(lo)").alias("link"))
    links = slots.groupBy("group").agg(names("link").alias("links"))
    told = evidence.where("kind = 5").groupBy("group").agg(F.expr("sum(lo) * 2 > sum(hi)").alias("trusted"))
    held = evidence.where("kind >= 100").groupBy("group", "kind", "key").agg(F.sum("lo").alias("chars"))
    whole = held.where("kind = 100").select("group", F.col("chars").alias("total"))
    # depth 0 is the page, 1 and 2 are html and body
    votes = evidence.where("kind = 6").groupBy("group", "key").agg(F.expr("sum(lo) * 2 > sum(hi)").alias("chrome")).groupBy("group").agg(
        names("chrome").alias("chromes"), names("NOT chrome").alias("cleared"))
    boxes = held.where("kind > 102").join(whole, "group").where("chars * 2 >= total").groupBy("group").agg(F.max_by("key", "kind").alias("box"))
    return groups, dimension(kept.join(links, "group", "left").join(told, "group", "left").join(boxes, "group", "left").join(votes, "group", "left"), FEW_TEMPLATES)


def extract(page: str | None, root: frozenset, fixed: frozenset, links: frozenset, chromes: frozenset = frozenset(), cleared: frozenset = frozenset(),
            trusted: bool = False, box: int | None = None) -> str:
    """Text of the slots that hold the article, one line for each block.

    Text inside navigation, headers, footers, asides, forms and the like is left out, also by their usual names, and
    so are short nodes that consist of template words only, but not inside the article: an article or main element, or
    the box. Where the group, or a page without template for itself, has its article in article or main elements, only these are
    taken; a page of such a group whose own elements do not hold its article is unlike its group and
    gives all its slots that are not mostly links, as pages of other groups do. No amount of text decides.
    """
    found = judged(page or "", chromes, cleared)
    trusted = (trusted or not root) and in_article(found)
    blocks: list[tuple[str, bool, int]] = []
    now: list[tuple[str, bool]] = []
    slot = 0

    def end_block() -> None:
        for main in (True, False):
            text = " ".join("".join(t if m == main else " " for t, m in now).split())
            if text:
                blocks.append((text, main, slot))
        now.clear()

    for e in found:
        if e[0] == "break":
            end_block()
        elif e[0] == "open":
            token = _signed(_hash(e[1].path))
            if token in root:
                slot = token
        elif not e[1].chrome:
            words = e[2].split()
            inside = trusted and e[1].main or box is not None and box in around(e[1].path)
            if words and len(words) <= SHORT and fixed and not inside and all(_signed(_hash(f"{e[1].path} {w}")) in fixed for w in words):
                now.append((" ", e[1].main))
            else:
                now.append((entities.unescape(e[2]), e[1].main))
    end_block()
    return "\n".join(text for text, main, at in blocks if (main if trusted else at not in links))


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` with text and n_chars (replaced if they exist).

    Pages need page_id, url and html. NULL or empty html gives an empty text; a NULL or odd url puts the
    page with those of no host. Repeated pages are extracted alike. Hosts with few pages share one
    pooled template; where even that has too few pages, only the roles of elements decide. The html
    is read three times and not shuffled, unless there are more than FEW_TEMPLATES templates.
    """
    needed = picked(pages, "page_id", "url", "html").select("page_id", host_key(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    groups, known = templates(needed)

    @F.pandas_udf("string")
    def run(html: pd.Series, group: pd.Series, *template: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for page, g, *parts, trusted, box in zip(html, group, *template, strict=True):
            if g not in known:
                known[g] = [*(frozenset(() if t is None else t) for t in parts), trusted is True or trusted == 1, None if pd.isna(box) else int(box)]
            out.append(extract(page, *known[g]))
        return pd.Series(out, dtype=object)

    columns = ("root", "fixed", "links", "chromes", "cleared", "trusted")

    def read(d: DataFrame) -> DataFrame:
        joined = d.withColumn("host", host_key(F.col("url"))).join(groups, "host", "left").join(known.select("group", *columns, F.col("box").cast("string").alias("box")), "group", "left")
        return joined.withColumn("text", run(F.col("html").cast("string"), "group", *columns, "box")).withColumn("n_chars", F.char_length("text").cast("long"))

    return extended(pages, ["url", "html"], ["text", "n_chars"], read)


def query(spark, folder: str) -> DataFrame:
    """Main text of all pages."""
    from .common import read_table

    return main_text(read_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")
