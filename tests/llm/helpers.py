"""Brute-force versions and small tables."""

from __future__ import annotations

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, th string, component_id long"


def docs(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", "y", -1) for i, t, lang, src in rows], DOCS)


AWKWARD = [
    (5, "one two three four five six\nshared line of text\nshared line of text", "en", "a"),
    (3, "  SHARED line of text\t\nown words here are long", "en", "a"),
    (9, None, "en", None), (8, "", None, "b"), (None, "shared line of text\nnobody", "fr", "b"),
    (7, "\n\n", "de", "a"), (1, "word " * 30_000, "en", "c"), (2, "x" * 150_000, "en", "c"),
    (5, "one two three four five six\nshared line of text\nshared line of text", "en", "a"),
    (4, "12345 !!! ---", "es", "c"), (6, "shared line of text", "en", "a"), (10, "é́ ΑΣ <|endoftext|> 東京", "fr", "b"),
]


def components(nodes, links):
    """Smallest node reachable from every node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def simhash(text, words=3):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def cosine_links(rows, threshold=0.93):
    """Links between usable (id, vector, label) rows, by position."""
    out = []
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    out.append((i, j))
    return out
