"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where they agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended
from .vocab import library, word_ids

VOCABULARY = "word_bpe_49k.json"
#: Texts of more code points are cut into chunks of CHUNK with OVERLAP in common.
HUGE = 1 << 16
CHUNK = 1 << 14
OVERLAP = 256
#: Places that no piece of the vocabulary's split pattern goes over: blanks, both sides of a digit, and a letter before a
#: sign. The signs do not compose with a letter; special strings, the exception, are looked up apart.
BORDER = re.compile(
    r"[\t\n\v\f\r ]|(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])|(?<=[^\W\d_])(?=[\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\u300c\u300d])")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def _encode(tokenizer, text: str, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with start and end offsets in the whole text."""
    got = tokenizer.encode(text[at:end], add_special_tokens=False)
    spans = np.array(got.offsets, np.int64).reshape(-1, 2) + at
    return np.array(got.ids, np.int64), spans[:, 0], spans[:, 1]


def borders(text: str, lo: int, hi: int) -> list[int]:
    """Places in (lo, hi) that every encoding of the text has a boundary at."""
    inside = {p for m in SPECIAL.finditer(text, max(0, lo - 16), hi + 16) for p in range(m.start() + 1, m.end())}
    return [m.start() for m in BORDER.finditer(text, lo, hi) if m.start() > lo and m.start() not in inside]


def stable_boundary(text: str, lo: int, hi: int, left: tuple, right: tuple) -> int | None:
    """A position in (lo, hi) where the encodings of both chunks may be joined, or None.

    A border is a proven boundary of this vocabulary: no piece, normalisation or special string goes
    over it, so what follows does not depend on what precedes. It is taken where both encodings also
    agree token by token from the border to the next one.
    """
    places = borders(text, lo, hi)
    for p, q in zip(places, places[1:], strict=False):
        cut = [slice(np.searchsorted(e[1], p), np.searchsorted(e[1], q)) for e in (left, right)]
        if cut[0].stop > cut[0].start and all(np.array_equal(x[cut[0]], y[cut[1]]) for x, y in zip(left, right, strict=True)):
            return p
    return None


def spliced_ids(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a text of any length, equal to those of one call on the whole text.

    Chunks share ``overlap`` code points. Neighbours are spliced at a stable common boundary; where
    their overlap has none, it is doubled and the next chunk starts earlier. A chunk without any border, one
    word so far, doubles in length, so that even a text of one word is encoded at most twice over.
    """
    out: list[np.ndarray] = []
    start, end = 0, min(chunk, len(text))
    now = _encode(tokenizer, text, start, end)
    done = 0  # the text before it is already in out
    while end < len(text):
        width, boundary, right = overlap, None, None
        while boundary is None and end - width > done:
            lo = end - width
            if len(borders(text, lo, end)) > 1:
                right = _encode(tokenizer, text, lo, min(lo + chunk + width, len(text)))
                boundary = stable_boundary(text, lo, end, now, right)
            width *= 2
        if boundary is None:
            end = min(max(done + 2 * (end - done), done + chunk), len(text))
            now = _encode(tokenizer, text, done, end)
            continue
        keep = (now[1] >= done) & (now[1] < boundary)
        out.append(now[0][keep])
        done = boundary
        end = min(lo + chunk + width // 2, len(text))
        now = right
    out.append(now[0][now[1] >= done])
    return np.concatenate(out)


def text_ids(text: str, name: str = VOCABULARY, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """Ids of a text as little-endian 32-bit bytes."""
    if len(text) > huge:
        return spliced_ids(text, library(name), chunk, overlap).astype("<u4").tobytes()
    return word_ids(name).encode(text)


def with_token_counts(docs: DataFrame, limit: int = 2048, name: str = VOCABULARY, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_tokens and over_limit (replaced if they exist).

    Counts equal the library's on the whole text without added special tokens. NULL and empty texts
    have 0 bytes and tokens. Nothing is shuffled; a worker holds one text and its ids at a time.
    """

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([len(text_ids(t, name, huge, chunk, overlap)) // 4 if t else 0 for t in texts], dtype="int64")

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return extended(docs, [text], ["n_bytes", "n_tokens", "over_limit"], lambda d: d.withColumns(
        {"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": count(whole)}).withColumn("over_limit", F.col("n_tokens") > limit))


def query(spark, folder: str) -> DataFrame:
    """Token counts of all documents."""
    from .common import read_table

    return with_token_counts(read_table(spark, folder, "documents").select("doc_id", "text")).drop("text")
