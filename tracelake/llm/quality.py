"""Quality scores by naive-Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fold, picked, read_table, seeded_unit

BITS = 18
#: About how many labelled texts are learned from.
SAMPLE = 6000
#: Words hashed at once.
AT_ONCE = 1 << 16
#: Shapes of UTF-8 bytes: letters by case, digits, any other ASCII character as it is. The lead byte of
#: Latin-1 letters is dropped, its second byte tells the case.
SHAPES = bytes(
    ord("a") if 97 <= b <= 122 or b >= 0xA0 else ord("A") if 65 <= b <= 90 or b >= 0x80 else ord("0") if 48 <= b <= 57 else b
    for b in range(256))


def _mix(kind: int, *columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), kind, np.uint32)
    for c in columns:
        h = (h ^ c) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def ngram_indicators(text: str | None) -> np.ndarray:
    """Sorted hashed indices of the n-grams that occur in a text.

    Words and pairs of words; runs of 3 and 5 characters of the text's shape; and runs of three words
    by whether each equals the word before it. An empty text has none.
    """
    words = (text or "").encode("utf-8", "replace").split()
    found: set[int] = set()
    for at in range(0, len(words), AT_ONCE):
        part = words[max(0, at - 3):at + AT_ONCE]
        h = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
        grams = [_mix(1, h)]
        if len(h) > 1:
            again = (h[1:] == h[:-1]).astype(np.uint32)
            grams.append(_mix(2, h[:-1], h[1:]))
            if len(again) > 2:
                grams.append(_mix(3, again[:-2] * 4 + again[1:-1] * 2 + again[2:]))
        shape = np.frombuffer(b" ".join(part).translate(SHAPES, b"\xc3"), np.uint8).astype(np.uint32)
        for n in (3, 5):
            if len(shape) >= n:
                grams.append(_mix(10 + n, *[shape[i:len(shape) - n + 1 + i] for i in range(n)]))
        found.update(np.unique(np.concatenate(grams)).tolist())
    return np.array(sorted(found), np.uint32)


@dataclass
class SupportVectors:
    """Weight of every indicator (its log-count ratio times the linear weight) and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, indices: np.ndarray) -> float:
        margin = float(self.weights[indices].sum()) / max(1.0, np.sqrt(len(indices))) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(4.0 * margin, -60, 60))))


def fit_support_vectors(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, alpha: float = 1.0, seed: int = 42) -> SupportVectors:
    """Scale indicators by class log-count ratios, then fit a hinge loss by dual coordinate descent.

    Every row is scaled to the length of its number of indicators, so that long texts do not dominate;
    the rarer class weighs as much as the other. With one class only, the score is that class.
    """
    size = 1 << BITS
    if labels.min() == labels.max():
        return SupportVectors(np.zeros(size, np.float32), 4.0 if labels[0] > 0 else -4.0)
    up, down = (np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == side] or [np.zeros(0, np.uint32)]), minlength=size) + alpha for side in (1, -1))
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    values = [ratio[r] / max(1.0, np.sqrt(len(r))) for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])  # the bias is one more constant feature
    top = np.where(labels > 0, c * len(labels) / (2 * (labels > 0).sum()), c * len(labels) / (2 * (labels < 0).sum()))
    dual, w, bias = np.zeros(len(rows)), np.zeros(size), 0.0
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            gradient = labels[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(dual[i] - gradient / norms[i], 0.0), top[i])
            step = (new - dual[i]) * labels[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return SupportVectors((w * ratio).astype(np.float32), bias)


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 42) -> SupportVectors | None:
    """Fit on a bounded sample of labelled rows: about ``sample`` of them, chosen by a seeded hash of the id.

    Rows with NULL id or quality are not used; of several labels of one id the smallest counts. The
    executors compute the indicators of whole texts, the driver receives those of the sample only.
    None if nothing is labelled.
    """
    known = picked(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    if not total:
        return None
    chosen = known.where(seeded_unit(seed, F.col("doc_id").cast("long")) < sample / total)

    @F.pandas_udf("binary")
    def indicators(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([ngram_indicators(t).tobytes() for t in texts])

    # at most a few more than `sample` ids
    rows = picked(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", indicators("text").alias("f"))
    rows = sorted((int(r[0]), int(r[1]), bytes(r[2])) for r in rows.collect())
    if not rows:
        return None
    return fit_support_vectors([np.frombuffer(r[2], np.uint32) for r in rows], np.array([1.0 if r[1] > 0 else -1.0 for r in rows]))


def with_quality(docs: DataFrame, model: SupportVectors | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with score and predicted (replaced if they exist).

    Only the text is looked at; NULL is scored like an empty text, by the bias. Without a model every
    score is 0.5.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([model.score(ngram_indicators(t)) if model else 0.5 for t in texts], dtype="float64")

    return extended(docs, [text], ["score", "predicted"], lambda d: d.withColumn("score", score(F.coalesce(F.col(text).cast("string"), F.lit("")))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")))


def trained(docs: DataFrame, labels: DataFrame) -> SupportVectors | None:
    """The model of the folds other than the second of three."""
    return learn_quality(docs, picked(labels, "doc_id", "quality").where(fold("doc_id", 3) != 1))


def query(spark, folder: str) -> DataFrame:
    """Quality of all documents."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = trained(docs, read_table(spark, folder, "labels"))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    return with_quality(docs.withColumn("held_out", held), model).drop("text")
