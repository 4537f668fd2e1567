"""Language of whole texts by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fold, picked, read_table, seeded_unit

#: Hashed n-gram counts of a text.
DIMS = 1 << 13
#: About how many labelled texts of every language are learned from.
PER_LANGUAGE = 800
UNKNOWN = "und"
LATIN = re.compile("[A-Za-z]")
#: ASCII characters other than letters become blanks before n-grams are taken.
BLANKED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and (LATIN.search(text) is not None or any(c.isalpha() for c in text))


def ngram_features(text: str) -> np.ndarray:
    """Square roots of hashed counts of byte 1- to 3-grams, of unit length."""
    letters = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(BLANKED).split()) + b" "
    one = np.frombuffer(letters, np.uint8).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    for n in (1, 2, 3):
        if len(one) < n:
            break
        gram = np.full(len(one) - n + 1, n, np.uint32)
        for i in range(n):
            gram = gram * np.uint32(257) + one[i:len(one) - n + 1 + i]
        counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=DIMS)
    f = np.sqrt(counts).astype(np.float32)
    return f / np.linalg.norm(f)


#: Languages up to which every split of them has a column.
EXHAUSTIVE = 7


def codewords(k: int, seed: int = 42) -> np.ndarray:
    """k different codewords of -1 and 1: the exhaustive code up to seven languages, else seeded columns that split them in halves.

    Beyond seven languages there are more halves than columns asked for (35 for eight), so the draw ends; columns are
    added until all rows differ, which 8 log2 k random halves hardly ever need.
    """
    if k <= EXHAUSTIVE:
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, 1 << max(0, k - 1))] for i in range(k)], np.int8).reshape(k, -1)
    draw = np.random.default_rng(seed)
    columns: set[tuple[int, ...]] = set()
    wanted = 8 * int(np.ceil(np.log2(k)))
    while len(columns) < wanted or len({row.tobytes() for row in np.array(sorted(columns), np.int8).T}) < k:
        column = draw.permutation([1] * (k // 2) + [-1] * (k - k // 2))
        columns.add(tuple((column * column[0]).tolist()))
    return np.array(sorted(columns), np.int8).T


@dataclass
class LanguageCode:
    """Codewords, one linear classifier for each bit, and the weight of each bit's loss."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, features: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of every row's bit margins to every codeword."""
        margins = features @ self.weights + self.bias
        loss = np.logaddexp(0.0, -margins[:, None, :] * self.code[None, :, :])
        return (loss * self.trust).sum(axis=2)

    def decide(self, features: np.ndarray, ambiguous: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share among all, and whether the second is nearly as close."""
        losses = self.losses(features)
        share = np.exp(losses.min(axis=1, keepdims=True) - losses)
        share /= share.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        top = np.sort(share, axis=1)[:, ::-1]
        second = top[:, 1] if top.shape[1] > 1 else np.zeros(len(top))
        return best, top[:, 0], top[:, 0] - second < ambiguous


def fit_code(features: np.ndarray, labels: list[str], steps: int = 300, l2: float = 1e-5) -> LanguageCode:
    """Logistic classifiers of all bits at once, by accelerated gradient steps; a bit is trusted by its accuracy."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    target = code[[languages.index(x) for x in labels]].astype(np.float32)
    share = np.array([1.0 / labels.count(x) for x in languages], np.float32)
    sample = share[[languages.index(x) for x in labels]][:, None] / len(languages)
    w = np.zeros((features.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    w_old, b_old = w, b
    rate = 8.0
    for step in range(steps):
        m = step / (step + 3)
        vw, vb = w + m * (w - w_old), b + m * (b - b_old)
        pull = sample * target / (1 + np.exp(np.clip(target * (features @ vw + vb), -30, 30)))
        w_old, b_old = w, b
        w, b = vw + rate * (features.T @ pull - l2 * vw), vb + rate * pull.sum(axis=0)
    accuracy = ((features @ w + b) * target > 0).mean(axis=0) if code.shape[1] else np.ones(0)
    trust = np.maximum(accuracy - 0.5, 0.01)
    return LanguageCode(languages, code, w, b, trust / trust.sum() if len(trust) else trust)


def learn_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 42) -> LanguageCode | None:
    """Fit the code on a bounded sample: about ``per_language`` rows of each language, chosen by a seeded hash.

    Whole texts with a letter and a non-null ``lang`` are used. Their features are computed by the
    executors; the driver receives the sample only. None if there is no such row.
    """
    known = picked(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chosen = known.where(seeded_unit(seed, F.col("doc_id"), F.xxhash64("text")) < F.element_at(rates, F.col("lang")))

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([ngram_features(t).tobytes() if has_letter(t) else None for t in texts])

    sample = chosen.select("lang", features("text").alias("f")).where("f IS NOT NULL").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r[0], bytes(r[1])))
    return fit_code(np.stack([np.frombuffer(r[1], np.float32) for r in sample]), [r[0] for r in sample])


def with_language(docs: DataFrame, model: LanguageCode | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and ambiguous (replaced if they exist).

    Only the text is looked at. A NULL text or one without a letter is ``und`` with score 0, not
    ambiguous; so is every text if there is no model. With one language every text gets it, score 1.
    Ties go to the first language in order.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decide(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": False}, index=range(len(texts)))
            seen = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64) if model else np.zeros(0, np.int64)
            values = texts.tolist()
            for at in range(0, len(seen), 256):
                rows = seen[at:at + 256]
                best, score, unsure = model.decide(np.stack([ngram_features(values[i]) for i in rows]))
                out.loc[rows, "lang_pred"] = [model.languages[i] for i in best]
                out.loc[rows, "score"] = score
                out.loc[rows, "ambiguous"] = unsure
            yield out

    added = ["lang_pred", "score", "ambiguous"]
    return extended(docs, [text], added, lambda d: d.withColumn("_found", decide(F.col(text).cast("string"))).select(text, "_rest", *[f"_found.{c}" for c in added]))


def query(spark, folder: str) -> DataFrame:
    """Language of all documents, learned from the folds other than the third of four."""
    docs = read_table(spark, folder, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    model = learn_languages(docs.where(~held).select("doc_id", "text", "lang"))
    return with_language(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
