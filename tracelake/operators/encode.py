"""Vocabulary and growing-prefix encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.numbers import epoch
from ..plans.ranking import global_rank
from ..plans.sequence import ordered
from ..plans.sizing import dimension
from .cases import ORDER, case_features
from .clean import ACTIVITY, CASE, TIME

# fixed values: ids of the special tokens and of the first real token
PAD, UNK, FIRST = 0, 1, 2
UNK_NAME = "<UNK>"


def token_counts(df: DataFrame, col: str = ACTIVITY, min_freq: int = 1) -> DataFrame:
    return (
        df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("token"))
        .agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_freq)
    )


def build_vocab(
    df: DataFrame, col: str = ACTIVITY, min_freq: int = 1, max_size: int | None = None,
    add_unk: bool = True, add_pad: bool = True,
) -> DataFrame:
    """(token, id, cnt) ordered by (-count, token).

    With ``max_size`` the top tokens are picked per task first and at most ``max_size`` rows are
    numbered; without it the ids come from a range-partitioned rank.
    """
    counts = token_counts(df, col, min_freq)
    first = int(add_pad) + int(add_unk)
    if max_size is not None:
        keep = max(max_size - first, 0)
        top = counts.orderBy(F.desc("cnt"), "token").limit(keep)
        ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("cnt"), "token")))
    else:
        ranked = global_rank(counts, [F.desc("cnt"), F.col("token")], "_r")
    return ranked.select("token", (F.col("_r") + first - 1).cast("int").alias("id"), "cnt")


def encode_tokens(df: DataFrame, vocab: DataFrame, col: str = ACTIVITY, out: str = "token_id", unk: int = UNK) -> DataFrame:
    """Token to id, unknown and NULL to UNK."""
    lookup = dimension(vocab.select(F.col("token").alias(col), F.col("id").alias(out)))
    return df.join(lookup, col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(unk)).cast("int"))


def pad_truncate(tokens: Column, max_len: int, truncation: str = "left", padding: str = "left") -> tuple[Column, Column, Column]:
    """Fixed-width ids, mask and true length of a token array."""
    kept = A.last_n(tokens, max_len) if truncation == "left" else A.first_n(tokens, max_len)
    length = F.size(kept)
    return A.pad(kept, max_len, padding, PAD), A.pad_mask(length, max_len, padding), length


def encode_prefixes(
    log: DataFrame, vocab: DataFrame, max_len: int = 50, min_prefix_len: int = 1,
    truncation: str = "left", padding: str = "left", order: Sequence[str] = ORDER,
) -> DataFrame:
    """One row per event at true position t >= ``min_prefix_len``.

    The history is a bounded window frame, so memory per event never exceeds ``max_len`` ids. Right
    truncation repeats the first ``max_len`` ids of the case once they are complete.
    """
    if min_prefix_len < 1:
        raise ValueError("min_prefix_len must be at least 1")
    ids = encode_tokens(log, vocab)
    seq = ordered(ids, order, history={"_tokens": (F.col("token_id"), max_len)})
    if truncation == "right":
        heads = seq.where(F.col("t") == max_len).select(CASE, F.col("_tokens").alias("_head"))
        seq = seq.join(heads, CASE, "left").withColumn(
            "_tokens", F.when(F.col("t") > max_len, F.col("_head")).otherwise(F.col("_tokens")))
    x, mask, length = pad_truncate(F.col("_tokens"), max_len, truncation, padding)
    last = epoch(F.col(TIME)) if TIME in log.columns else F.lit(None).cast("long")
    return seq.where(F.col("t") >= min_prefix_len).select(
        CASE, "t", "n_events", ACTIVITY, "token_id", last.alias("ts_last"),
        x.alias("x"), mask.alias("mask"), length.alias("length"))


def unk_rate(ids: DataFrame, col: str = "token_id") -> DataFrame:
    return ids.agg((100.0 * F.avg((F.col(col) == UNK).cast("double"))).alias("unk_pct"))


def encode_stats(prefixes: DataFrame, vocab: DataFrame | None = None, top: int = 10) -> DataFrame:
    """One row: prefix count, cases, UNK share and length distribution.

    Lengths are bounded by the encoding width, so the percentile sees few distinct values. With
    ``vocab`` its size (PAD and UNK included) and its ``top`` most frequent tokens are added.
    """
    stats = _prefix_stats(prefixes)
    if vocab is None:
        return stats
    size = vocab.agg((F.count(F.lit(1)) + UNK + 1).alias("v")).scalar()
    # ids follow the frequency, so the first ids are the most frequent tokens: ``top`` rows
    first = vocab.where(F.col("id") <= UNK + top).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "token", "cnt"))), lambda s: F.struct(s["token"].alias("token"), s["cnt"].alias("cnt"))).alias("l")).scalar()
    return stats.withColumns({"vocab_size": size, "top_tokens": first})


def _prefix_stats(prefixes: DataFrame) -> DataFrame:
    return prefixes.agg(
        F.count(F.lit(1)).alias("n_prefixes"), F.sum((F.col("t") == F.col("n_events")).cast("long")).alias("n_cases"),
        (100.0 * F.avg((F.col("token_id") == UNK).cast("double"))).alias("unk_pct"),
        F.min("length").alias("len_min"), F.avg("length").alias("len_mean"),
        F.percentile("length", 0.5).alias("len_p50"), F.percentile("length", 0.95).alias("len_p95"),
        F.max("length").alias("len_max"))


def decode_last(prefixes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``last_token``: the last real token of the prefix, by name; UNK for an id without a name or an empty prefix."""
    real = F.filter(F.arrays_zip("x", "mask"), lambda p: p["mask"] > 0)
    with_id = prefixes.withColumn("_last", F.try_element_at(real, F.lit(-1)).getField("x"))
    names = dimension(vocab.select(F.col("id").alias("_last"), F.col("token").alias("last_token")))
    named = with_id.join(names, "_last", "left")
    return named.withColumn("last_token", F.coalesce("last_token", F.lit(UNK_NAME))).drop("_last")


def oov_audit(prefixes: DataFrame, vocab: DataFrame, col: str = "x") -> DataFrame:
    """Share of ids outside the vocabulary and its severity band (0.1 % / 1 %)."""
    size = vocab.agg((F.coalesce(F.max("id"), F.lit(UNK)) + 1).alias("v")).scalar()
    known = prefixes.withColumn("_v", size)
    outside = F.size(F.filter(F.col(col), lambda x: x >= F.col("_v")))
    agg = known.agg(F.sum(F.size(col)).cast("long").alias("n_tokens"), F.sum(outside).cast("long").alias("n_oov"),
                    F.max("_v").alias("vocab_size"))
    pct = F.coalesce(100.0 * F.try_divide(F.col("n_oov").cast("double"), F.col("n_tokens").cast("double")), F.lit(0.0))
    band = F.when(pct >= 1.0, "error").when(pct >= 0.1, "warning").when(pct > 0, "info").otherwise("ok")
    return agg.withColumns({"oov_pct": pct, "severity": band})


def encode_log(log: DataFrame, min_freq: int = 1, max_size: int | None = None, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and prefixes of a clean log."""
    vocab = build_vocab(log, min_freq=min_freq, max_size=max_size)
    return vocab, encode_prefixes(log, vocab, **kwargs)


def encode_tabular(log: DataFrame, numeric: Sequence[str], counted: Sequence[str], min_prefix_len: int = 1) -> DataFrame:
    """Tabular alternative to token arrays: the feature row of every prefix."""
    return case_features(log, numeric, counted).where(F.col("t") >= min_prefix_len)
