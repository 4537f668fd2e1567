"""End-to-end flows composed from the operators. Writing a result is the only action."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cases, clean, encode, splits, transitions
from ..operators.transitions import DecisionSpec
from ..session import stored
from .sequence import segment_cases


@dataclass(frozen=True)
class DecisionDataset:
    log: DataFrame
    vocab: DataFrame
    transitions: DataFrame
    splits: DataFrame


def prepare_log(
    raw: DataFrame, mapping: Mapping[str, str], *, tz_in: str | None = None, tz_out: str | None = "UTC", keep_lifecycle: Sequence[str] = (), positive: Sequence[str] | None = None,
    columns: Sequence[str] | None = None, dense_ids: bool = True, dedupe: bool = True, tie: str = "event_id",
) -> DataFrame:
    """Raw events to a clean log: rename, parse, lifecycle, outcome, case ids, columns, duplicates.

    The outcome is computed after the lifecycle filter, as events that are filtered out must not
    decide a case.
    """
    log = clean.parse_timestamps(clean.rename_columns(raw, mapping), tz_in=tz_in, tz_out=tz_out)
    if keep_lifecycle:
        log = clean.filter_lifecycle(log, keep_lifecycle)
    if positive is not None:
        log = cases.with_outcome(log, positive)
    if dense_ids:
        log = clean.encode_case_ids(log)
    if columns is not None:
        log = clean.select_columns(log, [*columns, tie])
    return clean.drop_duplicate_events(log, tie=tie) if dedupe else log


def decision_dataset(
    log: DataFrame, spec: DecisionSpec, outcome: tuple[str, Column], *, max_len: int = 50, min_freq: int = 1, max_size: int | None = None, method: str = "random_case", seed: int = 42,
    ratios: tuple[float, float, float] = splits.RATIOS, max_rows: int = 1_000_000,
) -> DecisionDataset:
    """Clean log to vocabulary, transitions and splits. Oversized cases are cut into segments first."""
    vocab = stored(encode.build_vocab(log, min_freq=min_freq, max_size=max_size))
    tr = transitions.build_transitions(segment_cases(log, max_rows=max_rows), spec, outcome, vocab, max_len)
    if method == "random_case":
        parts = splits.split_random(log, seed, ratios)
    elif method == "temporal_case":
        parts = splits.split_temporal(cases.case_start(log), ratios).select("case_id", "split")
    else:
        raise ValueError(f"unknown split method {method!r}")
    return DecisionDataset(log, vocab, tr, parts)


def validation_report(data: DecisionDataset, n_actions: int, max_len: int, drift_pct: float = 20.0) -> DataFrame:
    """Long table (section, name, value): structure, rewards, gaps, split checks, drift. All checks, one result."""
    tr = data.transitions

    def long(section: str, df: DataFrame) -> DataFrame:
        items = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns]
        return df.select(F.lit(section).alias("section"), F.explode(F.array(*items)).alias("i")).select("section", "i.*")

    structure = splits.structure_violations(tr, max_len, n_actions).select(F.lit("structure").alias("section"), F.col("check").alias("name"), F.col("n").cast("double").alias("value"))
    profile = stored(splits.split_profile(tr, data.splits, n_actions))  # one row per split
    parts = [
        structure, long("reward", splits.reward_sanity(tr)), long("continuity", splits.continuity_gaps(tr).agg(F.count(F.lit(1)).alias("n_gaps"))),
        long("splits", splits.split_checks(data.splits, data.log)), long("drift", splits.episode_drift(profile, drift_pct)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
