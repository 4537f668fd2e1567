"""Guarded decisions: the same expressions for batch tables and streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import percentiles
from ..session import stored
from .distill import Rules


@dataclass(frozen=True)
class GuardSpec:
    """Thresholds and the fallback decision. ``stats`` maps feature to (mean, std)."""

    tau_uncertainty: float = 0.3
    tau_ood_z: float = 3.0
    max_ood_features: int = 0
    fallback_id: int = 0
    fallback_name: str = "do_nothing"
    stats: Mapping[str, tuple[float, float]] | None = None


def stats_column(stats: DataFrame) -> Column:
    """(feature, mean, std) as a stored one-row map, computed once for all z-scores; one entry per feature."""
    entries = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std"))))
    return stored(stats.agg(entries.alias("m"))).scalar()


def feature_row(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features in model order: absent columns and missing counts become 0."""
    cols = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features}
    return df.withColumns(cols)


def z_scores(features: Sequence[str], stats: Column | Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    """|z| per known feature; a zero deviation gives 0, unknown features give NULL."""
    out = {}
    for f in features:
        if isinstance(stats, Column):
            s = F.try_element_at(stats, F.lit(f))
            mean, std = s.getField("mean"), s.getField("std")
        elif f in stats:
            mean, std = F.lit(float(stats[f][0])), F.lit(float(stats[f][1]))
        else:
            continue
        z = F.coalesce(F.abs(F.try_divide(F.col(f).cast("double") - mean, std)), F.lit(0.0))
        out[f] = F.when(mean.isNotNull(), z)
    return out


def ood_count(features: Sequence[str], stats: Column | Mapping[str, tuple[float, float]], tau: float = 3.0) -> Column:
    flags = [F.coalesce((z > tau).cast("int"), F.lit(0)) for z in z_scores(features, stats).values()]
    total = F.lit(0)
    for f in flags:
        total = total + f
    return total


def guard(df: DataFrame, spec: GuardSpec, features: Sequence[str], stats: Column | None = None, actions: Sequence[str] = ()) -> DataFrame:
    """Add action_id, action_name, source, reason, ood. First match wins: override, mask, out of
    distribution, uncertainty, surrogate.

    ``df`` has ``surrogate`` struct(action_id, confidence), optional ``override`` struct and
    ``valid_actions`` array; a NULL mask allows everything.
    """
    s = F.col("surrogate")
    act, unc = s.getField("action_id"), F.lit(1.0) - s.getField("confidence")
    has = set(df.columns)
    override = F.col("override") if "override" in has else F.lit(None).cast("struct<action_id:int,action_name:string,reason:string>")
    valid = F.col("valid_actions") if "valid_actions" in has else F.lit(None).cast("array<int>")
    known = stats if stats is not None else spec.stats
    base = df.withColumn("_n_ood", ood_count(features, known, spec.tau_ood_z) if known is not None else F.lit(0))
    overridden = override.isNotNull()
    masked = valid.isNotNull() & ~F.coalesce(F.array_contains(valid, act), F.lit(False))
    odd = F.col("_n_ood") > spec.max_ood_features
    unsure = unc > spec.tau_uncertainty
    names = F.array(*[F.lit(a) for a in actions]) if actions else F.array().cast("array<string>")

    def pick(on_override: Column, on_fallback: Column, on_surrogate: Column) -> Column:
        return F.when(overridden, on_override).when(masked | odd | unsure, on_fallback).otherwise(on_surrogate)

    # fixed values: the reason texts
    return base.withColumns({
        "action_id": pick(override.getField("action_id"), F.lit(spec.fallback_id), act).cast("int"),
        "action_name": pick(F.coalesce(override.getField("action_name"), F.lit("unknown")), F.lit(spec.fallback_name), F.get(names, act)),
        "source": pick(F.lit("override"), F.lit("baseline"), F.lit("surrogate")),
        "reason": F.when(overridden, F.coalesce(override.getField("reason"), F.lit("human decision")))
        .when(masked, F.format_string("invalid_action=%d", act)).when(odd, F.lit("OOD detected"))
        .when(unsure, F.format_string(f"uncertainty=%.3f > threshold={spec.tau_uncertainty}", unc)),
        "ood": ~overridden & ~masked & odd,
        "confidence": s.getField("confidence"), "uncertainty": unc,
    }).drop("_n_ood")


def decide(requests: DataFrame, rules: Rules, spec: GuardSpec, features: Sequence[str], stats: Column | None = None) -> DataFrame:
    """Validate, score and guard requests; works on batch and streaming DataFrames alike."""
    from .clean import request_errors

    scored = feature_row(request_errors(requests, [f for f in features if not f.startswith("count_")]), features).withColumn("surrogate", rules.decision())
    out = guard(scored, spec, features, stats, rules.actions)
    return out.withColumn("accepted", F.size("errors") == 0)


def mahalanobis(df: DataFrame, features: Sequence[str], reference: DataFrame, ridge: float = 1e-9, out: str = "distance") -> DataFrame:
    """Mahalanobis distance to the reference distribution.

    Means and pairwise covariances are one aggregate row (d + d(d+1)/2 numbers); only that row
    reaches the driver, where the d x d matrix is inverted into literals.
    """
    import numpy as np

    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = reference.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    inv = np.linalg.pinv(cov + ridge * np.eye(d))
    centred = [F.col(f).cast("double") - F.lit(float(row[f"m{i}"])) for i, f in enumerate(features)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + F.lit(float(inv[i, j])) * centred[i] * centred[j]
    return df.withColumn(out, F.sqrt(F.greatest(total, F.lit(0.0))))


def fidelity_badge(rows: DataFrame, pass_gap: float = 0.0, caution_gap: float = -0.05) -> DataFrame:
    """PASS / CAUTION / FAIL per test from the long fidelity table.

    The worst gap over p decides: removing explained tokens should matter at least as much as
    removing random ones.
    """
    gaps = rows.where(F.col("metric").isin("gap_norm", "flip_gap")).groupBy("test").agg(F.min("value").alias("worst_gap"), F.avg("value").alias("mean_gap"))
    worst = F.col("worst_gap")
    return gaps.withColumn("badge", F.when(worst >= pass_gap, "PASS").when(F.col("mean_gap") >= caution_gap, "CAUTION").otherwise("FAIL"))


def replay_summary(decisions: DataFrame) -> DataFrame:
    """Per source: count, share, mean confidence, mean / p95 / p99 latency."""
    agg = decisions.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence_mean"), F.avg("latency_ms").alias("latency_mean"))
    total = decisions.agg(F.count(F.lit(1)).alias("n")).scalar()
    pct = percentiles(decisions, "latency_ms", {"latency_p95": 0.95, "latency_p99": 0.99}, ["source"])
    return agg.join(pct, "source").withColumn("share", F.col("n") / total)
