"""Case-level outcomes, statistics and point-in-time features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import days_between, ratio
from ..plans.ranking import percentiles
from ..plans.sequence import ordered
from .clean import ACTIVITY, CASE, TIME

ORDER = (TIME, ACTIVITY, "event_id")


def presence_outcome(log: DataFrame, positive: Sequence[str], mode: str = "any", order: Sequence[str] = ORDER) -> DataFrame:
    """(case_id, outcome): 1.0 when a positive activity occurs; ``last_matching`` looks at the last event only."""
    if not positive:
        return log.groupBy(CASE).agg(F.lit(0.0).alias("outcome"))
    hit = F.when(F.col(ACTIVITY).isin(list(positive)), 1.0).otherwise(0.0)
    if mode == "any":
        return log.groupBy(CASE).agg(F.max(hit).alias("outcome"))
    if mode == "last_matching":
        return log.groupBy(CASE).agg(F.max_by(hit, F.struct(*order)).alias("outcome"))
    raise ValueError(f"unknown mode {mode!r}")


def with_outcome(log: DataFrame, positive: Sequence[str], mode: str = "any") -> DataFrame:
    """Broadcast the presence outcome to every event of the case (a join on pre-aggregated cases)."""
    return log.drop("outcome").join(presence_outcome(log, positive, mode), CASE)


def terminal_value(log: DataFrame, col: str = "outcome", order: Sequence[str] = ORDER) -> DataFrame:
    """(case_id, col): last non-null value in case order."""
    key = F.when(F.col(col).isNotNull(), F.struct(*order))
    return log.groupBy(CASE).agg(F.max_by(col, key).alias(col))


def ingest_stats(log: DataFrame) -> DataFrame:
    """One row: volumes, missing share, date range, case-length distribution."""
    n_cols = [CASE, ACTIVITY, TIME]
    events = log.agg(
        F.count(F.lit(1)).alias("n_events"),
        *[(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(f"missing_{c}_pct") for c in n_cols],
        F.min(TIME).alias("first_event"), F.max(TIME).alias("last_event"),
    )
    # case lengths collapse to (length, cases): at most sqrt(2 * events) rows reach the percentile
    lengths = (
        log.groupBy(CASE).agg(F.count(F.lit(1)).alias("len"))
        .groupBy("len").agg(F.count(F.lit(1)).alias("w"))
    )
    sizes = lengths.agg(
        F.struct(
            F.sum("w").alias("n_cases"), F.min("len").alias("len_min"),
            (F.sum(F.col("len") * F.col("w")) / F.sum("w")).alias("len_mean"),
            F.percentile("len", F.lit(0.5), F.col("w")).alias("len_p50"),
            F.percentile("len", F.lit(0.95), F.col("w")).alias("len_p95"),
            F.max("len").alias("len_max"),
        ).alias("s")
    )
    return events.withColumn("s", sizes.scalar()).select(*events.columns, "s.*")


def top_activities(log: DataFrame, n: int = 10) -> DataFrame:
    return (
        log.groupBy(ACTIVITY).agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), ACTIVITY).limit(n)
    )


def case_features(log: DataFrame, numeric: Sequence[str] = (), counted: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """Features after every event: numeric columns, prefix length, elapsed days, running activity counts."""
    seq = ordered(
        log, order,
        running={f"count_{a}": F.when(F.col(ACTIVITY) == a, 1).otherwise(0) for a in counted},
        totals={"_start": ("min", F.col(TIME))},
    )
    return seq.select(
        CASE, "t", "n_events",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in log.columns else F.lit(0.0).alias(c) for c in numeric],
        F.col("t").cast("double").alias("prefix_len"),
        days_between(F.col("_start"), F.col(TIME)).alias("elapsed_time"),
        *[F.col(f"count_{a}").cast("double").alias(f"count_{a}") for a in counted],
    )


def case_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy(CASE).agg(F.count(F.lit(1)).alias("n_events"))


def features_at(features: DataFrame, wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Feature row for requested (case_id, t): t is clamped to the case; an unknown case gives zeros and a flag.

    ``features`` comes from :func:`case_features`, ``sizes`` from :func:`case_sizes`. The second join
    is keyed by (case_id, position), so a case that most requests ask for is spread over tasks.
    """
    names = [c for c in features.columns if c not in (CASE, "t", "n_events")]
    asked = wanted.join(sizes, CASE, "left").withColumn(
        "_at", F.greatest(F.lit(1), F.least(F.col("t"), F.coalesce(F.col("n_events"), F.lit(1)))).cast("long"))
    found = features.select(CASE, F.col("t").alias("_at"), *names)
    return asked.join(found, [CASE, "_at"], "left").select(
        *wanted.columns, F.col("n_events").isNull().alias("missing"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])


def cycle_time(log: DataFrame) -> DataFrame:
    """(case_id, ct_days): hash aggregate only."""
    return log.groupBy(CASE).agg(days_between(F.min(TIME), F.max(TIME)).alias("ct_days"))


def case_interventions(scored: DataFrame, cases: DataFrame, action: int = 1) -> DataFrame:
    """(case_id, intervened): any greedy action equal to ``action``; cases without rows are False."""
    flags = scored.groupBy(CASE).agg(F.bool_or(F.col("a_star") == action).alias("intervened"))
    return cases.select(CASE).join(flags, CASE, "left").withColumn("intervened", F.coalesce("intervened", F.lit(False)))


def cycle_time_audit(ct: DataFrame, flags: DataFrame) -> DataFrame:
    """One row comparing cycle times of cases with and without an intervention."""
    both = flags.join(ct, CASE, "left")
    days = F.col("ct_days")
    ok = days.isNotNull() & ~F.isnan(days)
    yes, no = F.col("intervened") & ok, ~F.col("intervened") & ok
    agg = both.agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(~ok).alias("n_missing_ct"),
        F.avg(F.col("intervened").cast("double")).alias("intervention_rate"),
        F.avg(F.when(yes, days)).alias("ct_with"), F.avg(F.when(no, days)).alias("ct_without"),
        F.avg(F.when(ok, days)).alias("ct_overall"),
    )
    delta = F.col("ct_with") - F.col("ct_without")
    return agg.withColumns({"delta_days": delta, "delta_pct": 100.0 * ratio(delta, F.col("ct_without"))})


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (feature, mean, std) with the population deviation."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(c).cast("double").alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols]
    return df.agg(*aggs).select(F.explode(F.array(*cols)).alias("v")).select("v.*")


def case_start(log: DataFrame) -> DataFrame:
    return log.groupBy(CASE).agg(F.min(TIME).alias("start_ts"))


def case_reward(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy(CASE).agg(F.sum(F.col("r").cast("double")).alias("total_reward"), F.count(F.lit(1)).alias("n_transitions"))
