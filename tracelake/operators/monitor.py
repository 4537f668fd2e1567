"""Monitoring decisions: daily metrics, drift, thresholds, alerts, retraining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..plans.ranking import percentiles, running_totals

DAY = "date"
FLOOR = 1e-6


def _rates() -> list[Column]:
    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    src = F.col("source")
    return [
        F.count(F.lit(1)).alias("total_requests"), share(src == "surrogate").alias("coverage"), share(src == "baseline").alias("fallback_rate"),
        share(src == "override").alias("override_rate"), share(F.coalesce(F.col("ood"), F.lit(False))).alias("ood_rate"),
        F.avg("confidence").alias("confidence_mean"), F.stddev_samp("confidence").alias("confidence_std"),
        share(schema_error()).alias("schema_error_rate")]


def schema_error() -> Column:
    """A logged decision without case, action or source, or with a confidence outside 0..1 or a negative latency."""
    lacks = F.col("case_id").isNull() | F.col("action_id").isNull() | F.col("source").isNull()
    odd = ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(True)) | F.coalesce(F.col("latency_ms") < 0, F.lit(False))
    return lacks | odd


def daily_metrics(decisions: DataFrame, exact: bool = True) -> DataFrame:
    """One row per day: rates, confidence moments (sample deviation), latency percentiles.

    ``exact=False`` swaps the exact percentiles for mergeable sketches in the same aggregate.
    """
    dated = decisions.withColumn(DAY, F.to_date("timestamp"))
    probs = {"latency_p50": 0.50, "latency_p95": 0.95, "latency_p99": 0.99}
    if not exact:
        return dated.groupBy(DAY).agg(*_rates(), *[F.percentile_approx("latency_ms", F.lit(p), F.lit(10_000)).alias(n) for n, p in probs.items()])
    return dated.groupBy(DAY).agg(*_rates()).join(percentiles(dated, "latency_ms", probs, [DAY]), DAY)


def action_distribution(decisions: DataFrame) -> DataFrame:
    """(date, action_id, n, share): counts first, shares over the few actions of a day."""
    n = decisions.withColumn(DAY, F.to_date("timestamp")).groupBy(DAY, "action_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(DAY)))


def action_map(distribution: DataFrame) -> DataFrame:
    return distribution.groupBy(DAY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action_id", "n")))).alias("action_distribution"))


def upsert_daily(history: DataFrame, update: DataFrame) -> DataFrame:
    """History with the days of ``update`` replaced (one row per day on both sides)."""
    both = history.withColumn("_new", F.lit(0)).unionByName(update.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(DAY).orderBy(F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_new")


# ---- distribution drift ---------------------------------------------------------------------------


def psi(current: DataFrame, baseline: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature over equal-width, right-closed bins of the joint range.

    Both shares are floored at 1e-6. The range is one scalar row; counts are per (feature, bin).
    """
    both = current.select(*features, F.lit(1).alias("_cur")).unionByName(baseline.select(*features, F.lit(0).alias("_cur")))
    ranges = both.agg(F.struct(*[F.struct(F.min(f).cast("double").alias("lo"), F.max(f).cast("double").alias("hi")).alias(f) for f in features]).alias("r")).scalar()
    ranged = both.withColumn("_r", ranges)
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"), F.col(f"_r.{f}.lo").alias("lo"), F.col(f"_r.{f}.hi").alias("hi")) for f in features])
    long = ranged.select("_cur", F.explode(items).alias("x")).where(F.col("x.v").isNotNull())
    place = F.ceil(F.try_divide((F.col("x.v") - F.col("x.lo")) * bins, F.col("x.hi") - F.col("x.lo")))
    b = F.least(F.greatest(F.coalesce(place, F.lit(1)), F.lit(1)), F.lit(bins)).cast("int")
    counts = long.groupBy(F.col("x.feature").alias("feature"), b.alias("bin")).agg(F.count_if(F.col("_cur") == 1).alias("c"), F.count_if(F.col("_cur") == 0).alias("e"))
    w = Window.partitionBy("feature")  # at most ``bins`` rows
    shares = counts.select("feature", F.greatest(F.coalesce(F.try_divide(F.col("c").cast("double"), F.sum("c").over(w)), F.lit(0.0)), F.lit(FLOOR)).alias("a"),
                           F.greatest(F.coalesce(F.try_divide(F.col("e").cast("double"), F.sum("e").over(w)), F.lit(0.0)), F.lit(FLOOR)).alias("e"))
    out = shares.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))
    # fixed values: usual reading of the index
    return out.withColumn("level", F.when(F.col("psi") < 0.1, "ok").when(F.col("psi") < 0.2, "warning").otherwise("critical"))


def ks(current: DataFrame, baseline: DataFrame, feature: str, threshold: float = 0.2) -> DataFrame:
    """Kolmogorov-Smirnov distance of one feature.

    Values are counted first, then a range-partitioned running total gives both distribution
    functions; no task sees more than its range.
    """
    both = current.select(F.col(feature).cast("double").alias("v"), F.lit(1).alias("c"), F.lit(0).alias("b")).unionByName(
        baseline.select(F.col(feature).cast("double").alias("v"), F.lit(0).alias("c"), F.lit(1).alias("b"))).where(F.col("v").isNotNull())
    counts = both.groupBy("v").agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
    upto = running_totals(counts, ["v"], {"cc": F.col("c"), "cb": F.col("b")})
    totals = upto.agg(F.struct(F.sum("c").alias("nc"), F.sum("b").alias("nb")).alias("s")).scalar()
    gap = F.abs(ratio(F.col("cc"), F.col("_s.nc")) - ratio(F.col("cb"), F.col("_s.nb")))
    return upto.withColumn("_s", totals).agg(F.lit(feature).alias("feature"), F.max(gap).alias("ks")).select(
        "feature", "ks", (F.col("ks") > threshold).alias("drifted"))


# ---- day-level signals ----------------------------------------------------------------------------
# Everything below runs over the daily table: one row per day, so day-ordered windows stay tiny.


def drift_signals(daily: DataFrame, lookback: int = 7, baseline_days: int = 3, ood_spike: float = 2.0, coverage_drop: float = 0.2, override_spike: float = 1.0) -> DataFrame:
    """Every day with a full look-back: baseline, current, change and alert of each signal."""
    w = Window.partitionBy(F.lit(0)).orderBy(DAY)
    base = w.rowsBetween(-(lookback - 1), -(lookback - baseline_days))
    out = daily.select(DAY, "ood_rate", "coverage", "override_rate", F.row_number().over(w).alias("_day"),
                       *[F.avg(c).over(base).alias(f"{c}_baseline") for c in ("ood_rate", "coverage", "override_rate")]).where(F.col("_day") >= lookback)

    def rise(c: str) -> Column:
        return (F.col(c) - F.col(f"{c}_baseline")) / (F.col(f"{c}_baseline") + FLOOR)

    out = out.withColumns({"ood_spike": rise("ood_rate"), "coverage_drop": -rise("coverage"), "override_spike": rise("override_rate")})
    out = out.withColumns({"ood_alert": F.col("ood_spike") > ood_spike, "coverage_alert": F.col("coverage_drop") > coverage_drop, "override_alert": F.col("override_spike") > override_spike})
    return out.withColumn("drift_detected", F.col("ood_alert") | F.col("coverage_alert") | F.col("override_alert")).drop("_day")


def alerts(signals: DataFrame) -> DataFrame:
    """One row per firing signal and day."""
    names = [("ood_spike", "ood_rate", "ood_alert"), ("coverage_drop", "coverage", "coverage_alert"), ("override_spike", "override_rate", "override_alert")]
    items = [F.struct(F.lit(s).alias("signal"), F.col(f"{c}_baseline").alias("baseline"), F.col(c).alias("current"), F.col(s).alias("change"), F.col(a).alias("alert")) for s, c, a in names]
    return signals.select(DAY, F.explode(F.array(*items)).alias("s")).where(F.col("s.alert")).select(DAY, "s.signal", "s.baseline", "s.current", "s.change")


def retraining_tickets(signals: DataFrame) -> DataFrame:
    """One ticket per drift day with the firing signals."""
    fired = F.array_compact(F.array(F.when(F.col("ood_alert"), F.lit("ood_spike")), F.when(F.col("coverage_alert"), F.lit("coverage_drop")), F.when(F.col("override_alert"), F.lit("override_spike"))))
    return signals.where("drift_detected").select(DAY, F.concat(F.lit("retrain-"), F.date_format(DAY, "yyyyMMdd")).alias("ticket_id"), F.array_join(fired, ",").alias("reasons"), F.lit("open").alias("status"))


def drift_persistence(signals: DataFrame, days: int = 3) -> DataFrame:
    """Runs of consecutive drift days; ``persistent`` once a run reaches ``days``."""
    w = Window.partitionBy(F.lit(0)).orderBy(DAY)
    hit = signals.where("drift_detected").select(DAY, F.row_number().over(w).alias("_rn"))
    runs = hit.groupBy(F.date_sub(DAY, F.col("_rn")).alias("_run")).agg(F.min(DAY).alias("start_date"), F.max(DAY).alias("end_date"), F.count(F.lit(1)).alias("n_days"))
    return runs.select("start_date", "end_date", "n_days", (F.col("n_days") >= days).alias("persistent"))


def retraining_gate(signals: DataFrame, n_cases: Column, gain_now: Column, gain_base: Column, days: int = 3, min_cases: int = 500, gain_drop: float = 0.3) -> DataFrame:
    """One row: persistent drift, enough cases, expected-gain drop, and the verdict."""
    persistent = drift_persistence(signals, days).agg(F.coalesce(F.bool_or("persistent"), F.lit(False)).alias("drift_persistent"))
    drop = F.coalesce(F.try_divide(gain_base - gain_now, F.abs(gain_base)), F.lit(0.0))
    out = persistent.withColumns({"n_cases": n_cases, "gain_drop": drop})
    out = out.withColumns({"enough_cases": F.col("n_cases") >= min_cases, "gain_dropped": F.col("gain_drop") > gain_drop})
    return out.withColumn("retrain", F.col("enough_cases") & (F.col("drift_persistent") | F.col("gain_dropped")))


# fixed values: (metric, better direction, warning, critical)
THRESHOLDS = (
    ("coverage", "high", 0.85, 0.80),
    ("fallback_rate", "low", 0.10, 0.20),
    ("override_rate", "low", 0.15, 0.25),
    ("ood_rate", "low", 0.10, 0.20),
    ("latency_p95", "low", 20.0, 50.0),
    ("schema_error_rate", "low", 0.005, 0.01),
)
MIN_REQUESTS = 10


def threshold_bands(daily: DataFrame, thresholds: Sequence[tuple[str, str, float, float]] = THRESHOLDS, min_requests: int = MIN_REQUESTS) -> DataFrame:
    """(date, metric, value, band): OK / WARNING / CRITICAL, or INSUFFICIENT below the minimum volume."""
    items = []
    for name, better, warn, crit in thresholds:
        if name not in daily.columns:
            raise ValueError(f"no daily metric {name!r}")
        v = F.col(name)
        bad, worse = (v < warn, v < crit) if better == "high" else (v > warn, v > crit)
        band = F.when(F.col("total_requests") < min_requests, "INSUFFICIENT").when(worse, "CRITICAL").when(bad, "WARNING").otherwise("OK")
        items.append(F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value"), band.alias("band")))
    return daily.select(DAY, F.explode(F.array(*items)).alias("m")).select(DAY, "m.*")


def histogram(df: DataFrame, value: str, max_bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins, at most ``max_bins`` and no more than there are rows."""
    s = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count(value).alias("n")).alias("s")).scalar()
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), s.alias("s"))
    k = F.greatest(F.least(F.lit(max_bins), F.col("s.n")), F.lit(1))
    b = F.least(F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("s.lo")) * k, F.col("s.hi") - F.col("s.lo"))), F.lit(0)), k - 1).cast("int")
    n = rows.groupBy(b.alias("bin"), "s", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("s.hi") - F.col("s.lo")) / F.col("k")
    return n.select("bin", (F.col("s.lo") + F.col("bin") * width).alias("lo"), (F.col("s.lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def dashboard_series(daily: DataFrame, metrics: Sequence[str] = ("coverage", "fallback_rate", "override_rate", "ood_rate", "latency_p95", "confidence_mean")) -> DataFrame:
    """(date, metric, value) lines."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics if m in daily.columns]
    return daily.select(DAY, F.explode(F.array(*items)).alias("m")).select(DAY, "m.*")


def last_day_actions(distribution: DataFrame) -> DataFrame:
    """Action bars of the latest day."""
    last = distribution.agg(F.max(DAY).alias("d")).scalar()
    return distribution.withColumn("_d", last).where(F.col(DAY) == F.col("_d")).drop("_d")


