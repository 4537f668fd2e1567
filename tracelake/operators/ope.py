"""Off-policy evaluation: all policies in one pass, confidence intervals by case resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.hashing import hash_long, hash_unit, seeded_md5
from ..plans.ranking import hash_rank, percentiles
from .clean import CASE
from ..session import stored_table
from .values import poisson_count, softmax_policy, value

RHO_CAP = 20.0
PI_FLOOR = 1e-6


def importance_ratio(pi_e_a: Column, pi_b_a: Column, cap: float = RHO_CAP) -> Column:
    return F.greatest(F.least(pi_e_a / F.greatest(pi_b_a, F.lit(PI_FLOOR)), F.lit(cap)), F.lit(0.0))


def policy_steps(df: DataFrame, policies: Mapping[str, Column], cap: float = RHO_CAP, v: str = "greedy", group: str = "policy") -> DataFrame:
    """One row per (transition, policy) with rho and the doubly robust step.

    ``df`` has q, pi_b, valid_actions, a, r. ``v="policy"`` uses the policy's own expected value
    instead of the greedy one.
    """
    q, a = F.col("q"), F.col("a")
    items = []
    for name, pi in policies.items():
        expected = A.array_sum(F.zip_with(pi, q, lambda p, x: p * x)) if v == "policy" else F.col("_v")
        items.append(F.struct(F.lit(name).alias("name"), A.at(pi, a).alias("pi_a"), expected.alias("v")))
    base = df.withColumn("_v", value(q, F.col("valid_actions")))
    long = base.select(CASE, "r", A.at(q, a).alias("q_sa"), A.at(F.col("pi_b"), a).alias("pi_b_a"), F.explode(F.array(*items)).alias("p"))
    rho = importance_ratio(F.col("p.pi_a"), F.col("pi_b_a"), cap)
    stepped = long.select(CASE, F.col("p.name").alias(group), F.col("r").cast("double").alias("r"), "q_sa", F.col("p.v").alias("v"), rho.alias("rho"))
    return stepped.withColumn("dr", F.col("rho") * (F.col("r") - F.col("q_sa")) + F.col("v"))


def evaluate(steps: DataFrame, group: str = "policy", with_percentiles: bool = True) -> DataFrame:
    """One row per policy: DR, WIS, effective sample size, rho percentiles, observed reward, diagnostics."""
    rho = F.col("rho")
    agg = steps.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dr").alias("dr_mean"), F.sum(rho * F.col("r")).alias("_num"), F.sum(rho).alias("_den"),
        F.sum(rho * rho).alias("_sq"), F.avg("r").alias("observed_reward"), F.avg("q_sa").alias("q_sa_mean"),
        F.stddev_pop("q_sa").alias("q_sa_std"), F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_std"))
    ess = F.coalesce(F.try_divide(F.col("_den") * F.col("_den"), F.col("_sq")), F.lit(0.0))
    out = agg.select(
        group, "n", "dr_mean", (F.col("_num") / F.when(F.col("_den") > 0, F.col("_den")).otherwise(F.lit(1.0))).alias("wis_mean"),
        ess.alias("ess"), (ess / F.col("n")).alias("ess_fraction"), "observed_reward", "q_sa_mean", "q_sa_std", "v_mean", "v_std")
    if not with_percentiles:
        return out
    # fixed values: reported percentiles of the truncated ratio
    probs = {"rho_p50": 0.50, "rho_p75": 0.75, "rho_p90": 0.90, "rho_p95": 0.95, "rho_p99": 0.99}
    return out.join(percentiles(steps, "rho", probs, [group]), group)


def case_sums(steps: DataFrame, group: str = "policy") -> DataFrame:
    """Sufficient sums per (policy, case): all a resampled estimate needs."""
    return steps.groupBy(group, CASE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dr").alias("s_dr"), F.sum("rho").alias("s_rho"), F.sum(F.col("rho") * F.col("r")).alias("s_rr"))


def bootstrap(steps: DataFrame, replicates: int = 200, seed: int = 42, method: str = "multinomial", group: str = "policy") -> DataFrame:
    """95 % intervals of DR and WIS by resampling cases, one row per policy.

    ``multinomial`` draws n cases per replicate through hashed ordinals, exactly as a cluster
    bootstrap does; draws and case sums meet in one shuffle, by the drawn ordinal. ``poisson`` gives every case an
    independent Poisson(1) multiplicity per replicate and needs no draws join, for very many cases.
    """
    # every case becomes ``replicates`` rows here, so the work is spread before it grows
    spark = steps.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    # a handful of structs per case; a draw holds for all policies
    per_case = F.collect_list(F.struct(group, "n", "s_dr", "s_rho", "s_rr")).alias("_p")
    if method == "multinomial":
        # stored by the ranking; everything below reads that table and not the log
        ranked = hash_rank(case_sums(steps, group).groupBy(CASE).agg(per_case), f"{seed}:order", [CASE], rank="_rank")
        n = ranked.count()
        # ranks are 1..n, so the ordinals that draw need no table
        draws = spark.range(0, n, 1, tasks).select("id", each.alias("b")).select("b", (hash_long(seeded_md5(seed, "b", "id")) % max(n, 1)).alias("i"))
        # draws are ``replicates`` times the cases, which their estimate does not see: without the hint they would be broadcast
        cases = ranked.where(F.col(CASE).isNotNull()).select((F.col("_rank") - 1).cast("long").alias("i"), "_p")
        weighted = draws.join(cases.hint("shuffle_hash"), "i").select("b", F.lit(1).alias("m"), F.inline("_p"))
    elif method == "poisson":
        # one row per policy and case; everything below reads this table and not the log
        sums = stored_table(case_sums(steps, group))
        wide = sums.groupBy(CASE).agg(per_case).repartition(tasks, CASE)
        # no filter on the count: pushed below, it would evaluate the digest once per reference
        drawn = wide.select(CASE, "_p", each.alias("b")).withColumn("_u", hash_unit(seed, "b", CASE)).withColumn("m", poisson_count(F.col("_u"), 1.0))
        weighted = drawn.select("b", "m", F.inline("_p"))
    else:
        raise ValueError(f"unknown method {method!r}")
    m = F.col("m")
    est = weighted.groupBy(group, "b").agg(
        F.sum(m * F.col("n")).alias("n"), F.sum(m * F.col("s_dr")).alias("s_dr"), F.sum(m * F.col("s_rho")).alias("s_rho"), F.sum(m * F.col("s_rr")).alias("s_rr"))
    est = est.where(F.col("n") > 0).select(group, (F.col("s_dr") / F.col("n")).alias("dr"),
                     (F.col("s_rr") / F.when(F.col("s_rho") > 0, F.col("s_rho")).otherwise(F.lit(1.0))).alias("wis"))
    # one value per replicate: a few hundred rows per policy
    return est.groupBy(group).agg(
        F.percentile("dr", 0.025).alias("dr_lo"), F.percentile("dr", 0.975).alias("dr_hi"),
        F.percentile("wis", 0.025).alias("wis_lo"), F.percentile("wis", 0.975).alias("wis_hi"), F.count(F.lit(1)).alias("n_replicates"))


def temperature_grid(df: DataFrame, taus: Sequence[float], cap: float = RHO_CAP) -> DataFrame:
    """DR / WIS / ESS of the softmax policy for several temperatures in one pass."""
    policies = {str(t): softmax_policy(F.col("q"), F.col("valid_actions"), t) for t in taus}
    return evaluate(policy_steps(df, policies, cap, group="tau"), "tau", with_percentiles=False)


def report(results: DataFrame, group: str = "policy", **metadata: str) -> DataFrame:
    """Long metrics table (policy, metric, value, metadata json)."""
    names = [c for c in results.columns if c != group]
    meta = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])) if metadata else F.lit("{}")
    long = results.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m"))
    return long.select(group, "m.metric", "m.value", meta.alias("metadata"))
