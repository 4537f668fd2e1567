"""Case splits with exact quotas, their validation and drift between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..plans.ranking import global_rank, hash_rank
from ..plans.sequence import ordered
from .clean import CASE

RATIOS = (0.7, 0.1, 0.2)


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {ratios}")


def _assign(rank: Column, n: Column, ratios: tuple[float, float, float], at_least_one: bool) -> Column:
    """Floored quotas; the random method guarantees a train and a val case once there are three."""
    n_train = F.floor(n * F.lit(ratios[0])).cast("long")
    n_val = F.floor(n * F.lit(ratios[1])).cast("long")
    if at_least_one:
        n_train = F.when((n >= 3) & (n_train < 1), F.lit(1)).otherwise(n_train)
        n_val = F.when((n >= 3) & (n_val < 1) & (n - n_train >= 2), F.lit(1)).otherwise(n_val)
    return F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")


def split_random(cases: DataFrame, seed: int = 42, ratios: tuple[float, float, float] = RATIOS, case: str = CASE) -> DataFrame:
    """(case_id, split) by seeded hash order."""
    check_ratios(ratios)
    ranked = hash_rank(cases.select(case).distinct(), seed, [case], rank="_rank", size="_n")
    return ranked.select(case, _assign(F.col("_rank"), F.col("_n"), ratios, True).alias("split"))


def split_temporal(starts: DataFrame, ratios: tuple[float, float, float] = RATIOS, case: str = CASE) -> DataFrame:
    """(case_id, split) by case start: earliest cases train, latest test."""
    check_ratios(ratios)
    ranked = global_rank(starts.select(case, "start_ts"), ["start_ts", case], "_rank")
    total = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = ranked.withColumn("_n", total)
    return sized.select(case, "start_ts", _assign(F.col("_rank"), F.col("_n"), ratios, False).alias("split"))


def split_manifest(splits: DataFrame, method: str, seed: int, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """One row per split: method, seed, ratio and case count."""
    want = F.create_map(*[x for s, r in zip(("train", "val", "test"), ratios) for x in (F.lit(s), F.lit(r))])
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n_cases")).select(
        "split", "n_cases", F.lit(method).alias("method"), F.lit(seed).alias("seed"),
        F.try_element_at(want, F.col("split")).alias("ratio"))


def split_checks(splits: DataFrame, cases: DataFrame, case: str = CASE) -> DataFrame:
    """One row: cases in several splits, cases without a split, split cases that do not exist."""
    known = cases.select(case).distinct().withColumn("_known", F.lit(1))
    # min <> max detects overlap; numbers instead of names keep the aggregate hash-based
    code = F.xxhash64("split")
    seen = splits.groupBy(case).agg(F.min(code).alias("_lo"), F.max(code).alias("_hi"))
    both = known.join(seen, case, "full")
    return both.agg(
        F.count_if(F.col("_lo") != F.col("_hi")).alias("n_overlapping"),
        F.count_if(F.col("_lo").isNull()).alias("n_uncovered"),
        F.count_if(F.col("_known").isNull()).alias("n_unknown"))


def split_overlaps(splits: DataFrame, case: str = CASE) -> DataFrame:
    """(pair, n_shared) for every pair of splits."""
    per_case = splits.groupBy(case).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    one = per_case.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}") for a, b in pairs])
    items = [F.struct(F.lit(f"{a}&{b}").alias("pair"), F.col(f"{a}_{b}").alias("n_shared")) for a, b in pairs]
    return one.select(F.explode(F.array(*items)).alias("v")).select("v.*")


def split_profile(tr: DataFrame, splits: DataFrame, n_actions: int, case: str = CASE) -> DataFrame:
    """Per split: cases, transitions, episode length, terminal reward, action shares.

    The length of an episode is the largest t of the case, whether or not earlier steps were kept. A
    case ends once, so its terminal reward is one value. Transitions collapse to one row per case before they meet the split table.
    """
    r, done = F.col("r").cast("double"), F.col("done") == 1
    per_case = tr.groupBy(case).agg(
        F.count(F.lit(1)).alias("kept"), F.max("t").alias("len"), F.sum(F.col("done").cast("long")).alias("d"), F.sum(F.when(done, r)).alias("tr"),
        *[F.count_if(F.col("a") == i).alias(f"a{i}") for i in range(n_actions)])
    agg = per_case.join(splits.select(case, "split"), case).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("kept").alias("n_transitions"), F.avg("len").alias("episode_len_mean"),
        F.stddev_pop("len").alias("episode_len_std"), F.sum("d").alias("d"), F.sum("tr").alias("tr"), F.stddev_pop("tr").alias("tr_std"),
        *[F.sum(f"a{i}").alias(f"a{i}") for i in range(n_actions)])
    d, n = F.col("d").cast("double"), F.col("n_transitions").cast("double")
    mean = F.try_divide(F.col("tr"), d)
    return agg.select(
        "split", "n_cases", "n_transitions", "episode_len_mean", "episode_len_std", (100.0 * F.col("d") / n).alias("done_pct"),
        mean.alias("terminal_reward_mean"),
        F.col("tr_std").alias("terminal_reward_std"),
        *[(F.col(f"a{i}") / n).alias(f"action_{i}_rate") for i in range(n_actions)])


def split_totals(tr: DataFrame, splits: DataFrame, by: str = "last_activity", case: str = CASE) -> DataFrame:
    """Transitions per split and ``by`` with totals per split and over all: ``level`` 0, 1 and 3 as GROUPING_ID has them.

    The transitions are aggregated once, to the finest groups; totals add up their moments and sketches. Rewards have
    mean and population deviation from mergeable sums of squares around the groups' means; ``cases_about`` is an estimate from a sketch (1.6 %
    standard error). A NULL of ``by`` is a group, not a total, which the level tells.
    """
    r = F.col("r").cast("double")
    finest = tr.join(splits.select(case, "split"), case).groupBy("split", by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("done").cast("long")).alias("d"), F.avg(r).alias("mean"), F.var_pop(r).alias("var"),
        F.hll_sketch_agg(F.col(case).cast("string"), 12).alias("sketch"))
    n, mean = F.col("n").cast("double"), F.col("mean")
    # from here on there is one row per finest group
    total = finest.rollup("split", by).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n_transitions"), F.sum("d").alias("n_done"), F.sum(n * mean).alias("_s"),
        F.sum(n * F.col("var")).alias("_within"), F.collect_list(F.struct(n.alias("n"), mean.alias("m"))).alias("_groups"), F.hll_union_agg("sketch").alias("_sketch"))
    whole = F.col("_s") / F.col("n_transitions")
    between = F.aggregate("_groups", F.lit(0.0), lambda acc, g: acc + g["n"] * (g["m"] - whole) * (g["m"] - whole))
    return total.select(
        "split", by, "level", "n_transitions", "n_done", whole.alias("reward_mean"), F.sqrt((F.col("_within") + between) / F.col("n_transitions")).alias("reward_std"),
        F.hll_sketch_estimate("_sketch").alias("cases_about"))


def episode_drift(profile: DataFrame, threshold_pct: float = 20.0) -> DataFrame:
    """Change of mean episode length, train to test; the profile has one row per split."""
    one = profile.agg(
        F.max(F.when(F.col("split") == "train", F.col("episode_len_mean"))).alias("train_mean"),
        F.max(F.when(F.col("split") == "test", F.col("episode_len_mean"))).alias("test_mean"))
    drift = 100.0 * F.try_divide(F.abs(F.col("test_mean") - F.col("train_mean")), F.col("train_mean"))
    return one.withColumn("drift_pct", drift).withColumn("flagged", F.coalesce(F.col("drift_pct") > threshold_pct, F.lit(False)))


def monotonic_violations(tr: DataFrame, case: str = CASE, tie: str = "t") -> DataFrame:
    """Repeated (case_id, t) keys: with t as the order, these are the only way t can fail to increase."""
    return tr.groupBy(case, tie).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def position_order_violations(tr: DataFrame, order: list[str], case: str = CASE) -> DataFrame:
    """One row: steps whose t does not exceed the previous t in event order."""
    seq = ordered(tr, order, case, lag={"_prev": F.col("t")}, position="_pos", count="_n")
    return seq.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("t") <= F.col("_prev")).alias("n_not_increasing"))


def continuity_gaps(tr: DataFrame, case: str = CASE) -> DataFrame:
    """Non-terminal (case_id, t) without a (case_id, t + 1) row."""
    starts = tr.select(case, (F.col("t") - 1).alias("t"))
    return tr.where(F.col("done") == 0).select(case, "t").join(starts, [case, "t"], "left_anti")


def reward_sanity(tr: DataFrame, expected_intermediate: float = 0.0) -> DataFrame:
    """One row: non-terminal rewards off the expected value; terminal mean and population deviation."""
    r, done = F.col("r").cast("double"), F.col("done") == 1
    return tr.agg(
        F.count_if(~done & (r != expected_intermediate)).alias("n_bad_intermediate"), F.count_if(done).alias("n_terminal"),
        F.avg(F.when(done, r)).alias("terminal_mean"), F.stddev_pop(F.when(done, r)).alias("terminal_std"))


def structure_violations(tr: DataFrame, max_len: int, n_actions: int, required: tuple[str, ...] = (
        "s", "s_mask", "a", "r", "s_next", "s_next_mask", "done", CASE, "t", "valid_actions")) -> DataFrame:
    """Long table (check, n): missing columns, empty set, widths, mask values, actions, flags, t."""
    missing = [c for c in required if c not in tr.columns]
    checks: dict[str, Column] = {"empty": (F.count(F.lit(1)) == 0).cast("long")}
    for c in ("s", "s_mask", "s_next", "s_next_mask"):
        if c in tr.columns:
            checks[f"width:{c}"] = F.count_if(F.size(c) != max_len)
    for c in ("s_mask", "s_next_mask"):
        if c in tr.columns:
            checks[f"binary:{c}"] = F.count_if(F.exists(c, lambda x: ~x.isin(0, 1)))
    if "valid_actions" in tr.columns:
        checks["width:valid_actions"] = F.count_if(F.size("valid_actions") != n_actions)
        if "a" in tr.columns:
            checks["invalid_action"] = F.count_if(F.coalesce(A.at(F.col("valid_actions"), F.col("a")), F.lit(0)) != 1)
    if "done" in tr.columns:
        checks["binary:done"] = F.count_if(~F.col("done").isin(0, 1))
    if "t" in tr.columns:
        checks["negative:t"] = F.count_if(F.col("t") < 0)
    one = tr.agg(*[c.alias(f"_{i}") for i, c in enumerate(checks.values())])
    items = [F.struct(F.lit(k).alias("check"), F.col(f"_{i}").alias("n")) for i, k in enumerate(checks)]
    items += [F.struct(F.lit(f"missing:{c}").alias("check"), F.lit(1).cast("long").alias("n")) for c in missing]
    return one.select(F.explode(F.array(*items)).alias("v")).select("v.*")


def require_sound(tr: DataFrame, max_len: int, n_actions: int) -> DataFrame:
    bad = structure_violations(tr, max_len, n_actions).where("n > 0").collect()  # one row per check
    if bad:
        raise ValueError("; ".join(f"{r['check']}={r['n']}" for r in bad))
    return tr
