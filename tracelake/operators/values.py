"""Action values and policies over a column ``q array<double>`` (one value per action).

Values may come from any scorer. The tables here are estimated from transitions, keyed by a small
state description: last activity, prefix-length bin and whether the trigger already happened.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.hashing import hash_unit
from ..plans.sizing import dimension
from ..session import stored
from .clean import CASE

# fixed values: lower bounds of the prefix-length bins
LENGTH_BINS = (0, 5, 10)
KEY = ("last_activity", "len_bin", "seen")


def length_bin(t: Column) -> Column:
    return F.when(t < LENGTH_BINS[1], 0).when(t < LENGTH_BINS[2], 1).otherwise(2)


def with_state(tr: DataFrame, trigger: str | None = None) -> DataFrame:
    """Add the state key, and with ``trigger`` the key and mask-bearing activity of the next state."""
    out = tr.withColumns({"len_bin": length_bin(F.col("t")), "seen": F.col("n_trigger") > 0})
    if trigger is None:
        return out
    return out.withColumns({
        "next_len_bin": length_bin(F.col("t") + 1), "next_seen": (F.col("n_trigger") > 0) | (F.col("next_activity") == trigger)})


def discounted_return(gamma: float = 0.99) -> Column:
    """Terminal outcome discounted by the steps still to go."""
    return F.pow(F.lit(gamma), F.col("n_events") - 1 - F.col("t")) * F.col("outcome")


def state_cells(tr: DataFrame, gamma: float = 0.99, train: Column | None = None) -> DataFrame:
    """Sums per (state, action) in one pass: return sum ``s``, count ``c`` and count ``c_train``.

    This is all the value and behaviour tables need. Transitions collapse map-side; the result has
    one row per activity, length bin, trigger flag and action, and is stored for its readers.
    """
    keyed = with_state(tr).withColumns({"_g": discounted_return(gamma), "_train": train if train is not None else F.lit(True)})
    return stored(keyed.groupBy(*KEY, "a").agg(F.sum("_g").alias("s"), F.count(F.lit(1)).alias("c"), F.count_if("_train").alias("c_train")))


def return_table(cells: DataFrame, n_actions: int) -> DataFrame:
    """Monte-Carlo values from :func:`state_cells`: mean discounted return as one q array per state.

    Unseen combinations fall back to the activity's mean, then the action's mean, then 0; the row
    with an empty activity holds the overall fallback.
    """

    def sums(name: str) -> list[Column]:
        return [F.array(*[F.coalesce(F.sum(F.when(F.col("a") == i, F.col(c))), F.lit(0)).cast("double") for i in range(n_actions)]).alias(f"{name}_{c}") for c in ("s", "c")]

    by_state = cells.groupBy(*KEY).agg(*sums("st"))
    by_activity = cells.groupBy("last_activity").agg(*sums("ac"))
    overall = cells.agg(F.struct(*sums("all")).alias("o")).scalar()
    # at most six states per activity
    grid = (
        by_activity.select("last_activity", "ac_s", "ac_c")
        .unionByName(by_activity.agg(F.lit("").alias("last_activity"), F.lit(None).cast("array<double>").alias("ac_s"), F.lit(None).cast("array<double>").alias("ac_c")))
        .withColumn("len_bin", F.explode(F.array(*[F.lit(i) for i in range(3)])))
        .withColumn("seen", F.explode(F.array(F.lit(False), F.lit(True))))
    )
    full = grid.join(by_state, list(KEY), "left").withColumn("o", overall)

    def mean(name: str, i: int) -> Column:
        return F.try_divide(F.get(F.col(f"{name}_s"), F.lit(i)), F.get(F.col(f"{name}_c"), F.lit(i)))

    full = full.withColumns({"all_s": F.col("o.all_s"), "all_c": F.col("o.all_c")})
    return full.select(
        *KEY, F.array(*[F.coalesce(mean("st", i), mean("ac", i), mean("all", i), F.lit(0.0)) for i in range(n_actions)]).alias("q"),
        F.transform(F.coalesce(F.col("st_c"), F.array_repeat(F.lit(0.0), n_actions)), lambda x: x.cast("long")).alias("support"))


def score(states: DataFrame, q_table: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Attach q by state key; unknown states get the fallback row. The table is broadcast once it proves small."""
    table = dimension(q_table)
    fallback = table.where((F.col("last_activity") == "") & (F.col("len_bin") == 0) & ~F.col("seen")).select("q").scalar()
    lookup = table.select(*[F.col(k).alias(n) for k, n in zip(KEY, key)], F.col("q").alias("_q"))
    return states.join(lookup, list(key), "left").withColumn("q", F.coalesce(F.col("_q"), fallback)).drop("_q")


def sweep_table(
    tr: DataFrame, n_actions: int, trigger: str, masks: dict[str, Sequence[int]], default_mask: Sequence[int],
    gamma: float = 0.99, sweeps: int = 3, target_every: int = 2,
) -> DataFrame:
    """Fitted values by repeated one-step targets with separate selection and evaluation tables.

    target = r + gamma (1 - done) Q_target(s', argmax over actions valid in s' of Q_online(s', a)).
    A sweep is linear in the transitions, so they are counted once per (state, action, next state)
    and every sweep runs on those counts; each sweep's table is stored to cut the lineage.
    """
    keyed = with_state(tr, trigger)
    # the outcome enters only through r, so counts and reward sums are sufficient
    counts = stored(
        keyed.groupBy(*KEY, "a", F.col("next_activity").alias("n_act"), F.col("next_len_bin").alias("n_bin"), F.col("next_seen").alias("n_seen"), "done")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("r").alias("sr")))
    mask = F.array(*[F.lit(int(v)) for v in default_mask])
    for name, flags in masks.items():
        mask = F.when(F.col("n_act") == name, F.array(*[F.lit(int(v)) for v in flags])).otherwise(mask)
    counts = counts.withColumn("n_valid", mask)
    zero = F.array_repeat(F.lit(0.0), n_actions)
    online = counts.select(*KEY).distinct().withColumn("q", zero)
    target = online
    for k in range(sweeps):
        if k and k % target_every == 0:
            target = online
        on, tg = dimension(online), dimension(target)
        nxt = (
            counts
            .join(on.select(F.col("last_activity").alias("n_act"), F.col("len_bin").alias("n_bin"), F.col("seen").alias("n_seen"), F.col("q").alias("q_on")), ["n_act", "n_bin", "n_seen"], "left")
            .join(tg.select(F.col("last_activity").alias("n_act"), F.col("len_bin").alias("n_bin"), F.col("seen").alias("n_seen"), F.col("q").alias("q_tg")), ["n_act", "n_bin", "n_seen"], "left")
            .withColumns({"q_on": F.coalesce("q_on", zero), "q_tg": F.coalesce("q_tg", zero)})
        )
        best = greedy_action(F.col("q_on"), F.col("n_valid"))
        boot = F.when(F.col("done") == 1, 0.0).otherwise(gamma * A.at(F.col("q_tg"), best))
        summed = nxt.groupBy(*KEY, "a").agg(F.sum(F.col("sr") + F.col("c") * boot).alias("s"), F.sum("c").alias("c"))
        online = stored(summed.groupBy(*KEY).agg(F.array(*[
            F.coalesce(F.max(F.when(F.col("a") == i, F.col("s") / F.col("c"))), F.lit(0.0)) for i in range(n_actions)]).alias("q")))
    return online


# ---- row expressions ------------------------------------------------------------------------------


def value(q: Column, valid: Column) -> Column:
    return F.array_max(A.masked(q, valid))


def greedy_action(q: Column, valid: Column) -> Column:
    """Best valid action, first on ties."""
    m = A.masked(q, valid)
    return A.first_index(m, F.array_max(m))


def margin(q: Column, valid: Column) -> Column:
    """Best minus second-best valid value; 0 when at most one action is valid."""
    best = F.sort_array(A.masked(q, valid), asc=False)
    return F.when(A.n_valid(valid) > 1, F.get(best, F.lit(0)) - F.get(best, F.lit(1))).otherwise(F.lit(0.0))


def contrast_id(actions: Sequence[str], action_id: int | None = None, baseline: str = "NOOP") -> int:
    """Contrast action: explicit id, then a no-op alias, then by name, then 0."""
    if action_id is not None:
        return action_id
    # fixed values: names that mean "no intervention"
    if baseline in ("NOOP", "noop", "do_nothing", "no_op"):
        return 0
    return actions.index(baseline) if baseline in actions else 0


def contrast_action(valid: Column, a_star: Column, contrast: int) -> Column:
    """Per row: the contrast action if valid, else the first valid one, else the greedy one."""
    return F.coalesce(F.when(A.at(valid, F.lit(contrast)) > 0, F.lit(contrast)), A.first_valid(valid), a_star).cast("int")


def with_greedy(df: DataFrame, contrast: int = 0, q: str = "q", valid: str = "valid_actions") -> DataFrame:
    """Add v, a_star, q_star, margin, contrast action, its flags and delta_q (on unmasked values)."""
    qc, vc = F.col(q), F.col(valid)
    out = df.withColumns({"v": value(qc, vc), "a_star": greedy_action(qc, vc), "margin": margin(qc, vc)})
    out = out.withColumns({
        "q_star": A.at(qc, F.col("a_star")), "a_contrast": contrast_action(vc, F.col("a_star"), contrast),
        "contrast_valid": A.at(vc, F.lit(contrast)) > 0})
    return out.withColumns({
        "contrast_fallback_used": ~F.col("contrast_valid"), "q_contrast": A.at(qc, F.col("a_contrast")),
        "delta_q": F.col("q_star") - A.at(qc, F.col("a_contrast"))})


def softmax_policy(q: Column, valid: Column, tau: Column | float = 1.0) -> Column:
    """Temperature softmax over valid actions, shifted by the maximum."""
    t = F.greatest(F.lit(tau) if isinstance(tau, (int, float)) else tau, F.lit(1e-6))
    m = A.masked(q, valid)
    top = F.array_max(m)
    e = F.transform(m, lambda x: F.exp((x - top) / t))
    total = F.greatest(A.array_sum(e), F.lit(1e-12))
    return F.transform(e, lambda x: x / total)


def _one_hot(index: Column, n: int) -> Column:
    return F.array(*[F.when(index == i, 1.0).otherwise(0.0) for i in range(n)])


def _uniform(valid: Column, n: int) -> Column:
    k = A.n_valid(valid)
    share = F.transform(valid, lambda v: F.when(v > 0, F.lit(1.0) / k).otherwise(F.lit(0.0)))
    return F.when(k > 0, share).otherwise(F.array_repeat(F.lit(1.0 / n), n))


def noop_policy(valid: Column, noop: int, n: int) -> Column:
    return F.when(A.at(valid, F.lit(noop)) > 0, _one_hot(F.lit(noop), n)).otherwise(_uniform(valid, n))


def heuristic_policy(valid: Column, length: Column, n: int, threshold: int = 5, short: int = 0, long: int = 1) -> Column:
    """Short prefixes take one action, long ones another; invalid choices give way to the first valid."""
    want = F.when(length < threshold, F.lit(short)).otherwise(F.lit(long))
    pick = F.when(A.at(valid, want) > 0, want).otherwise(A.first_valid(valid))
    return F.when(A.n_valid(valid) > 0, _one_hot(pick, n)).otherwise(F.array_repeat(F.lit(1.0 / n), n))


# ---- behaviour policy -----------------------------------------------------------------------------


def behavior_table(cells: DataFrame, n_actions: int, smoothing: float = 1.0) -> DataFrame:
    """Additively smoothed action shares per state over the training part of :func:`state_cells`."""
    n = cells.groupBy(*KEY).agg(
        F.sum("c_train").alias("n"), F.array(*[F.coalesce(F.sum(F.when(F.col("a") == i, F.col("c_train"))), F.lit(0)) for i in range(n_actions)]).alias("counts"))
    p = F.transform("counts", lambda c: (c + F.lit(smoothing)) / (F.col("n") + F.lit(smoothing * n_actions)))
    return n.where(F.col("n") > 0).select(*KEY, p.alias("p"))


def mask_renormalise(p: Column, valid: Column, n: int) -> Column:
    kept = F.zip_with(p, valid, lambda x, v: F.when(v > 0, x).otherwise(F.lit(0.0)))
    total = A.array_sum(kept)
    return F.when(total > 0, F.transform(kept, lambda x: x / total)).otherwise(_uniform(valid, n))


def with_behavior(df: DataFrame, table: DataFrame, n_actions: int) -> DataFrame:
    """Add ``pi_b``: table shares renormalised over valid actions; unseen states are uniform."""
    lookup = dimension(table)
    p = F.coalesce(F.col("p"), F.array_repeat(F.lit(1.0 / n_actions), n_actions))
    return df.join(lookup, list(KEY), "left").withColumn("pi_b", mask_renormalise(p, F.col("valid_actions"), n_actions)).drop("p")


def behavior_logistic(train: DataFrame, rows: DataFrame, features: Sequence[str], n_actions: int, max_iter: int = 20, reg: float = 0.0, raw: str | None = None) -> DataFrame:
    """Multinomial logistic propensities fitted on ``train`` and attached to ``rows`` as ``pi_b``; as ``raw`` before the mask."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    model = LogisticRegression(featuresCol="_x", labelCol="a", family="multinomial", maxIter=max_iter, regParam=reg,
                               probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw").fit(
        assemble.transform(train.withColumn("a", F.col("a").cast("double"))))
    out = model.transform(assemble.transform(rows)).withColumn("_p", vector_to_array("_prob"))
    # classes never seen in training have no column in the model
    full = F.transform(F.sequence(F.lit(0), F.lit(n_actions - 1)), lambda i: F.coalesce(F.get(F.col("_p"), i), F.lit(0.0)))
    out = out.withColumns({"pi_b": mask_renormalise(full, F.col("valid_actions"), n_actions), **({raw: full} if raw else {})})
    return out.drop("_x", "_prob", "_pred", "_raw", "_p")


def logistic_certificate(train: DataFrame, features: Sequence[str], n_actions: int, raw: str) -> DataFrame:
    """One row: training rows and the steepest slope of the mean log-likelihood in any weight, per deviation of its feature.

    At the maximum every action's predicted and logged counts agree, alone and weighted with each feature, so
    the slope is 0. Without a penalty only.
    """
    miss = [A.at(F.col(raw), F.lit(k)) - (F.col("a") == k).cast("double") for k in range(n_actions)]
    slopes = [F.abs(F.avg(m)) for m in miss]
    slopes += [F.abs(F.try_divide(F.avg(m * F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double")))) for m in miss for c in features]
    return train.agg(F.count(F.lit(1)).alias("n"), F.greatest(*slopes).alias("steepest"))


def behavior_diagnostics(df: DataFrame) -> DataFrame:
    """One row: negative log likelihood, accuracy, mean entropy of ``pi_b`` on logged actions."""
    p_a = A.at(F.col("pi_b"), F.col("a"))
    nll = F.least(F.greatest(-F.log(F.greatest(p_a, F.lit(1e-8))), F.lit(0.0)), F.lit(1e6))
    ent = -A.array_sum(F.transform("pi_b", lambda p: p * F.log(F.greatest(p, F.lit(1e-8)))))
    hit = (A.first_index(F.col("pi_b"), F.array_max("pi_b")) == F.col("a")).cast("double")
    return df.agg(F.avg(nll).alias("nll"), F.avg(hit).alias("accuracy"), F.avg(ent).alias("entropy"), F.count(F.lit(1)).alias("n"))


# ---- value audits and replay ----------------------------------------------------------------------


def q_stats(df: DataFrame, n_actions: int, q: str = "q") -> DataFrame:
    """One row over all (row, action) values: mean, sample std, min, max, mean magnitude."""
    return df.select(F.explode(q).alias("x")).agg(
        F.avg("x").alias("q_mean"), F.stddev_samp("x").alias("q_std"), F.min("x").alias("q_min"), F.max("x").alias("q_max"),
        F.avg(F.abs("x")).alias("q_abs_mean"))


def td_errors(df: DataFrame, gamma: float = 0.99, delta: float = 1.0) -> DataFrame:
    """One row: mean error, mean magnitude and mean Huber loss of q against one-step targets.

    ``df`` carries q, q_next and next_valid.
    """
    nxt = A.at(F.col("q_next"), greedy_action(F.col("q_next"), F.col("next_valid")))
    target = F.col("r") + F.when(F.col("done") == 1, 0.0).otherwise(gamma * nxt)
    e = A.at(F.col("q"), F.col("a")) - target
    huber = F.when(F.abs(e) <= delta, e * e / 2).otherwise(delta * (F.abs(e) - delta / 2))
    return df.agg(F.avg(e).alias("td_mean"), F.avg(F.abs(e)).alias("td_abs_mean"), F.avg(huber).alias("huber"), F.count(F.lit(1)).alias("n"))


def replay_sample(df: DataFrame, fraction: float, seed: int = 42, with_replacement: bool = True, keys: Sequence[str] = (CASE, "t")) -> DataFrame:
    """Uniform replay: every row is drawn a hash-decided number of times.

    Without replacement a row is in when its uniform number is under ``fraction``; with replacement
    its multiplicity is Poisson(``fraction``) by inverse distribution.
    """
    u = hash_unit(seed, *keys)
    if not with_replacement:
        if fraction > 1:
            raise ValueError("without replacement the fraction is at most 1")
        return df.where(u < fraction)
    most = len(poisson_steps(fraction))
    # slicing 1..most instead of filtering: a filter on the count would be pushed below and repeat the hash
    counted = df.withColumn("_u", u).withColumn("_m", poisson_count(F.col("_u"), fraction)).drop("_u")
    return counted.withColumn("draw", F.explode(F.slice(F.sequence(F.lit(1), F.lit(most)), F.lit(1), F.col("_m")))).drop("_m")


def poisson_steps(rate: float) -> list[float]:
    """Distribution function of Poisson(rate) at 0, 1, ..., until less than 2^-53 is left above."""
    steps, total, k = [], 0.0, 0
    while True:
        p = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else 1.0
        total += p
        steps.append(min(total, 1.0))
        if k >= rate and p * (k + 1) < 2.0 ** -53 * max(1.0, k + 1 - rate):
            return steps
        k += 1


def poisson_count(u: Column, rate: float) -> Column:
    """Poisson(rate) by inverting the distribution at u, without an upper limit for u < 1.

    The lambda binds the number once; written into the filter itself, its digest would be computed per step.
    """
    steps = F.array(*[F.lit(s) for s in poisson_steps(rate)])
    return F.transform(F.array(u), lambda x: F.size(F.filter(steps, lambda s: s <= x)))[0]


def balanced_weights(df: DataFrame, n_actions: int) -> DataFrame:
    """Add ``sample_weight`` so that every action carries the same total weight."""
    counts = df.groupBy("a").agg(F.count(F.lit(1)).alias("c")).agg(
        F.map_from_entries(F.collect_list(F.struct("a", "c"))).alias("m"))  # one entry per action
    m = counts.scalar()
    total = F.aggregate(F.map_values(F.col("_m")), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("_m", m).withColumn(
        "sample_weight", total / (F.lit(float(n_actions)) * F.try_element_at(F.col("_m"), F.col("a")))).drop("_m")


def clipped_ratio(pi_e: Column, pi_b: Column, a: Column, clip: float = 10.0) -> Column:
    return F.least(A.at(pi_e, a) / F.greatest(A.at(pi_b, a), F.lit(1e-6)), F.lit(clip))


def balanced_sample(df: DataFrame, fraction: float, n_actions: int, seed: int = 42, keys: Sequence[str] = (CASE, "t")) -> DataFrame:
    """Keep about ``fraction`` of the rows with actions balanced: the chance of a row follows its weight."""
    weighted = balanced_weights(df, n_actions)
    return weighted.where(hash_unit(seed, *keys) < F.least(F.lit(1.0), F.col("sample_weight") * fraction))


