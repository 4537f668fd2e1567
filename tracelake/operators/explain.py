"""Selecting states, explaining values token by token, profiling clusters, fidelity tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.hashing import seeded_md5
from ..plans.ranking import hash_rank, kendall, percentiles, spearman
from ..plans.sizing import dimension
from .clean import CASE
from .encode import PAD
from .values import greedy_action, length_bin, value

# ---- selection ------------------------------------------------------------------------------------


def select_cases_random(df: DataFrame, n_cases: int, seed: int = 123) -> DataFrame:
    """The first ``n_cases`` cases in seeded hash order (a per-task top-n, then a merge)."""
    h = seeded_md5(seed, CASE)
    return df.select(CASE).distinct().orderBy(h, CASE).limit(n_cases)


def select_cases_stratified(rewards: DataFrame, n_cases: int, seed: int = 123) -> DataFrame:
    """Proportional sample over total-reward quartiles, at least one case per quartile.

    ``rewards`` is (case_id, total_reward). Ranks inside a quartile come from hash buckets, so a
    quartile with most cases is not sorted by one task.
    """
    edges = percentiles(rewards, "total_reward", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(F.struct("q1", "q2", "q3").alias("e")).scalar()
    total = rewards.agg(F.count(F.lit(1)).alias("n")).scalar()
    x = F.col("total_reward")
    binned = rewards.select(CASE, "total_reward", edges.alias("_e"), total.alias("_total")).select(
        CASE, "_total", sum(((x >= F.col(f"_e.{q}")).cast("int") for q in ("q1", "q2", "q3")), F.lit(0)).alias("reward_bin"))
    ranked = hash_rank(binned, seed, [CASE], ["reward_bin"], rank="_rank", size="_size")
    share = F.floor(F.lit(n_cases) * F.col("_size") / F.col("_total"))
    quota = F.least(F.greatest(F.lit(1), share), F.col("_size"))
    picked = ranked.where(F.col("_rank") <= quota)
    return picked.orderBy("reward_bin", "_rank").limit(n_cases).select(CASE, "reward_bin")


def select_transitions(tr: DataFrame, chosen: DataFrame, k: int | str = "last") -> DataFrame:
    """Rows of the chosen cases: all of them, the last, or the last k by t."""
    rows = tr.join(chosen.select(CASE), CASE, "left_semi")
    if k == "all":
        return rows
    last = 1 if k == "last" else int(k)
    w = Window.partitionBy(CASE).orderBy(F.desc("t"))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last).drop("_rn")


def valid_action_gaps(df: DataFrame) -> DataFrame:
    """One row: selected states without any valid action."""
    return df.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(A.n_valid(F.col("valid_actions")) == 0).alias("n_without_valid_action"))


# ---- scoring of token arrays ----------------------------------------------------------------------


def token_table(q_table: DataFrame, vocab: DataFrame) -> DataFrame:
    """The state-value table keyed by token id; id 0 is the fallback for an empty state."""
    ids = vocab.select(F.col("token").alias("last_activity"), F.col("id").alias("last_id"))
    named = q_table.join(ids, "last_activity", "left").withColumn(
        "last_id", F.when(F.col("last_activity") == "", F.lit(PAD)).otherwise(F.col("last_id")))
    return dimension(named.where(F.col("last_id").isNotNull()).select("last_id", "len_bin", "seen", F.col("q").alias("_q")))


def score_tokens(df: DataFrame, table: DataFrame, trigger_id: int, x: str = "x", mask: str = "mask", out: str = "q") -> DataFrame:
    """Attach values to states given as (ids, mask): the key is read off the array itself."""
    real = F.filter(F.arrays_zip(F.col(x).alias("v"), F.col(mask).alias("m")), lambda p: p["m"] > 0)
    keyed = df.withColumn("_real", F.transform(real, lambda p: p["v"]))
    keyed = keyed.withColumns({
        "last_id": F.coalesce(F.try_element_at("_real", F.lit(-1)), F.lit(PAD)),
        "len_bin": length_bin(F.size("_real")), "seen": F.array_contains("_real", trigger_id)})
    fallback = table.where((F.col("last_id") == PAD) & (F.col("len_bin") == 0) & ~F.col("seen")).select("_q").scalar()
    joined = keyed.join(table, ["last_id", "len_bin", "seen"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_q"), fallback)).drop("_q", "_real", "last_id", "len_bin", "seen")


def remove_positions(x: Column, mask: Column, positions: Column, mode: str = "mask_topk", order: Column | None = None) -> tuple[Column, Column]:
    """Delete positions: PAD with mask 0, PAD with the mask kept, or a permutation among themselves.

    For ``permute_topk`` the tokens move by one place along ``positions``.
    """
    def gone(i: Column) -> Column:
        return F.array_contains(positions, i)

    if mode == "mask_topk":
        return (F.transform(x, lambda v, i: F.when(gone(i), F.lit(PAD)).otherwise(v)),
                F.transform(mask, lambda m, i: F.when(gone(i), F.lit(0).cast("tinyint")).otherwise(m)))
    if mode == "zero_topk":
        return F.transform(x, lambda v, i: F.when(gone(i), F.lit(PAD)).otherwise(v)), mask
    if mode == "permute_topk":
        n = F.size(positions)

        def source(i: Column) -> Column:
            at = F.array_position(positions, i)  # 1-based
            return F.get(x, F.get(positions, F.pmod(at, n).cast("int")))

        return F.transform(x, lambda v, i: F.when(gone(i), source(i)).otherwise(v)), mask
    raise ValueError(f"unknown deletion mode {mode!r}")


def real_positions(mask: Column) -> Column:
    """Zero-based positions holding a token."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m > 0, i)), lambda p: p.isNotNull())


def _target(q: Column, item: str, target: str) -> Column:
    if target == "V":
        return value(q, F.col("valid_actions"))
    if target == "q_star":
        return A.at(q, F.col("a_star"))
    if target == "delta_q":
        return A.at(q, F.col("a_star")) - A.at(q, F.col("a_contrast"))
    raise ValueError(f"unknown target {target!r} for {item}")


# ---- attribution ----------------------------------------------------------------------------------


def occlusion(items: DataFrame, table: DataFrame, trigger_id: int, target: str = "V", x: str = "s", mask: str = "s_mask") -> DataFrame:
    """Attribution per (case, t, position): the drop of the target when that token is removed.

    ``items`` carries q, valid_actions and, for other targets, a_star and a_contrast. Rows grow with
    items times tokens, so this runs on selected items.
    """
    base = items.withColumn("base_value", _target(F.col("q"), "items", target))
    spread = base.withColumn("position", F.explode(real_positions(F.col(mask))))
    gone_x, gone_m = remove_positions(F.col(x), F.col(mask), F.array("position"))
    lost = score_tokens(spread.withColumns({"_x": gone_x, "_m": gone_m}), table, trigger_id, "_x", "_m", "_q2")
    attr = F.col("base_value") - _target(F.col("_q2"), "occluded", target)
    return lost.select(CASE, "t", "position", A.at(F.col(x), F.col("position")).alias("token_id"), "base_value", attr.alias("attribution")).withColumn(
        "importance", F.abs("attribution"))


def linear_attribution(df: DataFrame, features: Sequence[str], weights: Sequence[float], baseline: Sequence[float] | None = None) -> DataFrame:
    """Integrated gradients of a linear scorer in closed form: (x - x0) w per feature."""
    base = baseline or [0.0] * len(features)
    return df.withColumns({f"attr_{f}": (F.col(f) - F.lit(float(b))) * F.lit(float(w)) for f, w, b in zip(features, weights, base)})


def top_tokens(attr: DataFrame, k: int = 10) -> DataFrame:
    """Top-k positions per item with positive importance, ties by position (an item has at most max_len rows)."""
    w = Window.partitionBy(CASE, "t").orderBy(F.desc("importance"), "position")
    ranked = attr.where(F.col("importance") > 0).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def explanation_items(items: DataFrame, top: DataFrame, vocab: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Nested export: one row per item with its top tokens, decoded, plus their global statistics.

    ``totals`` is :func:`global_top_tokens`. Each item gathers at most k structs.
    """
    names = dimension(vocab.select(F.col("id").alias("token_id"), F.col("token").alias("token_name")))
    named = top.join(names, "token_id", "left")
    if totals is not None:
        named = named.join(dimension(totals.select("token_id", F.col("frequency").alias("global_frequency"), F.col("median_importance").alias("global_median_importance"))), "token_id", "left")
    else:
        named = named.withColumns({"global_frequency": F.lit(None).cast("long"), "global_median_importance": F.lit(None).cast("double")})
    fields = ["rank", "position", "token_id", "token_name", "importance", "global_frequency", "global_median_importance"]
    lists = named.groupBy(CASE, "t").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("top_tokens"))
    keep = [c for c in ("a_star", "v", "q_star", "q", "a_contrast", "contrast_valid", "contrast_fallback_used", "q_contrast", "delta_q") if c in items.columns]
    return items.select(CASE, "t", *keep).join(lists, [CASE, "t"], "left").withColumn("top_tokens", F.coalesce("top_tokens", F.expr(
        "cast(array() as array<struct<rank:int,position:int,token_id:int,token_name:string,importance:double,global_frequency:bigint,global_median_importance:double>>)")))


def global_top_tokens(top: DataFrame, k: int = 10) -> DataFrame:
    """Tokens by how often they reach an item's top list, then by median importance."""
    freq = top.groupBy("token_id").agg(F.count(F.lit(1)).alias("frequency"))
    med = percentiles(top, "importance", {"median_importance": 0.5}, ["token_id"])
    return freq.join(med, "token_id").orderBy(F.desc("frequency"), F.desc("median_importance"), "token_id").limit(k)


def completeness(attr: DataFrame, base_value: Column) -> DataFrame:
    """One row: how far summed attributions are from value minus baseline value."""
    per_item = attr.groupBy(CASE, "t").agg(F.sum("attribution").alias("total"), F.max("base_value").alias("value"))
    gap = F.col("value") - F.col("_b")
    err = per_item.withColumn("_b", base_value).select(
        F.abs(F.col("total") - gap).alias("abs_error"), (F.abs(F.col("total") - gap) / F.greatest(F.abs(gap), F.lit(1.0))).alias("rel_error"))
    med = percentiles(err, "rel_error", {"m": 0.5}).select("m").scalar()
    agg = err.agg(
        F.count(F.lit(1)).alias("n_items"), F.avg("abs_error").alias("abs_mean"), F.avg("rel_error").alias("rel_mean"), F.min("rel_error").alias("rel_min"),
        F.max("rel_error").alias("rel_max"), F.stddev_pop("rel_error").alias("rel_std"))
    return agg.withColumn("rel_median", med)


def empty_state_value(table: DataFrame) -> Column:
    """Value of the all-PAD baseline state with every action valid."""
    pad = table.where((F.col("last_id") == PAD) & (F.col("len_bin") == 0) & ~F.col("seen"))
    return pad.select(F.array_max("_q").alias("v")).scalar()


# ---- clusters -------------------------------------------------------------------------------------


def state_features(tr: DataFrame, activities: Sequence[str], x: str = "s", ids: dict[str, int] | None = None) -> DataFrame:
    """Bag of activities, prefix length and one-hot last activity as plain columns."""
    ids = ids or {}

    def occurrences(token: int) -> Column:
        return F.size(F.filter(F.col(x), lambda v: v == token)).cast("double")

    count = {f"n_{a}": occurrences(ids[a]) for a in activities if a in ids}
    last = {f"last_{a}": (F.col("last_activity") == a).cast("double") for a in activities}
    return tr.withColumns({**count, **last, "prefix_len": F.col("t").cast("double")})


def kmeans_states(df: DataFrame, features: Sequence[str], k: int = 8, seed: int = 123, n_init: int = 10, max_iter: int = 20, tol: float = 1e-4) -> DataFrame:
    """Distributed k-means, best of ``n_init`` seeds; adds ``cluster_id``."""
    from pyspark import StorageLevel
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df).persist(StorageLevel.MEMORY_AND_DISK)
    best = None
    for i in range(n_init):
        model = KMeans(k=k, seed=seed + i, initMode="k-means||", maxIter=max_iter, tol=tol, featuresCol="_x", predictionCol="cluster_id").fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    out = best.transform(rows).drop("_x")
    rows.unpersist()
    return out


def kmeans_certificate(df: DataFrame, features: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """One row: states, clusters, and states that lie nearer to the mean of another cluster; 0 of these prove a fixed point of k-means."""
    vector = df.select(F.col(cluster).alias("cluster"), F.array(*[F.col(c).cast("double") for c in features]).alias("vector"))
    # one centre per cluster
    centres = centroids(vector, len(features)).agg(F.collect_list(F.struct("cluster", "centroid")).alias("c")).scalar()
    away = F.transform("_c", lambda c: F.struct(A.squared_distance(F.col("vector"), c["centroid"]).alias("d"), c["cluster"].alias("cluster")))
    own = F.array_max(F.transform(F.filter("_d", lambda x: x["cluster"] == F.col("cluster")), lambda x: x["d"]))
    least = F.array_min(F.transform("_d", lambda x: x["d"]))
    judged = vector.withColumn("_c", centres).withColumn("_d", away).select("cluster", (own > least * (1 + 1e-9) + 1e-9).alias("misplaced"))
    return judged.agg(F.count(F.lit(1)).alias("n_states"), F.count_distinct("cluster").cast("int").alias("n_clusters"), F.count_if("misplaced").cast("int").alias("n_misplaced"))


def cluster_profile(df: DataFrame, n_actions: int, cluster: str = "cluster_id") -> DataFrame:
    """Size, greedy-action shares, value moments (population), mean delta_q and margin per cluster."""
    agg = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"), F.avg("delta_q").alias("mean_delta_q"),
        F.avg("margin").alias("mean_policy_margin"), *[F.count_if(F.col("a_star") == i).alias(f"_a{i}") for i in range(n_actions)])
    shares = F.create_map(*[x for i in range(n_actions) for x in (F.lit(str(i)), F.col(f"_a{i}") / F.col("n"))])
    return agg.withColumn("action_distribution", shares).drop(*[f"_a{i}" for i in range(n_actions)])


def centroids(df: DataFrame, dim: int, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """(cluster, centroid): element-wise means as one aggregate, no exploded vectors."""
    means = df.groupBy(cluster).agg(*[F.avg(F.get(F.col(vector), F.lit(i))).alias(f"_{i}") for i in range(dim)])
    return means.select(cluster, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("centroid"))


def prototypes(df: DataFrame, centers: DataFrame, n: int = 3, cluster: str = "cluster", vector: str = "vector", key: str = "state_id") -> DataFrame:
    """The n states nearest to their centroid; the rank limit runs before the shuffle as well."""
    near = df.join(dimension(centers), cluster).withColumn("distance", F.sqrt(A.squared_distance(F.col(vector), F.col("centroid"))))
    w = Window.partitionBy(cluster).orderBy("distance", key)
    return near.select(cluster, key, "distance").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_summary(profile: DataFrame, protos: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Profile with an array of prototypes (at most n per cluster)."""
    cols = [c for c in protos.columns if c not in (cluster,)]
    lists = protos.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in cols if c != "rank"]))).alias("prototypes"))
    return profile.join(lists, cluster, "left")


# ---- fidelity -------------------------------------------------------------------------------------


def perturbed(
    items: DataFrame, top: DataFrame, table: DataFrame, trigger_id: int, p_remove: Sequence[float], n_random: int = 20,
    seed: int = 123, mode: str = "mask_topk", cap: int | None = None, x: str = "s", mask: str = "s_mask",
) -> DataFrame:
    """Long table of re-scored states: per item and p one top-k variant (rep -1) and ``n_random`` random ones.

    k = max(1, ceil(p n)). Random removals take the first k positions in the hash order of (item,
    rep). ``cap`` limits the explanation list; without it all positive positions are ranked.
    """
    limited = top.where(F.col("rank") <= cap) if cap else top
    lists = limited.groupBy(CASE, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "position"))), lambda s: s["position"]).alias("_top"))
    base = items.join(lists, [CASE, "t"], "left").withColumns({
        "_top": F.coalesce("_top", F.expr("cast(array() as array<int>)")), "_pos": real_positions(F.col(mask))})
    grid = base.withColumn("p_remove", F.explode(F.array(*[F.lit(float(p)) for p in p_remove]))).withColumn(
        "rep", F.explode(F.sequence(F.lit(-1), F.lit(n_random - 1))))
    k = F.greatest(F.lit(1), F.ceil(F.col("p_remove") * F.size("_pos"))).cast("int")
    shuffled = F.transform(
        F.array_sort(F.transform("_pos", lambda p: F.struct(seeded_md5(seed, CASE, "t", "rep", p).alias("h"), p.alias("p")))), lambda s: s["p"])
    grid = grid.withColumn("_gone", F.slice(F.when(F.col("rep") < 0, F.col("_top")).otherwise(shuffled), F.lit(1), k))
    new_x, new_m = remove_positions(F.col(x), F.col(mask), F.col("_gone"), mode)
    return score_tokens(grid.withColumns({"_x": new_x, "_m": new_m}), table, trigger_id, "_x", "_m", "q_new").drop("_x", "_m", "_top", "_pos", "_gone")


def q_drop(variants: DataFrame, target: str = "q_star", seed: int = 123, split: str = "test") -> DataFrame:
    """Tidy rows: value lost by removing top tokens against random tokens, per p.

    ``q_star`` compares greedy values, ``delta_q`` the recomputed advantage over the contrast action.
    """
    orig = value(F.col("q"), F.col("valid_actions")) if target == "q_star" else _target(F.col("q"), "items", target)
    new = value(F.col("q_new"), F.col("valid_actions")) if target == "q_star" else _target(F.col("q_new"), "variants", target)
    rows = variants.select(CASE, "t", "p_remove", "rep", orig.alias("o"), (orig - new).alias("drop"))
    rnd = F.when(F.col("rep") >= 0, F.col("drop"))
    item = rows.groupBy(CASE, "t", "p_remove").agg(
        F.max("o").alias("o"), F.max(F.when(F.col("rep") < 0, F.col("drop"))).alias("top"), F.avg(rnd).alias("rnd"), F.stddev_pop(rnd).alias("rnd_std"))
    scale = F.abs("o") + F.lit(1e-6)
    per_p = item.groupBy("p_remove").agg(
        F.count(F.lit(1)).alias("n_items"), F.avg("top").alias("drop_topk"), F.avg(F.col("top") / scale).alias("drop_topk_norm"),
        F.avg("rnd").alias("drop_rand_mean"), F.avg("rnd_std").alias("drop_rand_std"), F.avg(F.col("top") - F.col("rnd")).alias("gap"),
        F.avg((F.col("top") - F.col("rnd")) / scale).alias("gap_norm"))
    return tidy(per_p, "q_drop", target, ["drop_topk", "drop_topk_norm", "drop_rand_mean", "drop_rand_std", "gap", "gap_norm"], seed, split)


def action_flip(variants: DataFrame, seed: int = 123, split: str = "test") -> DataFrame:
    """Tidy rows: how often the greedy action changes, overall and where at least two actions are valid."""
    flip = (greedy_action(F.col("q_new"), F.col("valid_actions")) != greedy_action(F.col("q"), F.col("valid_actions"))).cast("double")
    rows = variants.select("p_remove", "rep", flip.alias("f"), (A.n_valid(F.col("valid_actions")) >= 2).alias("ok"))
    top, rnd, ok = F.col("rep") < 0, F.col("rep") >= 0, F.col("ok")
    per_p = rows.groupBy("p_remove").agg(
        F.count_if(top).alias("n_items"), F.count_if(top & ok).alias("n_ok"), F.avg(F.when(top, F.col("f"))).alias("flip_topk"),
        F.avg(F.when(rnd, F.col("f"))).alias("flip_rand_mean"), F.stddev_pop(F.when(rnd, F.col("f"))).alias("flip_rand_std"),
        F.coalesce(F.avg(F.when(top & ok, F.col("f"))), F.lit(0.0)).alias("flip_topk_on_possible"),
        F.coalesce(F.avg(F.when(rnd & ok, F.col("f"))), F.lit(0.0)).alias("flip_rand_mean_on_possible"))
    per_p = per_p.withColumns({
        "flip_gap": F.col("flip_topk") - F.col("flip_rand_mean"),
        "flip_gap_on_possible": F.col("flip_topk_on_possible") - F.col("flip_rand_mean_on_possible"),
        "flip_possible_rate": F.try_divide(F.col("n_ok").cast("double"), F.col("n_items").cast("double"))})
    everywhere = ["flip_topk", "flip_rand_mean", "flip_rand_std", "flip_gap", "flip_possible_rate"]
    possible = ["flip_topk_on_possible", "flip_rand_mean_on_possible", "flip_gap_on_possible"]
    return tidy(per_p, "action_flip", "-", everywhere, seed, split).unionByName(
        tidy(per_p.drop("n_items").withColumnRenamed("n_ok", "n_items"), "action_flip", "-", possible, seed, split))


def tidy(per_p: DataFrame, test: str, target: str, metrics: Sequence[str], seed: int, split: str, baseline: str = "pad") -> DataFrame:
    """Long form (test, split, target, p_remove, metric, value, n_items, seed, baseline_type)."""
    long = per_p.select("p_remove", "n_items", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m"))
    return long.select(F.lit(test).alias("test"), F.lit(split).alias("split"), F.lit(target).alias("target"), "p_remove", "m.metric", "m.value", "n_items",
                       F.lit(seed).alias("seed"), F.lit(baseline).alias("baseline_type"))


def rank_consistency(clusters: DataFrame, seed: int = 123) -> DataFrame:
    """Spearman and Kendall tau-b between mean value and its proxy over any number of clusters; undefined means 0.

    The proxy is the margin, else the value spread, else the mean value. The last two columns name the scores
    that were compared. Fewer than two clusters give no row.
    """
    proxies = ("mean_policy_margin", "std_v", "mean_v")
    used = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in proxies])
    units = clusters.where(F.col("mean_v").isNotNull()).select(F.col("mean_v").alias("x"), F.coalesce(*proxies).alias("y"), used.alias("used"))
    # at most three names
    one = units.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("used")), ",").alias("used"))
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(of(units, "x", "y", m).select(m).scalar(), F.lit(0.0)).alias("value")) for m, of in (("spearman", spearman), ("kendall", kendall))])
    both = one.where(F.col("n") >= 2).select("n", "used", F.explode(values).alias("m"))
    return both.select(F.lit("rank_consistency").alias("test"), F.lit("cluster").alias("level"), "m.metric", "m.value", F.col("n").alias("n_items"),
                       F.col("n").alias("n_units"), F.lit(seed).alias("seed"), F.lit("mean_v").alias("score_q_used"), F.col("used").alias("score_ope_used"))


def fidelity(
    items: DataFrame, top: DataFrame, table: DataFrame, trigger_id: int, p_remove: Sequence[float] = (0.1, 0.2, 0.3, 0.5), n_random: int = 20, seed: int = 123,
    n_items: int | None = None, tests: Sequence[str] = ("q_drop", "action_flip"), target: str = "q_star", mode: str = "mask_topk", cap: int | None = None,
    run: dict[str, str] | None = None,
) -> DataFrame:
    """The enabled tests over the explained items as one long table, with run metadata columns.

    ``n_items`` is the smoke-test limit: a seeded sample of that many items.
    """
    used = items.orderBy(seeded_md5(seed, CASE, "t"), CASE, "t").limit(n_items) if n_items else items
    variants = perturbed(used, top, table, trigger_id, p_remove, n_random, seed, mode, cap)
    parts = []
    if "q_drop" in tests:
        parts.append(q_drop(variants, target, seed))
    if "action_flip" in tests:
        parts.append(action_flip(variants, seed))
    if not parts:
        raise ValueError("no fidelity test enabled")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({k: F.lit(v) for k, v in (run or {}).items()})


def cluster_fit(clusters: DataFrame) -> DataFrame:
    """One row: least-squares line of the margin on the mean value."""
    return clusters.agg(F.regr_slope("mean_policy_margin", "mean_v").alias("slope"), F.regr_intercept("mean_policy_margin", "mean_v").alias("intercept"), F.count(F.lit(1)).alias("n"))


def fidelity_pivot(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """p_remove x metric."""
    return rows.where(F.col("metric").isin(list(metrics))).groupBy("p_remove").pivot("metric", list(metrics)).agg(F.avg("value"))
