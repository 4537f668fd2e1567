"""Distilling a policy into auditable rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_md5
from ..plans.ranking import hash_rank, spearman
from ..session import scratch_dir, stored_table
from .clean import CASE
from .values import length_bin

# ---- state sample ---------------------------------------------------------------------------------


def select_common_states(test: DataFrame, n_target: int, seed: int = 42, action: str = "a") -> DataFrame:
    """(case_id, t): equal quota per (prefix-length bin, action), the rest filled in hash order.

    Two passes over the states, both limited before anything is shuffled: at most ``n_target`` candidates of each
    stratum, of which there are a handful, and the first states of the fill order. No state beyond these is stored.
    """
    keyed = test.select(CASE, "t", length_bin(F.col("t")).alias("len_bin"), F.col(action).alias("act"))
    order = Window.partitionBy("len_bin", "act").orderBy("_h", CASE, "t")
    candidates = stored_table(
        keyed.withColumn("_h", seeded_md5(seed, CASE, "t")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_target))
    n_strata = candidates.select("len_bin", "act").distinct().count()
    quota = max(1, n_target // max(1, n_strata))
    first = candidates.where(F.col("_rank") <= quota).select(CASE, "t", F.lit(0).alias("_part"), "_rank", F.lit("").alias("_f"))
    fill = keyed.select(CASE, "t", F.lit(1).alias("_part"), F.lit(0).alias("_rank"), seeded_md5(f"{seed}:fill", CASE, "t").alias("_f"))
    # as many as are wanted even if all of the first ones are among them
    rest = fill.orderBy("_f", CASE, "t").limit(n_target + n_strata * quota).join(first.select(CASE, "t"), [CASE, "t"], "left_anti")
    # the sample size is the feature: first the quotas, then the fill
    return first.unionByName(rest).orderBy("_part", "_rank", "_f", CASE, "t").limit(n_target).select(CASE, "t")


def select_high_impact(explained: DataFrame, dataset: DataFrame, n: int, row_key: str | None = None) -> DataFrame:
    """Top-n explained states by delta_q that exist in the dataset.

    States without case or position are found by ``row_key``, a column of both sides that is unique
    in the dataset.
    """
    keys = [row_key] if row_key else []
    top = explained.orderBy(F.desc_nulls_last("delta_q"), CASE, "t", *keys).limit(n).select(CASE, "t", *keys)
    direct = top.select(CASE, "t").join(dataset.select(CASE, "t").distinct(), [CASE, "t"], "left_semi")
    if not row_key:
        return direct
    lost = top.where(F.col(CASE).isNull() | F.col("t").isNull()).select(row_key)
    return direct.unionByName(dataset.select(CASE, "t", row_key).join(lost, row_key, "left_semi").select(CASE, "t"))


def distillation_states(common: DataFrame, high: DataFrame) -> DataFrame:
    """(case_id, t, is_common, is_high_impact): distinct union with membership flags."""
    both = common.select(CASE, "t", F.lit(True).alias("c"), F.lit(False).alias("h")).unionByName(
        high.select(CASE, "t", F.lit(False).alias("c"), F.lit(True).alias("h")))
    return both.groupBy(CASE, "t").agg(F.bool_or("c").alias("is_common"), F.bool_or("h").alias("is_high_impact"))


def selection_summary(states: DataFrame, requested_high: int) -> DataFrame:
    """One row: sizes, overlap, match rate, fallback flag below 80 %."""
    agg = states.agg(
        F.count_if("is_common").alias("n_common"), F.count_if("is_high_impact").alias("n_high_impact"), F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("is_common") & F.col("is_high_impact")).alias("n_overlap"))
    rate = F.coalesce(F.try_divide(F.col("n_high_impact").cast("double"), F.lit(float(requested_high))), F.lit(0.0))
    return agg.withColumns({"match_rate": rate, "fallback_used": rate < 0.8})


def split_by_label(df: DataFrame, label: str = "label", train: float = 0.7, seed: int = 42, keys: Sequence[str] = (CASE, "t")) -> DataFrame:
    """Add ``part``: the first ceil(train n) rows of each label in hash order train, the rest test."""
    ranked = hash_rank(df, seed, keys, [label], rank="_rank", size="_size")
    part = F.when(F.col("_rank") <= F.ceil(F.lit(train) * F.col("_size")), "train").otherwise("test")
    return ranked.withColumn("part", part).drop("_rank", "_size")


# ---- surrogate ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Ordered rules: (condition, action id, confidence). The first match wins."""

    rules: tuple[tuple[str, int, float], ...]
    actions: tuple[str, ...]
    default: int = 0
    text: str = ""
    depth: int = 0
    leaves: int = 0
    features: tuple[str, ...] = field(default=())

    def decision(self) -> Column:
        """struct(action_id, confidence) as one CASE WHEN inside code generation."""
        act = " ".join(f"WHEN {c} THEN {a}" for c, a, _ in self.rules)
        conf = " ".join(f"WHEN {c} THEN {p!r}D" for c, _, p in self.rules)
        if not self.rules:
            return F.struct(F.lit(self.default).alias("action_id"), F.lit(0.0).alias("confidence"))
        return F.struct(F.expr(f"CASE {act} ELSE {self.default} END").alias("action_id"), F.expr(f"CASE {conf} ELSE 0.0D END").alias("confidence"))

    def sql(self, table: str = "case_features") -> str:
        """Stand-alone SELECT with one WHEN per leaf."""
        lines = [f"    WHEN {c} THEN '{self.actions[a]}'  -- confidence: {p:.2f}" for c, a, p in self.rules]
        return "\n".join(["SELECT", "  CASE", *lines, f"    ELSE '{self.actions[self.default]}'", "  END AS recommended_action", f"FROM {table}"])


def fit_tree(df: DataFrame, features: Sequence[str], actions: Sequence[str], label: str = "label", max_depth: int = 5, min_leaf: int = 50,
             balanced: bool = True, seed: int = 42) -> tuple[object, Rules]:
    """Distributed decision tree with balanced class weights, and its leaves as rules."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = df.withColumn("_y", F.col(label).cast("double"))
    if balanced:
        per_class = labelled.groupBy("_y").agg(F.count(F.lit(1)).alias("c"))
        weights = per_class.agg(F.struct(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.map_from_entries(F.collect_list(F.struct("_y", "c"))).alias("m")).alias("s"))
        labelled = labelled.withColumn("_s", weights.scalar()).withColumn(
            "_w", F.col("_s.n") / (F.col("_s.k") * F.try_element_at(F.col("_s.m"), F.col("_y")))).drop("_s")
    else:
        labelled = labelled.withColumn("_w", F.lit(1.0))
    x = VectorAssembler(inputCols=list(features), outputCol="_x").transform(labelled).select("_x", "_y", "_w")
    # no limit on bins beyond the default: thresholds come from per-feature quantiles
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed, maxBins=64)
    model = tree.fit(x)
    return model, tree_rules(model, features, actions, df.sparkSession)


def tree_rules(model, features: Sequence[str], actions: Sequence[str], spark) -> Rules:
    """Leaves of a fitted tree as rules; the node table has at most 2^(depth+1) rows."""
    path = scratch_dir(spark, "tree")
    model.write().overwrite().save(path)
    nodes = {r["id"]: r for r in spark.read.parquet(f"{path}/data").collect()}
    found: list[tuple[str, int, float]] = []

    def walk(i: int, conditions: list[str]) -> None:
        node = nodes[i]
        if node["leftChild"] < 0:
            stats = [float(v) for v in node["impurityStats"]]
            best = max(range(len(stats)), key=lambda c: stats[c])
            found.append((" AND ".join(conditions) or "TRUE", best, stats[best] / sum(stats) if sum(stats) else 0.0))
            return
        split = node["split"]
        name, cut = features[split["featureIndex"]], float(split["leftCategoriesOrThreshold"][0])
        walk(node["leftChild"], conditions + [f"`{name}` <= {cut!r}D"])
        walk(node["rightChild"], conditions + [f"`{name}` > {cut!r}D"])

    walk(0, [])
    text = model.toDebugString
    for i in reversed(range(len(features))):
        text = text.replace(f"feature {i} ", f"{features[i]} ")
    return Rules(tuple(found), tuple(actions), 0, text, model.depth, len(found), tuple(features))


def leaf_certificate(train: DataFrame, rules: Rules, label: str = "label", min_leaf: int = 50, balanced: bool = True) -> DataFrame:
    """One row that tells whether the rules are leaves fitted to ``train``: all counts but ``n_states`` are 0 if so.

    Every state falls to the first rule that holds. Leaves under ``min_leaf`` states, leaves whose action is not that of the
    largest class weight, and leaves whose confidence is not its share of the weight are counted; balanced weights give
    every class the same total.
    """
    leaf = F.coalesce(*[F.when(F.expr(c), F.lit(i)) for i, (c, _, _) in enumerate(rules.rules)])
    sizes = train.groupBy(leaf.alias("leaf"), F.col(label).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # one row per leaf and class
    per_class, all_rows = Window.partitionBy("y"), Window.partitionBy(F.lit(0))
    weight = F.col("n") / F.sum("n").over(per_class) if balanced else F.col("n") / F.sum("n").over(all_rows)
    leaves = sizes.withColumn("w", weight).groupBy("leaf").agg(
        F.sum("n").alias("n"), F.max("w").alias("top"), F.sum("w").alias("w"), F.map_from_entries(F.collect_list(F.struct("y", "w"))).alias("of"))
    told = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(p).alias("p")) for _, a, p in rules.rules])
    rule = F.get(told, F.col("leaf"))
    share = F.coalesce(F.try_element_at("of", rule["a"].cast("int")), F.lit(0.0))
    return leaves.agg(
        F.sum("n").cast("long").alias("n_states"), F.count_if(F.col("n") < min_leaf).alias("small_leaves"), F.count_if(share < F.col("top") * (1 - 1e-9)).alias("wrong_majority"),
        F.count_if(F.abs(share / F.col("w") - rule["p"]) > 1e-6).alias("wrong_confidence"))


def rule_list(rules: Sequence[tuple[str, str, float]], actions: Sequence[str], default: str = "do_nothing") -> Rules:
    """Hand-written ordered rules (condition, action name, confidence)."""
    names = tuple(actions)
    return Rules(tuple((c, names.index(a), float(p)) for c, a, p in rules), names, names.index(default) if default in names else 0, leaves=len(rules))


def apply_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """Add pred, recommended_action and confidence."""
    names = F.array(*[F.lit(a) for a in rules.actions])
    out = df.withColumn("_d", rules.decision())
    return out.withColumns({
        "pred": F.col("_d.action_id"), "recommended_action": F.get(names, F.col("_d.action_id")), "confidence": F.col("_d.confidence")}).drop("_d")


def surrogate_fidelity(df: DataFrame, label: str = "label", min_high: int = 5) -> DataFrame:
    """One row: agreement and margin-confidence rank correlation, overall and on high-impact states."""
    hit = (F.col("pred") == F.col(label)).cast("double")
    high = F.coalesce(F.col("is_high_impact"), F.lit(False))
    agg = df.agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("agreement_global"), F.avg(F.when(high, hit)).alias("agreement_high_impact"), F.count_if(high).alias("n_high_impact"))
    rows = stored_table(df.select("margin", "confidence", high.alias("h")))
    rho = spearman(rows, "margin", "confidence", "rho").select("rho").scalar()
    rho_high = spearman(rows.where("h"), "margin", "confidence", "rho").select(F.when(F.col("n") > min_high, F.col("rho")).alias("rho")).scalar()
    return agg.withColumns({"margin_correlation": F.coalesce(rho, F.lit(0.0)), "margin_correlation_high_impact": rho_high})


def distill(states: DataFrame, features: Sequence[str], actions: Sequence[str], label: str = "label", seed: int = 42, max_depth: int = 5, min_leaf: int = 50) -> tuple[Rules, DataFrame]:
    """Labelled states to rules and their fidelity on held-out states.

    ``label="a_star"`` imitates the teacher, ``label="a"`` clones the logged behaviour.
    """
    parts = stored_table(split_by_label(states, label, seed=seed))
    _, rules = fit_tree(parts.where("part = 'train'"), features, actions, label, max_depth, min_leaf, seed=seed)
    return rules, surrogate_fidelity(apply_rules(parts.where("part = 'test'"), rules), label)


def rules_table(rules: Rules, spark) -> DataFrame:
    """(rule, condition, action, confidence); one row per leaf."""
    rows = [(i, c, rules.actions[a], p) for i, (c, a, p) in enumerate(rules.rules)]
    return spark.createDataFrame(rows, "rule int, condition string, action string, confidence double")
