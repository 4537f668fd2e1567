"""Queries on distillation, guarded decisions, monitoring, streams and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import render
from ..operators.encode import build_vocab
from ..operators import boxes, cases, clean, distill, explain, guard, monitor, ope, splits, values
from ..plans.sequence import ordered
from ..session import scratch_dir, stored
from ..sources import readers, views, writers
from ..sources.generations import GenerationStore
from ..streaming import decisions as dstream
from ..streaming import feedback as fstream
from ..streaming import metrics as mstream
from .base import MAX_LEN, SEED, SPEC, cte, query, r6, session_splits, session_transitions, sql6
from .explaining import variants
from .policy import policy_columns, rated, scored

# ---- distillation --------------------------------------------------------------------------------

N_COMMON, N_HIGH = 300, 120
FEATURES = ("value", "prefix_len", "elapsed_time", "count_view", "count_click")

cte("test_states", "SELECT k.* FROM scored k JOIN splits USING (case_id) WHERE split = 'test'", "scored", "splits")
cte("strata", f"""SELECT case_id, t, len_bin, a, row_number() OVER (PARTITION BY len_bin, a ORDER BY md5('{SEED}:' || case_id || ':' || t), case_id, t) AS rk FROM test_states""", "test_states")
cte("quota", f"SELECT greatest(1, CAST(floor({N_COMMON} / count(*)) AS BIGINT)) AS q FROM (SELECT DISTINCT len_bin, a FROM strata)", "strata")
cte("common", f"""SELECT case_id, t FROM (SELECT case_id, t, 0 AS part, rk FROM strata, quota WHERE rk <= q UNION ALL
    SELECT case_id, t, 1, row_number() OVER (ORDER BY md5('{SEED}:fill:' || case_id || ':' || t), case_id, t) FROM strata, quota WHERE rk > q) ORDER BY part, rk, case_id, t LIMIT {N_COMMON}""", "strata", "quota")
cte("high", f"SELECT case_id, t FROM scored ORDER BY round(delta_q, 9) DESC, case_id, t LIMIT {N_HIGH}", "scored")
cte("dstates", """SELECT case_id, t, bool_or(c) AS is_common, bool_or(h) AS is_high_impact FROM (SELECT case_id, t, true AS c, false AS h FROM common UNION ALL
    SELECT case_id, t, false, true FROM high) GROUP BY ALL""", "common", "high")


def _common(spark, sf):
    test = clean.filter_split(session_transitions(spark, sf), session_splits(spark, sf), "test")
    return distill.select_common_states(test, N_COMMON, SEED)


def _greedy(spark, sf):
    return values.with_greedy(scored(spark, sf))


def _states(spark, sf, rows=None):
    rows = rows if rows is not None else _greedy(spark, sf)
    # delta_q is ranked on values rounded to nine digits so that ties do not hinge on the last bit
    high = distill.select_high_impact(rows.select("case_id", "t", F.round("delta_q", 9).alias("delta_q")), rows, N_HIGH)
    return distill.distillation_states(_common(spark, sf), high)


@query("common_states", "SELECT case_id, t FROM common", ("common",))
def common_states(spark, sf):
    return _common(spark, sf)


@query("distill_sample", "SELECT case_id, t, is_common, is_high_impact FROM dstates", ("dstates",))
def distill_sample(spark, sf):
    return _states(spark, sf)


@query("high_impact_by_row", f"""SELECT case_id, t FROM scored ORDER BY round(delta_q, 9) DESC, CASE WHEN t % 2 = 1 THEN case_id END NULLS FIRST, CASE WHEN t % 2 = 1 THEN t END NULLS FIRST,
    md5(case_id || ':' || t) LIMIT {N_HIGH}""", ("scored",))
def high_impact_by_row(spark, sf):
    """Half of the explained states lack their case and are found by their row key."""
    rows = _greedy(spark, sf).withColumn("row", F.md5(F.concat_ws(":", "case_id", "t").cast("binary")))
    odd = F.col("t") % 2 == 1
    explained = rows.select(F.when(odd, F.col("case_id")).alias("case_id"), F.when(odd, F.col("t")).alias("t"), F.round("delta_q", 9).alias("delta_q"), "row")
    return distill.select_high_impact(explained, rows, N_HIGH, "row")


@query("selection_summary", f"""SELECT count(*) FILTER (is_common) AS n_common, count(*) FILTER (is_high_impact) AS n_high_impact, count(*) AS n_total,
    count(*) FILTER (is_common AND is_high_impact) AS n_overlap, count(*) FILTER (is_high_impact) / {N_HIGH}.0::DOUBLE AS match_rate,
    count(*) FILTER (is_high_impact) / {N_HIGH}.0::DOUBLE < 0.8 AS fallback_used FROM dstates""", ("dstates",))
def selection_summary(spark, sf):
    return distill.selection_summary(_states(spark, sf), N_HIGH)


@query("teacher_labels", "SELECT s.case_id, s.t, a_star, round(v, 6) AS q_star, round(margin, 6) AS margin FROM scored s JOIN dstates d ON d.case_id = s.case_id AND d.t = s.t", ("scored", "dstates"))
def teacher_labels(spark, sf):
    rows = _greedy(spark, sf)
    return rows.join(_states(spark, sf, rows), ["case_id", "t"]).select("case_id", "t", "a_star", *r6("q_star", "margin"))


cte("parted", f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY a_star ORDER BY md5('{SEED}:' || case_id || ':' || t), case_id, t)
    <= ceil(0.7::DOUBLE * count(*) OVER (PARTITION BY a_star)) THEN 'train' ELSE 'test' END AS part FROM scored""", "scored")


@query("label_split", "SELECT case_id, t, a_star, part FROM parted", ("parted",))
def label_split(spark, sf):
    return distill.split_by_label(_greedy(spark, sf).select("case_id", "t", "a_star"), "a_star", seed=SEED).select("case_id", "t", "a_star", "part")


def _labelled(spark, sf):
    rows = _greedy(spark, sf)
    feats = cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click"]).drop("n_events")
    return rows.join(feats, ["case_id", "t"]).withColumn("is_high_impact", F.col("delta_q") > 0)


@query("tree_rules")
def tree_rules(spark, sf):
    parts = stored(distill.split_by_label(_labelled(spark, sf), "a_star", seed=SEED))
    _, rules = distill.fit_tree(parts.where("part = 'train'"), FEATURES, SPEC.actions, "a_star", 5, 50)
    return distill.rules_table(rules, spark)


@query("rules_boxes", """SELECT (SELECT count(*) FROM scored) AS n_states, 0 AS in_no_box, 0 AS in_many, 0 AS text_differs, 0 AS sql_differs, 0 AS n_uncovered, 0 AS n_overlaps, true AS same_boxes""", ("scored",))
def rules_boxes(spark, sf):
    """Both exports of a fitted tree, read back: disjoint boxes that cover the space and decide as the rules do."""
    rows = stored(_labelled(spark, sf))
    _, rules = distill.fit_tree(rows, FEATURES, SPEC.actions, "a_star", 4, 20)
    exported = rules.sql()
    found = boxes.boxes_of_text(rules.text, SPEC.actions)
    case = exported[exported.index("CASE"):exported.index(" AS recommended_action")]
    out = boxes.decided_by_boxes(distill.apply_rules(rows, rules), found).withColumn("by_sql", F.expr(case))
    read = boxes.boxes_of_sql(exported)
    return out.agg(
        F.count(F.lit(1)).alias("n_states"), F.count_if(F.col("n_boxes") == 0).cast("int").alias("in_no_box"), F.count_if(F.col("n_boxes") > 1).cast("int").alias("in_many"),
        F.count_if(~F.col("box_action").eqNullSafe(F.col("recommended_action"))).cast("int").alias("text_differs"),
        F.count_if(~F.col("by_sql").eqNullSafe(F.col("recommended_action"))).cast("int").alias("sql_differs")).withColumns({
            "n_uncovered": F.lit(len(boxes.uncovered(found))), "n_overlaps": F.lit(boxes.overlaps(found)), "same_boxes": F.lit(set(read) == set(found) and len(read) == len(found))})


@query("tree_certificate", """SELECT (SELECT count(*) FROM scored) AS n_states, 0 AS small_leaves, 0 AS wrong_majority, 0 AS wrong_confidence""", ("scored",))
def tree_certificate(spark, sf):
    """What makes a tree of rules right: on the states it was fitted to, every leaf is large enough and predicts its weighted majority."""
    rows = stored(_labelled(spark, sf))
    _, rules = distill.fit_tree(rows, FEATURES, SPEC.actions, "a_star", 4, 20)
    return distill.leaf_certificate(rows, rules, "a_star", 20).select("n_states", *[F.col(c).cast("int").alias(c) for c in ("small_leaves", "wrong_majority", "wrong_confidence")])


@query("distill_policy")
def distill_policy(spark, sf):
    return distill.distill(_labelled(spark, sf), FEATURES, SPEC.actions, "a_star")[1]


@query("behavioral_cloning")
def behavioral_cloning(spark, sf):
    rows = _labelled(spark, sf)
    rules, _ = distill.distill(rows, FEATURES, SPEC.actions, "a")
    return distill.apply_rules(rows, rules).groupBy("recommended_action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == F.col("a")).cast("double")), 6).alias("agreement"))


RULES = distill.rule_list([
    ("prefix_len >= 4 AND count_view > 0", "send_offer", 0.9),
    ("value > 60.0", "send_offer", 0.75),
    ("count_click > 1", "do_nothing", 0.6),
    ("elapsed_time > 0.5", "send_offer", 0.55),
], SPEC.actions, "do_nothing")
RULE_ACTION = """CASE WHEN prefix_len >= 4 AND count_view > 0 THEN 1 WHEN value > 60.0 THEN 1 WHEN count_click > 1 THEN 0 WHEN elapsed_time > 0.5 THEN 1 ELSE 0 END"""
RULE_CONF = """CASE WHEN prefix_len >= 4 AND count_view > 0 THEN 0.9::DOUBLE WHEN value > 60.0 THEN 0.75 WHEN count_click > 1 THEN 0.6 WHEN elapsed_time > 0.5 THEN 0.55 ELSE 0.0 END"""
cte("ruled", f"SELECT *, {RULE_ACTION} AS pred, {RULE_CONF} AS confidence FROM feat_session", "feat_session")


@query("apply_rules", "SELECT case_id, t, pred, CASE WHEN pred = 1 THEN 'send_offer' ELSE 'do_nothing' END AS recommended_action, confidence FROM ruled", ("ruled",))
def apply_rules(spark, sf):
    f = cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click"])
    return distill.apply_rules(f, RULES).select("case_id", "t", "pred", "recommended_action", "confidence")


cte("agree", """SELECT r.pred, r.confidence, round(s.margin, 9) AS margin, s.a_star, s.delta_q > 0 AS high FROM ruled r JOIN scored s ON s.case_id = r.case_id AND s.t = r.t""", "ruled", "scored")


def _rho(where: str) -> str:
    return f"""(SELECT corr(rx, ry) FROM (SELECT rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS ry FROM agree {where}))"""


@query("surrogate_fidelity", f"""SELECT count(*) AS n_test, round(avg(CAST(pred = a_star AS INT)), 6) AS agreement_global, round(avg(CAST(pred = a_star AS INT)) FILTER (high), 6) AS agreement_high_impact,
    count(*) FILTER (high) AS n_high_impact, round({_rho('')}, 6) AS margin_correlation, round({_rho('WHERE high')}, 6) AS margin_correlation_high_impact FROM agree""", ("agree",))
def surrogate_fidelity(spark, sf):
    rows = distill.apply_rules(_labelled(spark, sf), RULES).withColumn("margin", F.round("margin", 9))
    out = distill.surrogate_fidelity(rows, "a_star")
    return out.select("n_test", *r6("agreement_global", "agreement_high_impact"), "n_high_impact", *r6("margin_correlation", "margin_correlation_high_impact"))


# ---- guarded decisions ---------------------------------------------------------------------------

GUARD = guard.GuardSpec(tau_uncertainty=0.3, tau_ood_z=3.0, max_ood_features=0, fallback_id=0, fallback_name="do_nothing")
GUARD_FEATURES = ("value", "prefix_len", "elapsed_time", "count_view", "count_click")


def guard_requests(spark, sf):
    """Every prefix as a request; the kind of its last event decides on mask and override."""
    seq = ordered(views.log_session(spark, sf), running={f"count_{a}": F.when(F.col("activity") == a, 1).otherwise(0) for a in ("view", "click")},
                  totals={"_start": ("min", F.col("timestamp"))})
    act = F.col("activity")
    return seq.select(
        F.concat(F.lit("req-"), "event_id").alias("request_id"), "case_id", "t", "timestamp", "value", F.col("t").cast("double").alias("prefix_len"),
        ((F.unix_micros("timestamp") - F.unix_micros("_start")) / F.lit(86400000000.0)).alias("elapsed_time"), "count_view", "count_click",
        F.when(act == "error", F.array(F.lit(0))).when(act == "signup", F.array(F.lit(0), F.lit(1))).alias("valid_actions"),
        F.when((act == "purchase") & (F.col("value") > 50), F.struct(F.lit(1).alias("action_id"), F.lit("send_offer").alias("action_name"), F.lit("vip").alias("reason"))).alias("override"))


def guard_stats(spark, sf):
    return guard.stats_column(cases.feature_stats(cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click"]), GUARD_FEATURES))


cte("gstats", "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in GUARD_FEATURES) + " FROM feat_session", "feat_session")
cte("guarded", f"""SELECT r.*, e.event_id, e.activity, {' + '.join(f'CAST(abs((r.{f} - m_{f}) / s_{f}) > 3.0 AS INT)' for f in GUARD_FEATURES)} > 0 AS odd,
    e.activity = 'purchase' AND e.value > 50 AS ov, e.activity = 'error' AND r.pred = 1 AS bad, 1.0 - r.confidence AS unc FROM ruled r JOIN seq_session e ON e.case_id = r.case_id AND e.t = r.t, gstats""",
    "ruled", "seq_session", "gstats")
GUARD_SQL = """SELECT 'req-' || event_id AS request_id, CASE WHEN ov THEN 1 WHEN bad OR odd OR unc > 0.3 THEN 0 ELSE pred END AS action_id,
    CASE WHEN ov THEN 'send_offer' WHEN bad OR odd OR unc > 0.3 THEN 'do_nothing' WHEN pred = 1 THEN 'send_offer' ELSE 'do_nothing' END AS action_name,
    CASE WHEN ov THEN 'override' WHEN bad OR odd OR unc > 0.3 THEN 'baseline' ELSE 'surrogate' END AS source,
    CASE WHEN ov THEN 'vip' WHEN bad THEN 'invalid_action=' || pred WHEN odd THEN 'OOD detected' WHEN unc > 0.3 THEN format('uncertainty={:.3f} > threshold=0.3', unc) END AS reason,
    (NOT ov AND NOT bad AND odd) AS ood FROM guarded"""


@query("guard_decisions", GUARD_SQL, ("guarded",))
def guard_decisions(spark, sf):
    out = guard.decide(guard_requests(spark, sf), RULES, GUARD, GUARD_FEATURES, guard_stats(spark, sf))
    return out.select("request_id", "action_id", "action_name", "source", "reason", "ood")


@query("ood_z_scores", f"""SELECT case_id, t, {', '.join(f'round(abs(({f} - m_{f}) / s_{f}), 6) AS z_{f}' for f in ('value', 'prefix_len'))} FROM feat_session, gstats""", ("feat_session", "gstats"))
def ood_z_scores(spark, sf):
    f = cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click"])
    z = guard.z_scores(["value", "prefix_len"], guard.stats_column(cases.feature_stats(f, ["value", "prefix_len"])))
    return f.select("case_id", "t", *[F.round(c, 6).alias(f"z_{n}") for n, c in z.items()])


@query("mahalanobis_ood", """SELECT case_id, t, round(sqrt((vp * dx * dx - 2 * c * dx * dy + vx * dy * dy) / (vx * vp - c * c)), 4) AS distance FROM
    (SELECT case_id, t, value - mx AS dx, prefix_len - mp AS dy, vx, vp, c FROM feat_session,
      (SELECT avg(value) AS mx, avg(prefix_len) AS mp, var_pop(value) AS vx, var_pop(prefix_len) AS vp, covar_pop(value, prefix_len) AS c FROM feat_session))""", ("feat_session",))
def mahalanobis_ood(spark, sf):
    f = cases.case_features(views.log_session(spark, sf), ["value"])
    return guard.mahalanobis(f, ["value", "prefix_len"], f).select("case_id", "t", F.round("distance", 4).alias("distance"))


@query("fidelity_badge", """SELECT test, CASE WHEN w >= 0 THEN 'PASS' WHEN m >= -0.05 THEN 'CAUTION' ELSE 'FAIL' END AS badge FROM
    (SELECT 'q_drop' AS test, min(value) AS w, avg(value) AS m FROM qdrop WHERE metric = 'gap_norm' UNION ALL
     SELECT 'action_flip', min(g), avg(g) FROM (SELECT p, avg(f) FILTER (rep < 0) - avg(f) FILTER (rep >= 0) AS g FROM
      (SELECT *, CASE WHEN na <> a_star THEN 1.0 ELSE 0.0 END AS f FROM fid) GROUP BY 1))""", ("qdrop", "fid"))
def fidelity_badge(spark, sf):
    v = stored(variants(spark, sf))
    return guard.fidelity_badge(explain.q_drop(v).unionByName(explain.action_flip(v))).select("test", "badge")


@query("replay_summary", """SELECT source, count(*) AS n, round(avg(confidence), 6) AS confidence_mean, round(avg(latency_ms), 6) AS latency_mean,
    round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99, round(count(*) / (SELECT count(*) FROM decisions), 6) AS share
    FROM decisions GROUP BY 1""", ("decisions",))
def replay_summary(spark, sf):
    return guard.replay_summary(views.decisions(spark, sf)).select("source", "n", *r6("confidence_mean", "latency_mean", "latency_p95", "latency_p99", "share"))


# ---- monitoring ----------------------------------------------------------------------------------

RATES = ("coverage", "fallback_rate", "override_rate", "ood_rate", "confidence_mean", "confidence_std")
LATENCY = ("latency_p50", "latency_p95", "latency_p99")
cte("daily", """SELECT CAST(timestamp AS DATE) AS date, count(*) AS total_requests, avg(CAST(source = 'surrogate' AS INT)) AS coverage, avg(CAST(source = 'baseline' AS INT)) AS fallback_rate,
    avg(CAST(source = 'override' AS INT)) AS override_rate, avg(CAST(ood AS INT)) AS ood_rate, avg(confidence) AS confidence_mean, stddev_samp(confidence) AS confidence_std,
    quantile_cont(latency_ms, 0.5) AS latency_p50, quantile_cont(latency_ms, 0.95) AS latency_p95, quantile_cont(latency_ms, 0.99) AS latency_p99,
    avg(CAST(case_id IS NULL OR action_id IS NULL OR source IS NULL OR coalesce(confidence < 0 OR confidence > 1, false) OR coalesce(latency_ms < 0, false) AS INT)) AS schema_error_rate
    FROM decisions GROUP BY 1""", "decisions")


def daily(spark, sf):
    return monitor.daily_metrics(views.decisions(spark, sf))


@query("daily_metrics", f"SELECT date, total_requests, {sql6(*RATES, *LATENCY)} FROM daily", ("daily",))
def daily_metrics(spark, sf):
    return daily(spark, sf).select("date", "total_requests", *r6(*RATES, *LATENCY))


cte("adist", "SELECT CAST(timestamp AS DATE) AS date, action_id, count(*) AS n FROM decisions GROUP BY ALL", "decisions")


@query("action_distribution", "SELECT date, action_id, n, round(n / sum(n) OVER (PARTITION BY date), 6) AS share FROM adist", ("adist",))
def action_distribution(spark, sf):
    return monitor.action_distribution(views.decisions(spark, sf)).select("date", "action_id", "n", *r6("share"))


@query("action_map", "SELECT date, string_agg(action_id || ':' || n, ',' ORDER BY action_id) AS actions FROM adist GROUP BY 1", ("adist",))
def action_map(spark, sf):
    m = monitor.action_map(monitor.action_distribution(views.decisions(spark, sf)))
    return m.select("date", F.array_join(F.transform(F.map_entries("action_distribution"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("actions"))


@query("metrics_upsert", """SELECT date, CASE WHEN date >= DATE '2024-01-10' AND date < DATE '2024-01-15' THEN total_requests ELSE -1 END AS total_requests FROM daily
    UNION ALL SELECT max(date) + 1, 7 FROM daily""", ("daily",))
def metrics_upsert(spark, sf):
    d = daily(spark, sf).select("date", "total_requests")
    history = d.withColumn("total_requests", F.lit(-1).cast("long"))
    new_day = d.agg(F.date_add(F.max("date"), 1).alias("date"), F.lit(7).cast("long").alias("total_requests"))
    return monitor.upsert_daily(history, d.where("date >= DATE '2024-01-10' AND date < DATE '2024-01-15'").unionByName(new_day))


def _psi_sql(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM (SELECT greatest(count(*) FILTER (cur) / any_value(nc), 1e-6) AS a, greatest(count(*) FILTER (NOT cur) / any_value(ne), 1e-6) AS e
        FROM (SELECT cur, least(greatest(ceil((v - min(v) OVER ()) * 10 / (max(v) OVER () - min(v) OVER ())), 1), 10) AS bin, count(*) FILTER (cur) OVER () AS nc, count(*) FILTER (NOT cur) OVER () AS ne
          FROM (SELECT {feature} AS v, timestamp >= TIMESTAMP '2024-01-16' AS cur FROM decisions)) GROUP BY bin)"""


@query("psi", f"SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warning' ELSE 'critical' END AS level FROM ({_psi_sql('latency_ms')} UNION ALL {_psi_sql('confidence')})", ("decisions",))
def psi(spark, sf):
    d = views.decisions(spark, sf)
    cut = F.to_timestamp(F.lit("2024-01-16"))
    return monitor.psi(d.where(F.col("timestamp") >= cut), d.where(F.col("timestamp") < cut), ["latency_ms", "confidence"]).select("feature", *r6("psi"), "level")


@query("ks", """SELECT 'latency_ms' AS feature, round(max(abs(cc / nc - cb / nb)), 6) AS ks, max(abs(cc / nc - cb / nb)) > 0.01 AS drifted FROM
    (SELECT v, sum(c) OVER (ORDER BY v)::DOUBLE AS cc, sum(b) OVER (ORDER BY v)::DOUBLE AS cb, sum(c) OVER ()::DOUBLE AS nc, sum(b) OVER ()::DOUBLE AS nb FROM
      (SELECT latency_ms AS v, count(*) FILTER (timestamp >= TIMESTAMP '2024-01-16') AS c, count(*) FILTER (timestamp < TIMESTAMP '2024-01-16') AS b FROM decisions GROUP BY 1))""", ("decisions",))
def ks(spark, sf):
    d = views.decisions(spark, sf)
    cut = F.to_timestamp(F.lit("2024-01-16"))
    return monitor.ks(d.where(F.col("timestamp") >= cut), d.where(F.col("timestamp") < cut), "latency_ms", 0.01).select("feature", *r6("ks"), "drifted")


@query("split_drift", """SELECT feature, round(psi, 6) AS psi, level FROM (SELECT 'value' AS feature, psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warning' ELSE 'critical' END AS level FROM
    (SELECT sum((a - e) * ln(a / e)) AS psi FROM (SELECT greatest(count(*) FILTER (cur) / any_value(nc), 1e-6) AS a, greatest(count(*) FILTER (NOT cur) / any_value(ne), 1e-6) AS e FROM
      (SELECT cur, least(greatest(ceil((v - min(v) OVER ()) * 10 / (max(v) OVER () - min(v) OVER ())), 1), 10) AS bin, count(*) FILTER (cur) OVER () AS nc, count(*) FILTER (NOT cur) OVER () AS ne
        FROM (SELECT value AS v, split = 'test' AS cur FROM log_session JOIN splits USING (case_id) WHERE split <> 'val')) GROUP BY bin)))""", ("log_session", "splits"))
def split_drift(spark, sf):
    log, split = views.log_session(spark, sf, segment=False), session_splits(spark, sf)
    return monitor.psi(clean.filter_split(log, split, "test"), clean.filter_split(log, split, "train"), ["value"]).select("feature", *r6("psi"), "level")


@query("split_ks", """SELECT 'value' AS feature, round(max(abs(cc / nc - cb / nb)), 6) AS ks, max(abs(cc / nc - cb / nb)) > 0.02 AS drifted FROM
    (SELECT v, sum(c) OVER (ORDER BY v)::DOUBLE AS cc, sum(b) OVER (ORDER BY v)::DOUBLE AS cb, sum(c) OVER ()::DOUBLE AS nc, sum(b) OVER ()::DOUBLE AS nb FROM
      (SELECT value AS v, count(*) FILTER (split = 'test') AS c, count(*) FILTER (split = 'train') AS b
       FROM log_session JOIN splits USING (case_id) WHERE split <> 'val' AND value IS NOT NULL GROUP BY 1))""", ("log_session", "splits"))
def split_ks(spark, sf):
    """The other drift method between splits, with its threshold."""
    log, split = views.log_session(spark, sf, segment=False), session_splits(spark, sf)
    return monitor.ks(clean.filter_split(log, split, "test"), clean.filter_split(log, split, "train"), "value", 0.02).select("feature", *r6("ks"), "drifted")


cte("signals", """SELECT * , (ood_rate - ood_b) / (ood_b + 1e-6) AS ood_spike, (cov_b - coverage) / (cov_b + 1e-6) AS coverage_drop, (override_rate - ov_b) / (ov_b + 1e-6) AS override_spike FROM
    (SELECT date, ood_rate, coverage, override_rate, avg(ood_rate) OVER b AS ood_b, avg(coverage) OVER b AS cov_b, avg(override_rate) OVER b AS ov_b, row_number() OVER (ORDER BY date) AS d
     FROM daily WINDOW b AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)) WHERE d >= 7""", "daily")
cte("flagged", "SELECT *, ood_spike > 0.1 AS oa, coverage_drop > 0.05 AS ca, override_spike > 0.1 AS va FROM signals", "signals")
# thresholds low enough to fire on the bundled data
LOW = {"ood_spike": 0.1, "coverage_drop": 0.05, "override_spike": 0.1}


def signals(spark, sf):
    return monitor.drift_signals(daily(spark, sf), **LOW)


@query("drift_signals", f"""SELECT date, {sql6('ood_spike', 'coverage_drop', 'override_spike')}, oa AS ood_alert, ca AS coverage_alert, va AS override_alert, oa OR ca OR va AS drift_detected FROM flagged""", ("flagged",))
def drift_signals(spark, sf):
    return signals(spark, sf).select("date", *r6("ood_spike", "coverage_drop", "override_spike"), "ood_alert", "coverage_alert", "override_alert", "drift_detected")


@query("drift_signals_default", """SELECT date, ood_spike > 2.0 OR coverage_drop > 0.2 OR override_spike > 1.0 AS drift_detected FROM signals""", ("signals",))
def drift_signals_default(spark, sf):
    return monitor.drift_signals(daily(spark, sf)).select("date", "drift_detected")


@query("alerts", """SELECT date, s.signal, round(s.base, 6) AS baseline, round(s.cur, 6) AS current, round(s.change, 6) AS change FROM
    (SELECT date, 'ood_spike' AS signal, ood_b AS base, ood_rate AS cur, ood_spike AS change, oa AS alert FROM flagged UNION ALL SELECT date, 'coverage_drop', cov_b, coverage, coverage_drop, ca FROM flagged
     UNION ALL SELECT date, 'override_spike', ov_b, override_rate, override_spike, va FROM flagged) s WHERE alert""", ("flagged",))
def alerts(spark, sf):
    return monitor.alerts(signals(spark, sf)).select("date", "signal", *r6("baseline", "current", "change"))


@query("retrain_triggers", """SELECT date, 'retrain-' || strftime(date, '%Y%m%d') AS ticket_id, concat_ws(',', CASE WHEN oa THEN 'ood_spike' END, CASE WHEN ca THEN 'coverage_drop' END, CASE WHEN va THEN 'override_spike' END) AS reasons,
    'open' AS status FROM flagged WHERE oa OR ca OR va""", ("flagged",))
def retrain_triggers(spark, sf):
    return monitor.retraining_tickets(signals(spark, sf))


cte("islands", """SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS n_days FROM (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS g FROM flagged WHERE oa OR ca OR va) GROUP BY g""", "flagged")


@query("drift_persistence", "SELECT start_date, end_date, n_days, n_days >= 3 AS persistent FROM islands", ("islands",))
def drift_persistence(spark, sf):
    return monitor.drift_persistence(signals(spark, sf), 3)


@query("retraining_gate", """SELECT (SELECT coalesce(bool_or(n_days >= 3), false) FROM islands) AS drift_persistent, (SELECT count(DISTINCT case_id) FROM log_session) AS n_cases,
    round((b - n) / abs(b), 6) AS gain_drop, (SELECT count(DISTINCT case_id) FROM log_session) >= 500 AS enough_cases, (b - n) / abs(b) > 0.3 AS gain_dropped,
    (SELECT count(DISTINCT case_id) FROM log_session) >= 500 AND ((SELECT coalesce(bool_or(n_days >= 3), false) FROM islands) OR (b - n) / abs(b) > 0.3) AS retrain FROM
    (SELECT avg(outcome) FILTER (case_day >= DATE '2024-01-16') AS n, avg(outcome) FILTER (case_day < DATE '2024-01-16') AS b FROM (SELECT case_id, max(CASE WHEN activity = 'purchase' THEN value ELSE 0.0 END) AS outcome,
      CAST(min(timestamp) AS DATE) AS case_day FROM log_session GROUP BY 1))""", ("islands", "log_session"))
def retraining_gate(spark, sf):
    log = views.log_session(spark, sf, segment=False)
    per_case = log.groupBy("case_id").agg(F.max(F.when(F.col("activity") == "purchase", F.col("value")).otherwise(0.0)).alias("outcome"), F.to_date(F.min("timestamp")).alias("day"))
    late = F.col("day") >= F.lit("2024-01-16").cast("date")
    s = per_case.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.when(late, F.col("outcome"))).alias("now"), F.avg(F.when(~late, F.col("outcome"))).alias("base")).alias("s")).scalar()
    out = monitor.retraining_gate(signals(spark, sf), s.getField("n"), s.getField("now"), s.getField("base"))
    return out.withColumn("gain_drop", F.round("gain_drop", 6))


@query("threshold_bands", """SELECT date, metric, round(value, 6) AS value, CASE WHEN total_requests < 10 THEN 'INSUFFICIENT' WHEN better = 'high' AND value < crit OR better = 'low' AND value > crit THEN 'CRITICAL'
    WHEN better = 'high' AND value < warn OR better = 'low' AND value > warn THEN 'WARNING' ELSE 'OK' END AS band FROM
    (SELECT date, total_requests, 'coverage' AS metric, coverage AS value FROM daily UNION ALL SELECT date, total_requests, 'fallback_rate', fallback_rate FROM daily UNION ALL SELECT date, total_requests, 'override_rate', override_rate FROM daily
     UNION ALL SELECT date, total_requests, 'ood_rate', ood_rate FROM daily UNION ALL SELECT date, total_requests, 'latency_p95', latency_p95 FROM daily
     UNION ALL SELECT date, total_requests, 'schema_error_rate', schema_error_rate FROM daily) JOIN
    (VALUES ('coverage', 'high', 0.85, 0.80), ('fallback_rate', 'low', 0.10, 0.20), ('override_rate', 'low', 0.15, 0.25), ('ood_rate', 'low', 0.10, 0.20), ('latency_p95', 'low', 20.0, 50.0), ('schema_error_rate', 'low', 0.005, 0.01)) th(metric, better, warn, crit) USING (metric)""", ("daily",))
def threshold_bands(spark, sf):
    return monitor.threshold_bands(daily(spark, sf)).select("date", "metric", *r6("value"), "band")


@query("schema_error_bands", """SELECT date, round(rate, 6) AS value, CASE WHEN n < 10 THEN 'INSUFFICIENT' WHEN rate > 0.01 THEN 'CRITICAL' WHEN rate > 0.005 THEN 'WARNING' ELSE 'OK' END AS band FROM
    (SELECT CAST(timestamp AS DATE) AS date, count(*) AS n, avg(CAST(t % 150 = 0 OR t % 400 = 1 OR t % 700 = 2 AS INT)) AS rate FROM decisions GROUP BY 1)""", ("decisions",))
def schema_error_bands(spark, sf):
    """Decisions that lack an action, are too sure, or took negative time."""
    t = F.col("t")
    broken = views.decisions(spark, sf).withColumns({
        "action_id": F.when(t % 150 != 0, F.col("action_id")), "confidence": F.when(t % 400 == 1, 1.5).otherwise(F.col("confidence")),
        "latency_ms": F.when(t % 700 == 2, -1.0).otherwise(F.col("latency_ms"))})
    return monitor.threshold_bands(monitor.daily_metrics(broken)).where("metric = 'schema_error_rate'").select("date", *r6("value"), "band")


@query("latency_histogram", """SELECT bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, n FROM (SELECT CAST(least(floor((v - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, any_value(lo) AS lo, any_value((hi - lo) / 10) AS w, count(*) AS n
    FROM (SELECT latency_ms AS v, min(latency_ms) OVER () AS lo, max(latency_ms) OVER () AS hi FROM decisions) GROUP BY 1)""", ("decisions",))
def latency_histogram(spark, sf):
    return monitor.histogram(views.decisions(spark, sf), "latency_ms", 10).select("bin", *r6("lo", "hi"), "n")


@query("dashboard_series", """SELECT date, unnest(['coverage', 'fallback_rate', 'override_rate', 'ood_rate', 'latency_p95', 'confidence_mean']) AS metric,
    unnest([round(coverage, 6), round(fallback_rate, 6), round(override_rate, 6), round(ood_rate, 6), round(latency_p95, 6), round(confidence_mean, 6)]) AS value FROM daily""", ("daily",))
def dashboard_series(spark, sf):
    return monitor.dashboard_series(daily(spark, sf)).select("date", "metric", *r6("value"))


@query("last_day_actions", "SELECT date, action_id, n FROM adist WHERE date = (SELECT max(date) FROM adist)", ("adist",))
def last_day_actions(spark, sf):
    return monitor.last_day_actions(monitor.action_distribution(views.decisions(spark, sf))).select("date", "action_id", "n")


# ---- streams -------------------------------------------------------------------------------------


def stream_of(spark, sf, name):
    """A bundled table as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def decision_stream(spark, sf):
    raw = stream_of(spark, sf, "events")
    kind = F.col("event_type")
    return raw.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.when(kind == "signup", "baseline").when(kind == "purchase", "override").otherwise("surrogate").alias("source"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("confidence"), (kind == "error").alias("ood"), F.col("value").alias("latency_ms"))


STREAMED = ("coverage", "fallback_rate", "override_rate", "ood_rate", "confidence_mean", "confidence_std")
STREAMED_LATENCY = ("latency_p50", "latency_p95", "latency_p99")


@query("stream_daily_metrics", f"""SELECT date, total_requests, {sql6(*STREAMED)},
    {', '.join(f"(SELECT round(min(v), 6) FROM (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) AS r FROM decisions WHERE CAST(timestamp AS DATE) = daily.date) WHERE r >= ceil({p} * daily.total_requests)) AS {c}"
               for c, p in zip(STREAMED_LATENCY, (0.5, 0.95, 0.99)))} FROM daily""", ("daily", "decisions"))
def stream_daily_metrics(spark, sf):
    out, ck = scratch_dir(spark, "daily"), scratch_dir(spark, "daily-ck")
    mstream.start_daily(mstream.daily_stream(decision_stream(spark, sf)), out, ck).awaitTermination()
    # a sketch of 10,000: exact ranks on days of fewer rows
    return mstream.read_daily(spark, out).select("date", "total_requests", *r6(*STREAMED, *STREAMED_LATENCY))


@query("stream_weekly_sliding", """SELECT CAST(d AS DATE) AS date, count(*) AS total_requests FROM decisions, range(0, 7) g(k), LATERAL (SELECT CAST(timestamp AS DATE) - CAST(k AS INTEGER) AS d) GROUP BY 1""", ("decisions",))
def stream_weekly_sliding(spark, sf):
    out, ck = scratch_dir(spark, "weekly"), scratch_dir(spark, "weekly-ck")
    mstream.start_daily(mstream.daily_stream(decision_stream(spark, sf), window="7 days", slide="1 day"), out, ck).awaitTermination()
    return mstream.read_daily(spark, out).select("date", "total_requests")


# the guard of the stream knows value and type only: rules and statistics on those columns
STREAM_RULES = distill.rule_list([("value > 60.0", "send_offer", 0.9), ("value > 20.0", "send_offer", 0.72), ("value > 5.0", "do_nothing", 0.8)], SPEC.actions, "do_nothing")
cte("sguard", """SELECT event_id, value, event_type, CASE WHEN value > 20.0 THEN 1 ELSE 0 END AS pred, CASE WHEN value > 60.0 THEN 0.9::DOUBLE WHEN value > 20.0 THEN 0.72 WHEN value > 5.0 THEN 0.8 ELSE 0.0 END AS c,
    abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)) > 3.0 AS odd FROM events""")


@query("stream_decisions", """SELECT 'req-' || event_id AS request_id, CASE WHEN event_type = 'error' AND pred = 1 OR odd OR 1.0 - c > 0.3 THEN 0 ELSE pred END AS action_id,
    CASE WHEN event_type = 'error' AND pred = 1 OR odd OR 1.0 - c > 0.3 THEN 'baseline' ELSE 'surrogate' END AS source, NOT (event_type = 'error' AND pred = 1) AND odd AS ood FROM sguard""", ("sguard",))
def stream_decisions(spark, sf):
    stats = {r["feature"]: (r["mean"], r["std"]) for r in cases.feature_stats(views.events(spark, sf), ["value"]).collect()}  # one row
    raw = stream_of(spark, sf, "events").select(
        F.concat(F.lit("req-"), "event_id").alias("request_id"), F.col("user_id").cast("string").alias("case_id"), F.lit(1).alias("t"), F.col("ts").cast("timestamp").alias("timestamp"), "value",
        F.when(F.col("event_type") == "error", F.array(F.lit(0))).alias("valid_actions"))
    spec = guard.GuardSpec(0.3, 3.0, 0, 0, "do_nothing", stats)
    out, ck = scratch_dir(spark, "decisions"), scratch_dir(spark, "decisions-ck")
    dstream.append_log(dstream.decision_stream(raw, STREAM_RULES, spec, ["value"]), out, ck).awaitTermination()
    return readers.read_decisions(spark, out).select("request_id", "action_id", "source", "ood")


@query("stream_feedback", """SELECT case_id, t, value || ',' || CAST(t AS DOUBLE) AS s, CASE WHEN activity = 'purchase' THEN 1 ELSE 0 END AS a, CASE WHEN t >= n_events - 1 THEN value ELSE 0.0 END AS r FROM fb WHERE t < n_events AND n_events >= 2""", ("fb",))
def stream_feedback(spark, sf):
    # the feedback log is written once by the batch side and then followed as a stream
    path, store, out, ck = (scratch_dir(spark, n) for n in ("fb-log", "fb-store", "fb-out", "fb-ck"))
    writers.append_jsonl(views.feedback(spark, sf), path)
    stream = readers.read_feedback(spark, path, streaming=True).drop("_corrupt_record")
    fstream.start_consolidation(stream, GenerationStore(store), out, ck, ["value", "prefix_len"]).awaitTermination()
    return fstream.read_transitions(spark, out).select(F.col("case_id").cast("long").alias("case_id"), "t", render(F.col("s")).alias("s"), "a", "r")


cte("fb_week", """SELECT *, lead(t) OVER w AS next_t, lead(value) OVER w AS nv, count(*) OVER (PARTITION BY case_id) AS n_week FROM
    (SELECT f.case_id, f.t, f.value, f.activity, f.n_events FROM fb f JOIN seq_user s ON s.case_id = f.case_id AND s.t = f.t WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15')
    WINDOW w AS (PARTITION BY case_id ORDER BY t)""", "fb", "seq_user")


def _weekly(spark, sf, min_cases):
    store, rows = GenerationStore(scratch_dir(spark, "fb-store")), views.feedback(spark, sf)
    store.append(rows, 0, F.xxhash64("t"))
    out = fstream.consolidate(fstream.stored_feedback(spark, store, rows.schema), ["value", "prefix_len"], since="2024-01-08", until="2024-01-15", min_cases=min_cases)
    return out.select("case_id", "t", render(F.col("s")).alias("s"), render(F.col("s_next")).alias("s_next"), "a", "r")


@query("feedback_weekly", """SELECT case_id, t, value || ',' || CAST(t AS DOUBLE) AS s, nv || ',' || CAST(next_t AS DOUBLE) AS s_next, CASE WHEN activity = 'purchase' THEN 1 ELSE 0 END AS a,
    CASE WHEN t >= n_events - 1 THEN value ELSE 0.0 END AS r FROM fb_week WHERE next_t IS NOT NULL AND (SELECT count(DISTINCT case_id) FROM fb_week WHERE n_week >= 2) >= 5""", ("fb_week",))
def feedback_weekly(spark, sf):
    """One week of feedback from the store, if at least five cases can be used."""
    return _weekly(spark, sf, 5)


@query("feedback_weekly_few", "SELECT count(*) AS n FROM fb_week WHERE (SELECT count(DISTINCT case_id) FROM fb_week WHERE n_week >= 2) >= 1000000000", ("fb_week",))
def feedback_weekly_few(spark, sf):
    """A week with fewer usable cases than asked for gives nothing."""
    return _weekly(spark, sf, 1_000_000_000).agg(F.count(F.lit(1)).alias("n"))


# ---- storage round trips -------------------------------------------------------------------------


@query("csv_log", "SELECT CAST(case_id AS VARCHAR) AS case_id, activity, CAST(epoch_us(timestamp) AS BIGINT) AS us, event_id, value FROM log_session", ("log_session",))
def csv_log(spark, sf):
    path = scratch_dir(spark, "csv")
    log = views.log_session(spark, sf, segment=False)
    writers.write_csv(log.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")), path)
    back = clean.parse_timestamps(readers.read_csv(spark, path, "case_id string, activity string, timestamp string, event_id long, value double"))
    return back.select("case_id", "activity", F.unix_micros("timestamp").alias("us"), "event_id", "value")


def write_xes(log, path):
    """Test export: traces of at most 1000 events each, so no case is gathered whole."""
    from pyspark.sql import functions as F

    part = ordered(log).withColumn("_part", F.floor((F.col("t") - 1) / 1000))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    event = F.struct(F.array(F.struct(F.lit("concept:name").alias("_key"), F.col("activity").alias("_value"))).alias("string"),
                     F.array(F.struct(F.lit("time:timestamp").alias("_key"), stamp.alias("_value"))).alias("date"))
    traces = part.groupBy("case_id", "_part").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", event.alias("event")))), lambda s: s["event"]).alias("event"))
    shaped = traces.select(F.array(F.struct(F.lit("concept:name").alias("_key"), F.col("case_id").alias("_value"))).alias("string"), "event")
    shaped.write.format("xml").option("rowTag", "trace").option("rootTag", "log").save(path)


@query("xes_log", "SELECT case_id, activity, CAST(epoch_us(timestamp) AS BIGINT) AS us FROM log_session", ("log_session",))
def xes_log(spark, sf):
    path = scratch_dir(spark, "xes")
    write_xes(views.log_session(spark, sf), path)
    log = clean.rename_columns(readers.read_xes(spark, path, ("concept:name", "time:timestamp")), {"case_id": "case:concept:name", "activity": "concept:name", "timestamp": "time:timestamp"})
    return clean.parse_timestamps(log).select("case_id", "activity", F.unix_micros("timestamp").alias("us"))


@query("json_documents", """SELECT split, n_cases, count_a0 FROM (SELECT split, count(DISTINCT k.case_id) AS n_cases, count(*) FILTER (a = 0) AS count_a0 FROM tr_session k JOIN splits s ON s.case_id = k.case_id GROUP BY split)""", ("tr_session", "splits"))
def json_documents(spark, sf):
    """One JSON document per split, spread over lines, written and read back whole."""
    path = scratch_dir(spark, "documents")
    per = session_transitions(spark, sf).join(session_splits(spark, sf), "case_id").groupBy("split").agg(F.count_distinct("case_id").alias("n_cases"), F.count_if(F.col("a") == 0).alias("count_a0"))
    text = F.to_json(F.struct("split", "n_cases", F.struct("count_a0").alias("actions")), {"pretty": "true"}).alias("value")
    per.select(F.col("split").alias("name"), text).write.partitionBy("name").text(path)
    return readers.read_json_document(spark, path, "split string, n_cases long, actions struct<count_a0:long>").select("split", "n_cases", "actions.count_a0")


@query("decision_log", "SELECT request_id, action_id, source, round(confidence, 6) AS confidence, ood FROM decisions WHERE timestamp >= TIMESTAMP '2024-01-10'", ("decisions",))
def decision_log(spark, sf):
    path = scratch_dir(spark, "decision-log")
    writers.append_jsonl(views.decisions(spark, sf), path)
    return readers.read_decisions(spark, path, since="2024-01-10").select("request_id", "action_id", "source", *r6("confidence"), "ood")


@query("feedback_log", "SELECT case_id, t, value, CASE WHEN activity = 'purchase' THEN 1 ELSE 0 END AS action_executed FROM fb", ("fb",))
def feedback_log(spark, sf):
    path = scratch_dir(spark, "feedback-log")
    writers.append_jsonl(views.feedback(spark, sf), path)
    back = readers.read_feedback(spark, path)
    return back.select(F.col("case_id").cast("long").alias("case_id"), "t", F.try_element_at("state_features", F.lit("value")).alias("value"), "action_executed")


def _padded(tokens):
    return f"array_to_string(list_concat(list_resize([]::INTEGER[], {MAX_LEN} - len({tokens}), 0), {tokens}), ',')"


@query("transition_store", f"""SELECT split, t.case_id, t.t, a, 1 + valid1 AS n_valid, {_padded('toks')} AS s, {_padded('next_toks')} AS s_next, CAST(len(toks) AS INTEGER) AS n_mask,
    CAST(len(next_toks) AS INTEGER) AS n_next_mask FROM tr_session t JOIN enc_session e ON e.case_id = t.case_id AND e.t = t.t JOIN splits ON splits.case_id = t.case_id""", ("tr_session", "enc_session", "splits"))
def transition_store(spark, sf):
    path = scratch_dir(spark, "transitions")
    vocab = build_vocab(views.log_session(spark, sf, segment=False))
    writers.write_transitions(session_transitions(spark, sf, vocab), session_splits(spark, sf), path)
    back = readers.read_parquet(spark, path, ["split", "case_id", "t", "a", "valid_actions", "s", "s_next", "s_mask", "s_next_mask"])
    ones = {n: F.aggregate(c, F.lit(0), lambda acc, x: acc + x.cast("int")) for n, c in (("n_valid", "valid_actions"), ("n_mask", "s_mask"), ("n_next_mask", "s_next_mask"))}
    return back.select("split", "case_id", "t", "a", ones["n_valid"].alias("n_valid"), render(F.col("s")).alias("s"), render(F.col("s_next")).alias("s_next"),
                       ones["n_mask"].alias("n_mask"), ones["n_next_mask"].alias("n_next_mask"))


@query("item_unwrap", "SELECT case_id, t, round(delta_q, 6) AS delta_q FROM scored WHERE delta_q > 0", ("scored",))
def item_unwrap(spark, sf):
    # documents of {"items": [...]}: one per case and hundred steps, never a whole case
    wrapped, bare = scratch_dir(spark, "items"), scratch_dir(spark, "bare-items")
    found = _greedy(spark, sf).where("delta_q > 0").select("case_id", "t", "delta_q", F.floor(F.col("t") / 100).alias("_part"))
    rows = found.where("t % 2 = 0")
    docs = rows.groupBy("case_id", "_part").agg(F.collect_list(F.struct("case_id", "t", "delta_q")).alias("items")).select("items")
    writers.write_json_documents(docs, wrapped)
    writers.write_json_documents(found.where("t % 2 = 1").drop("_part"), bare)
    item = "case_id string, t int, delta_q double"
    back = readers.read_items(spark, wrapped, item, lines=True).unionByName(readers.read_items(spark, bare, item, lines=True))
    return back.select("case_id", "t", F.round("delta_q", 6).alias("delta_q"))


@query("vocab_store", "SELECT token, id, cnt, 'run-1' AS run FROM vocab", ("vocab",))
def vocab_store(spark, sf):
    path = scratch_dir(spark, "vocab")
    writers.write_vocab(build_vocab(views.log_session(spark, sf, segment=False)), path, run="run-1")
    return readers.read_parquet(spark, path)


@query("split_store", "SELECT case_id, split FROM splits", ("splits",))
def split_store(spark, sf):
    path = scratch_dir(spark, "splits")
    s = stored(session_splits(spark, sf))
    writers.write_splits(s, splits.split_manifest(s, "random_case", SEED), path)
    return readers.read_parquet(spark, f"{path}/cases")


@query("manifest_store", f"""SELECT split, count(*) AS n_cases, 'random_case' AS method, {SEED} AS seed, CASE split WHEN 'train' THEN 0.7 WHEN 'val' THEN 0.1 ELSE 0.2 END::DOUBLE AS ratio
    FROM splits GROUP BY 1""", ("splits",))
def manifest_store(spark, sf):
    """The manifest as it is read back from where the splits are stored."""
    path = scratch_dir(spark, "splits")
    s = stored(session_splits(spark, sf))
    writers.write_splits(s, splits.split_manifest(s, "random_case", SEED), path)
    return spark.read.schema("split string, n_cases long, method string, seed int, ratio double").json(f"{path}/manifest")


@query("daily_store", "SELECT date, total_requests + CASE WHEN date >= DATE '2024-01-20' THEN 1000 ELSE 0 END AS total_requests, round(coverage, 6) AS coverage FROM daily", ("daily",))
def daily_store(spark, sf):
    path = scratch_dir(spark, "daily-table")
    d = stored(daily(spark, sf).select("date", "total_requests", "coverage"))
    writers.append_daily(spark, d, path)
    changed = d.where("date >= DATE '2024-01-20'").withColumn("total_requests", F.col("total_requests") + 1000)
    return writers.append_daily(spark, changed, path).select("date", "total_requests", *r6("coverage"))


@query("report_store", """SELECT policy, metric, value FROM (SELECT policy, unnest(['n', 'dr_mean']) AS metric, unnest([count(*)::DOUBLE, round(avg(dr), 6)]) AS value FROM dr GROUP BY policy)""", ("dr",))
def report_store(spark, sf):
    path = scratch_dir(spark, "report")
    e = ope.evaluate(ope.policy_steps(rated(spark, sf), policy_columns()), with_percentiles=False).select("policy", "n", "dr_mean")
    writers.write_report(ope.report(e, run="r1"), path)
    back = spark.read.schema("policy string, metric string, value double, metadata string").json(path)
    return back.select("policy", "metric", F.round("value", 6).alias("value"))


@query("fingerprint", """SELECT count(*) AS n_rows, substr(sha256(CAST(sum(CAST(('0x' || substr(d, 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(d, 16, 15))::BIGINT AS HUGEINT)) AS VARCHAR)), 1, 16) AS digest FROM
    (SELECT md5('=' || case_id || chr(31) || '=' || activity || chr(31) || '=' || epoch_us(timestamp) || chr(31) || '=' || event_id || chr(31) || '=' || value) AS d FROM log_session)""", ("log_session",))
def fingerprint(spark, sf):
    return readers.fingerprint(views.log_session(spark, sf, segment=False).select("case_id", "activity", F.unix_micros("timestamp").alias("us"), "event_id", "value"))
