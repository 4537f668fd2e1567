"""Queries on action values, policies and off-policy evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.arrays import at, masked
from ..operators import cases, clean, ope, scorers, values
from ..session import stored
from ..sources import views
from .base import SPEC, cte, query, r6, session_splits, session_transitions, sql6

N = len(SPEC.actions)
GAMMA = 0.99
LAMBDA_MASKS = {k: [1, 1] for k in SPEC.by_last_activity}

# ---- shared SQL ----------------------------------------------------------------------------------

cte("keyed", f"""SELECT *, CASE WHEN t < 5 THEN 0 WHEN t < 10 THEN 1 ELSE 2 END AS len_bin, n_trigger > 0 AS seen,
    CASE WHEN t + 1 < 5 THEN 0 WHEN t + 1 < 10 THEN 1 ELSE 2 END AS next_len_bin, n_trigger > 0 OR next_activity = 'click' AS next_seen,
    pow({GAMMA}::DOUBLE, n_events - 1 - t) * outcome AS g FROM tr_session""", "tr_session")
cte("q_grid", """SELECT * FROM (SELECT DISTINCT last_activity FROM keyed UNION SELECT '') a, (VALUES (0), (1), (2)) b(len_bin), (VALUES (true), (false)) s(seen)""", "keyed")
cte("q_state", """SELECT last_activity, len_bin, seen, avg(g) FILTER (a = 0) AS q0, avg(g) FILTER (a = 1) AS q1,
    count(*) FILTER (a = 0) AS c0, count(*) FILTER (a = 1) AS c1 FROM keyed GROUP BY ALL""", "keyed")
cte("q_act", "SELECT last_activity, avg(g) FILTER (a = 0) AS q0, avg(g) FILTER (a = 1) AS q1 FROM keyed GROUP BY ALL", "keyed")
cte("q_all", "SELECT avg(g) FILTER (a = 0) AS q0, avg(g) FILTER (a = 1) AS q1 FROM keyed", "keyed")
cte("q_table", """SELECT g.last_activity, g.len_bin, g.seen, coalesce(s.q0, a.q0, o.q0, 0.0) AS q0, coalesce(s.q1, a.q1, o.q1, 0.0) AS q1,
    coalesce(s.c0, 0) AS c0, coalesce(s.c1, 0) AS c1 FROM q_grid g LEFT JOIN q_state s USING (last_activity, len_bin, seen)
    LEFT JOIN q_act a ON a.last_activity = g.last_activity, q_all o""", "q_grid", "q_state", "q_act", "q_all")
cte("scored", """SELECT k.*, q.q0, q.q1, CASE WHEN valid1 = 1 THEN greatest(q.q0, q.q1) ELSE q.q0 END AS v,
    CASE WHEN valid1 = 1 AND q.q1 > q.q0 THEN 1 ELSE 0 END AS a_star,
    CASE WHEN valid1 = 1 THEN abs(q.q0 - q.q1) ELSE 0.0 END AS margin,
    CASE WHEN k.a = 1 THEN q.q1 ELSE q.q0 END AS q_sa,
    CASE WHEN valid1 = 1 AND q.q1 > q.q0 THEN q.q1 - q.q0 ELSE 0.0 END AS delta_q
    FROM keyed k JOIN q_table q USING (last_activity, len_bin, seen)""", "keyed", "q_table")
cte("soft", """SELECT *, CASE WHEN valid1 = 1 THEN exp(q1 - greatest(q0, q1)) / (exp(q0 - greatest(q0, q1)) + exp(q1 - greatest(q0, q1))) ELSE 0.0 END AS p1 FROM scored""", "scored")
cte("pi_b", """SELECT last_activity, len_bin, seen, (count(*) FILTER (a = 0) + 1.0) / (count(*) + 2.0) AS b0, (count(*) FILTER (a = 1) + 1.0) / (count(*) + 2.0) AS b1
    FROM keyed JOIN splits USING (case_id) WHERE split = 'train' GROUP BY ALL""", "keyed", "splits")
cte("rated", """SELECT s.*, CASE WHEN valid1 = 1 THEN coalesce(b0, 0.5) / (coalesce(b0, 0.5) + coalesce(b1, 0.5)) ELSE 1.0 END::DOUBLE AS pb0,
    CASE WHEN valid1 = 1 THEN coalesce(b1, 0.5) / (coalesce(b0, 0.5) + coalesce(b1, 0.5)) ELSE 0.0 END::DOUBLE AS pb1
    FROM soft s JOIN splits USING (case_id) LEFT JOIN pi_b USING (last_activity, len_bin, seen) WHERE split = 'test'""", "soft", "splits", "pi_b")
cte("pol", """SELECT case_id, r, q_sa, v, policy, least(pa / greatest(CASE WHEN a = 1 THEN pb1 ELSE pb0 END, 1e-6), 20.0)::DOUBLE AS rho FROM
    (SELECT *, 'softmax' AS policy, CASE WHEN a = 1 THEN p1 ELSE 1.0 - p1 END AS pa FROM rated UNION ALL
     SELECT *, 'noop', CASE WHEN a = 0 THEN 1.0 ELSE 0.0 END FROM rated UNION ALL
     SELECT *, 'heuristic', CASE WHEN a = CASE WHEN t >= 3 AND valid1 = 1 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END FROM rated)""", "rated")
cte("dr", "SELECT *, rho * (r - q_sa) + v AS dr FROM pol", "pol")


# ---- shared DataFrames ---------------------------------------------------------------------------


def q_table_df(spark, sf):
    return values.return_table(values.state_cells(session_transitions(spark, sf), GAMMA), N)


def scored(spark, sf, vocab=None):
    tr = values.with_state(session_transitions(spark, sf, vocab))
    return values.score(tr, values.return_table(values.state_cells(tr, GAMMA), N))


def rated(spark, sf):
    """Test transitions with values and behaviour propensities: one pass for both tables, one to score."""
    tr = values.with_state(session_transitions(spark, sf)).join(session_splits(spark, sf), "case_id")
    cells = values.state_cells(tr, GAMMA, F.col("split") == "train")
    test = tr.where("split = 'test'")
    return values.with_behavior(values.score(test, values.return_table(cells, N)), values.behavior_table(cells, N), N)


def policy_columns():
    q, valid = F.col("q"), F.col("valid_actions")
    return {
        "softmax": values.softmax_policy(q, valid, 1.0),
        "noop": values.noop_policy(valid, SPEC.noop_id, N),
        "heuristic": values.heuristic_policy(valid, F.col("t"), N, threshold=3),
    }


# ---- values --------------------------------------------------------------------------------------


@query("q_table", f"SELECT last_activity, len_bin, seen, {sql6('q0', 'q1')}, c0, c1 FROM q_table", ("q_table",))
def q_table(spark, sf):
    return q_table_df(spark, sf).select(
        "last_activity", "len_bin", "seen", F.col("q")[0].alias("q0"), F.col("q")[1].alias("q1"), F.col("support")[0].alias("c0"), F.col("support")[1].alias("c1")
    ).select("last_activity", "len_bin", "seen", *r6("q0", "q1"), "c0", "c1")


@query("masked_values", """SELECT case_id, t, round(q0, 6) AS m0, CASE WHEN valid1 = 1 THEN round(q1, 6) ELSE -1000000000.0::DOUBLE END AS m1 FROM scored""", ("scored",))
def masked_values(spark, sf):
    m = scored(spark, sf).withColumn("m", masked(F.col("q"), F.col("valid_actions")))
    return m.select("case_id", "t", F.round(F.col("m")[0], 6).alias("m0"), F.round(F.col("m")[1], 6).alias("m1"))


@query("greedy_policy", f"SELECT case_id, t, {sql6('v', 'q_sa', 'margin', 'delta_q')}, a_star FROM scored", ("scored",))
def greedy_policy(spark, sf):
    g = values.with_greedy(scored(spark, sf)).withColumn("q_sa", at(F.col("q"), F.col("a")))
    return g.select("case_id", "t", *r6("v", "q_sa", "margin", "delta_q"), "a_star")


@query("contrast_action", """SELECT case_id, t, valid1 AS a_contrast, valid1 = 1 AS contrast_valid, valid1 = 0 AS contrast_fallback_used,
    round(CASE WHEN valid1 = 1 THEN (CASE WHEN a_star = 1 THEN q1 ELSE q0 END) - q1 ELSE 0.0 END, 6) + 0.0 AS delta_q FROM scored""", ("scored",))
def contrast_action(spark, sf):
    c = values.contrast_id(SPEC.actions, baseline="send_offer")
    return values.with_greedy(scored(spark, sf), c).select("case_id", "t", "a_contrast", "contrast_valid", "contrast_fallback_used", *r6("delta_q"))


@query("softmax_policy", "SELECT case_id, t, round(1.0 - p1, 6) AS p0, round(p1, 6) AS p1 FROM soft", ("soft",))
def softmax_policy(spark, sf):
    s = scored(spark, sf).withColumn("p", values.softmax_policy(F.col("q"), F.col("valid_actions"), 1.0))
    return s.select("case_id", "t", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


@query("noop_heuristic", """SELECT case_id, t, CASE WHEN t % 3 = 0 THEN 0.5 WHEN t % 5 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS noop0,
    CASE WHEN t % 3 = 0 THEN 0.5 WHEN t % 5 = 1 THEN 1.0 WHEN t >= 3 AND valid1 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS heur1 FROM tr_session""", ("tr_session",))
def noop_heuristic(spark, sf):
    """Also where nothing is allowed (both even out) or only the second action is."""
    tr = session_transitions(spark, sf)
    t = F.col("t")
    v = F.when(t % 3 == 0, F.array(F.lit(0), F.lit(0))).when(t % 5 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.col("valid_actions").cast("array<int>"))
    return tr.select("case_id", "t", values.noop_policy(v, 0, N)[0].alias("noop0"), values.heuristic_policy(v, F.col("t"), N, 3)[1].alias("heur1"))


@query("behavior_policy", f"SELECT case_id, t, {sql6('pb0', 'pb1')} FROM rated", ("rated",))
def behavior_policy(spark, sf):
    return rated(spark, sf).select("case_id", "t", F.col("pi_b")[0].alias("pb0"), F.col("pi_b")[1].alias("pb1")).select("case_id", "t", *r6("pb0", "pb1"))


@query("behavior_diagnostics", """SELECT round(avg(-ln(greatest(CASE WHEN a = 1 THEN pb1 ELSE pb0 END, 1e-8))), 6) AS nll,
    round(avg(CASE WHEN (CASE WHEN pb1 > pb0 THEN 1 ELSE 0 END) = a THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    round(avg(-(pb0 * ln(greatest(pb0, 1e-8)) + pb1 * ln(greatest(pb1, 1e-8)))), 6) AS entropy, count(*) AS n FROM rated""", ("rated",))
def behavior_diagnostics(spark, sf):
    return values.behavior_diagnostics(rated(spark, sf)).select(*r6("nll", "accuracy", "entropy"), "n")


@query("behavior_logistic")
def behavior_logistic(spark, sf):
    tr = session_transitions(spark, sf)
    f = cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click", "signup"]).drop("n_events")
    rows = tr.join(f, ["case_id", "t"])
    split = session_splits(spark, sf)
    fitted = values.behavior_logistic(clean.filter_split(rows, split, "train"), rows, ["value", "prefix_len", "elapsed_time", "count_view", "count_click", "count_signup"], N)
    return fitted.select("case_id", "t", F.round(F.col("pi_b")[1], 6).alias("p1"))


@query("logistic_certificate", "SELECT count(*) AS n, true AS at_maximum FROM tr_session k JOIN splits s ON s.case_id = k.case_id WHERE split = 'train'", ("tr_session", "splits"))
def logistic_certificate(spark, sf):
    """The fitted propensities maximise the likelihood of the training part: its gradient vanishes."""
    f = cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click"]).drop("n_events")
    train = stored(clean.filter_split(session_transitions(spark, sf).join(f, ["case_id", "t"]), session_splits(spark, sf), "train"))
    names = ["value", "prefix_len", "elapsed_time", "count_view", "count_click"]
    fitted = values.behavior_logistic(train, train, names, N, max_iter=200, raw="p_model")
    return values.logistic_certificate(fitted, names, N, "p_model").select("n", (F.col("steepest") < 1e-3).alias("at_maximum"))


@query("q_stats", """SELECT round(avg(x), 6) AS q_mean, round(stddev_samp(x), 6) AS q_std, round(min(x), 6) AS q_min, round(max(x), 6) AS q_max, round(avg(abs(x)), 6) AS q_abs_mean
    FROM (SELECT q0 AS x FROM scored UNION ALL SELECT q1 FROM scored)""", ("scored",))
def q_stats(spark, sf):
    return values.q_stats(scored(spark, sf), N).select(*r6("q_mean", "q_std", "q_min", "q_max", "q_abs_mean"))


cte("td", f"""SELECT s.*, (CASE WHEN s.a = 1 THEN s.q1 ELSE s.q0 END) - (r + CASE WHEN done = 1 THEN 0.0 ELSE {GAMMA} *
    CASE WHEN next_activity IN ('purchase', 'signup', 'view') AND n.q1 > n.q0 THEN n.q1 ELSE n.q0 END END) AS e
    FROM scored s JOIN q_table n ON n.last_activity = s.next_activity AND n.len_bin = s.next_len_bin AND n.seen = s.next_seen""", "scored", "q_table")


@query("td_error", """SELECT round(avg(e), 6) AS td_mean, round(avg(abs(e)), 6) AS td_abs_mean, round(avg(CASE WHEN abs(e) <= 1 THEN e * e / 2 ELSE abs(e) - 0.5 END), 6) AS huber,
    count(*) AS n FROM td""", ("td",))
def td_error(spark, sf):
    from ..operators.transitions import action_mask

    tr = values.with_state(session_transitions(spark, sf), SPEC.trigger)
    table = stored(values.return_table(values.state_cells(tr, GAMMA), N))
    first = values.score(tr, table)
    both = values.score(first.withColumnRenamed("q", "q_now"), table, ("next_activity", "next_len_bin", "next_seen"))
    both = both.withColumnsRenamed({"q": "q_next", "q_now": "q"}).withColumn("next_valid", action_mask(F.col("next_activity"), SPEC))
    return values.td_errors(both, GAMMA).select(*r6("td_mean", "td_abs_mean", "huber"), "n")


def _sweep_sql(sweeps: int, target_every: int) -> None:
    cte("sw_keys", "SELECT DISTINCT last_activity, len_bin, seen FROM keyed", "keyed")
    cte("sw0", "SELECT *, 0.0::DOUBLE AS q0, 0.0::DOUBLE AS q1 FROM sw_keys", "sw_keys")
    online, target = "sw0", "sw0"
    for k in range(sweeps):
        if k and k % target_every == 0:
            target = online
        name = f"sw{k + 1}"
        cte(name, f"""SELECT last_activity, len_bin, seen, coalesce(avg(y) FILTER (a = 0), 0.0) AS q0, coalesce(avg(y) FILTER (a = 1), 0.0) AS q1 FROM
            (SELECT k.last_activity, k.len_bin, k.seen, k.a, r + CASE WHEN done = 1 THEN 0.0 ELSE {GAMMA} * CASE WHEN next_activity IN ('purchase', 'signup', 'view')
                AND coalesce(o.q1, 0) > coalesce(o.q0, 0) THEN coalesce(g.q1, 0) ELSE coalesce(g.q0, 0) END END AS y FROM keyed k
             LEFT JOIN {online} o ON o.last_activity = k.next_activity AND o.len_bin = k.next_len_bin AND o.seen = k.next_seen
             LEFT JOIN {target} g ON g.last_activity = k.next_activity AND g.len_bin = k.next_len_bin AND g.seen = k.next_seen) GROUP BY ALL""",
            *{"keyed", online, target})
        online = name


_sweep_sql(4, 2)


@query("fitted_q", f"SELECT last_activity, len_bin, seen, {sql6('q0', 'q1')} FROM sw4", ("sw4",))
def fitted_q(spark, sf):
    t = values.sweep_table(session_transitions(spark, sf), N, SPEC.trigger, LAMBDA_MASKS, [1, 0], GAMMA, sweeps=4, target_every=2)
    return t.select("last_activity", "len_bin", "seen", F.col("q")[0].alias("q0"), F.col("q")[1].alias("q1")).select("last_activity", "len_bin", "seen", *r6("q0", "q1"))


cte("unit", "SELECT *, ('0x' || substr(md5('7:' || case_id || ':' || t), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM tr_session", "tr_session")


def _poisson_sql(u: str, rate: float = 1.0) -> str:
    """Poisson count by inverse distribution, as :func:`values.poisson_count` counts its steps."""
    return "len([s FOR s IN [" + ", ".join(f"{s!r}::DOUBLE" for s in values.poisson_steps(rate)) + f"] IF s <= {u}])"


@query("replay_sample", f"SELECT case_id, t, CAST(unnest(range(1, 1 + {_poisson_sql('u', 0.5)})) AS INTEGER) AS draw FROM unit", ("unit",))
def replay_sample(spark, sf):
    return values.replay_sample(session_transitions(spark, sf), 0.5, 7).select("case_id", "t", "draw")


@query("replay_heavy", f"""SELECT case_id, t, CAST({_poisson_sql('u', 20.0)} AS BIGINT) AS n FROM unit WHERE {_poisson_sql('u', 20.0)} > 0""", ("unit",))
def replay_heavy(spark, sf):
    drawn = values.replay_sample(session_transitions(spark, sf), 20.0, 7)
    return drawn.groupBy("case_id", "t").agg(F.count(F.lit(1)).alias("n"))


@query("replay_weights", """SELECT case_id, t, round(n.total / (2.0 * CASE WHEN a = 1 THEN n.n1 ELSE n.total - n.n1 END), 6) AS sample_weight,
    round(least((CASE WHEN a = 1 THEN p1 ELSE 1.0 - p1 END) / greatest(CASE WHEN a = 1 THEN pb1 ELSE pb0 END, 1e-6), 10.0), 6) AS is_weight
    FROM rated, (SELECT count(*) AS total, count(*) FILTER (a = 1) AS n1 FROM rated) n""", ("rated",))
def replay_weights(spark, sf):
    rows = rated(spark, sf)
    pi_e = values.softmax_policy(F.col("q"), F.col("valid_actions"), 1.0)
    w = values.balanced_weights(rows.withColumn("is_weight", values.clipped_ratio(pi_e, F.col("pi_b"), F.col("a"), 10.0)), N)
    return w.select("case_id", "t", *r6("sample_weight", "is_weight"))


@query("balanced_sample", """SELECT case_id, t FROM unit, (SELECT count(*) AS total, count(*) FILTER (a = 1) AS n1 FROM tr_session) n
    WHERE u < least(1.0, 0.3::DOUBLE * (n.total / (2.0::DOUBLE * CASE WHEN a = 1 THEN n.n1 ELSE n.total - n.n1 END)))""", ("unit", "tr_session"))
def balanced_sample(spark, sf):
    return values.balanced_sample(session_transitions(spark, sf), 0.3, N, 7).select("case_id", "t")


# ---- off-policy evaluation -----------------------------------------------------------------------

EVAL = ("dr_mean", "wis_mean", "ess", "ess_fraction", "observed_reward", "q_sa_mean", "q_sa_std", "v_mean", "v_std")
PCT = ("rho_p50", "rho_p75", "rho_p90", "rho_p95", "rho_p99")
EVAL_SQL = """count(*) AS n, round(avg(dr), 6) AS dr_mean, round(sum(rho * r) / CASE WHEN sum(rho) > 0 THEN sum(rho) ELSE 1.0 END, 6) AS wis_mean,
    round(sum(rho) * sum(rho) / sum(rho * rho), 4) AS ess, round(sum(rho) * sum(rho) / sum(rho * rho) / count(*), 6) AS ess_fraction, round(avg(r), 6) AS observed_reward,
    round(avg(q_sa), 6) AS q_sa_mean, round(stddev_pop(q_sa), 6) AS q_sa_std, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std"""


def eval_columns(df, group):
    return df.select(group, "n", *[c for n in EVAL for c in ([F.round("ess", 4).alias("ess")] if n == "ess" else r6(n))])


@query("ope_policies", f"""SELECT policy, {EVAL_SQL}, round(quantile_cont(rho, 0.5), 6) AS rho_p50, round(quantile_cont(rho, 0.75), 6) AS rho_p75,
    round(quantile_cont(rho, 0.9), 6) AS rho_p90, round(quantile_cont(rho, 0.95), 6) AS rho_p95, round(quantile_cont(rho, 0.99), 6) AS rho_p99 FROM dr GROUP BY 1""", ("dr",))
def ope_policies(spark, sf):
    e = ope.evaluate(ope.policy_steps(rated(spark, sf), policy_columns()))
    return e.select("policy", "n", *[c for n in EVAL for c in ([F.round("ess", 4).alias("ess")] if n == "ess" else r6(n))], *r6(*PCT))


@query("ope_policy_value", """SELECT policy, round(avg(rho * (r - q_sa) + vp), 6) AS dr_mean FROM
    (SELECT case_id, r, q_sa, policy, least(pa / greatest(CASE WHEN a = 1 THEN pb1 ELSE pb0 END, 1e-6), 20.0) AS rho, vp FROM
      (SELECT *, 'softmax' AS policy, CASE WHEN a = 1 THEN p1 ELSE 1.0 - p1 END AS pa, p1 * q1 + (1.0 - p1) * q0 AS vp FROM rated UNION ALL
       SELECT *, 'noop', CASE WHEN a = 0 THEN 1.0 ELSE 0.0 END, q0 FROM rated)) GROUP BY 1""", ("rated",))
def ope_policy_value(spark, sf):
    cols = policy_columns()
    steps = ope.policy_steps(rated(spark, sf), {k: cols[k] for k in ("softmax", "noop")}, v="policy")
    return ope.evaluate(steps, with_percentiles=False).select("policy", *r6("dr_mean"))


cte("csum", "SELECT policy, case_id, count(*) AS n, sum(dr) AS s_dr, sum(rho) AS s_rho, sum(rho * r) AS s_rr FROM dr GROUP BY ALL", "dr")
cte("ord", "SELECT case_id, row_number() OVER (ORDER BY md5('42:order:' || case_id), case_id) - 1 AS i, count(*) OVER () AS nc FROM (SELECT DISTINCT case_id FROM dr)", "dr")
cte("draws", """SELECT b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 15))::BIGINT % nc AS i FROM ord, range(0, 200) r(b)""", "ord")
cte("boot", """SELECT policy, b, sum(s_dr) / sum(n) AS dr, sum(s_rr) / CASE WHEN sum(s_rho) > 0 THEN sum(s_rho) ELSE 1.0 END AS wis
    FROM draws JOIN ord USING (i) JOIN csum USING (case_id) GROUP BY ALL""", "draws", "ord", "csum")
BOOT_SQL = """SELECT policy, round(quantile_cont(dr, 0.025), 5) AS dr_lo, round(quantile_cont(dr, 0.975), 5) AS dr_hi, round(quantile_cont(wis, 0.025), 5) AS wis_lo,
    round(quantile_cont(wis, 0.975), 5) AS wis_hi, count(*) AS n_replicates FROM {} GROUP BY 1"""


def _boot(spark, sf, method):
    ci = ope.bootstrap(ope.policy_steps(rated(spark, sf), policy_columns()), 200, 42, method)
    return ci.select("policy", *[F.round(c, 5).alias(c) for c in ("dr_lo", "dr_hi", "wis_lo", "wis_hi")], "n_replicates")


@query("ope_bootstrap", BOOT_SQL.format("boot"), ("boot",))
def ope_bootstrap(spark, sf):
    return _boot(spark, sf, "multinomial")


cte("pboot", f"""SELECT policy, b, sum(m * s_dr) / sum(m * n) AS dr, sum(m * s_rr) / CASE WHEN sum(m * s_rho) > 0 THEN sum(m * s_rho) ELSE 1.0 END AS wis FROM
    (SELECT *, {_poisson_sql('u')} AS m FROM (SELECT *, ('0x' || substr(md5('42:' || b || ':' || case_id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM csum, range(0, 200) r(b)))
    WHERE m > 0 GROUP BY ALL""", "csum")


@query("ope_bootstrap_poisson", BOOT_SQL.format("pboot"), ("pboot",))
def ope_bootstrap_poisson(spark, sf):
    return _boot(spark, sf, "poisson")


TAUS = (0.5, 1.0, 5.0)
cte("tau_steps", """SELECT CAST(tau AS VARCHAR) AS tau, r, q_sa, v, rho, rho * (r - q_sa) + v AS dr FROM
    (SELECT *, least((CASE WHEN a = 1 THEN pt ELSE 1.0 - pt END) / greatest(CASE WHEN a = 1 THEN pb1 ELSE pb0 END, 1e-6), 20.0)::DOUBLE AS rho FROM
      (SELECT *, CASE WHEN valid1 = 1 THEN exp((q1 - greatest(q0, q1)) / tau) / (exp((q0 - greatest(q0, q1)) / tau) + exp((q1 - greatest(q0, q1)) / tau)) ELSE 0.0 END AS pt
       FROM rated, (VALUES (0.5::DOUBLE), (1.0), (5.0)) g(tau)))""", "rated")


@query("ope_temperature", f"SELECT tau, {EVAL_SQL} FROM tau_steps GROUP BY 1", ("tau_steps",))
def ope_temperature(spark, sf):
    return eval_columns(ope.temperature_grid(rated(spark, sf), TAUS), "tau")


@query("ope_report", """SELECT policy, unnest(['n', 'dr_mean', 'wis_mean']) AS metric, unnest([count(*)::DOUBLE, round(avg(dr), 6), round(sum(rho * r) / sum(rho), 6)]) AS value,
    '{"estimator":"dr","split":"test"}' AS metadata FROM dr GROUP BY policy""", ("dr",))
def ope_report(spark, sf):
    e = ope.evaluate(ope.policy_steps(rated(spark, sf), policy_columns()), with_percentiles=False).select("policy", "n", "dr_mean", "wis_mean")
    return ope.report(e, estimator="dr", split="test").withColumn("value", F.round("value", 6))


# ---- cycle time by recommendation ----------------------------------------------------------------

cte("flags", """SELECT s.case_id, coalesce(f.iv, false) AS intervened FROM (SELECT case_id FROM splits WHERE split = 'test') s
    LEFT JOIN (SELECT case_id, bool_or(a_star = 1) AS iv FROM scored GROUP BY 1) f USING (case_id)""", "splits", "scored")
cte("ct", "SELECT case_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0 AS ct_days FROM log_session GROUP BY 1", "log_session")


@query("cycle_time_audit", """SELECT count(*) AS n_cases, count(*) FILTER (ct_days IS NULL) AS n_missing_ct, round(avg(CASE WHEN intervened THEN 1.0 ELSE 0.0 END), 6) AS intervention_rate,
    round(avg(ct_days) FILTER (intervened), 6) AS ct_with, round(avg(ct_days) FILTER (NOT intervened), 6) AS ct_without, round(avg(ct_days), 6) AS ct_overall,
    round(avg(ct_days) FILTER (intervened) - avg(ct_days) FILTER (NOT intervened), 6) AS delta_days,
    round(100.0 * (avg(ct_days) FILTER (intervened) - avg(ct_days) FILTER (NOT intervened)) / avg(ct_days) FILTER (NOT intervened), 5) AS delta_pct
    FROM flags JOIN ct USING (case_id)""", ("flags", "ct"))
def cycle_time_audit(spark, sf):
    s = scored(spark, sf).withColumn("a_star", values.greedy_action(F.col("q"), F.col("valid_actions")))
    test = session_splits(spark, sf).where("split = 'test'")
    flags = cases.case_interventions(s, test)
    audit = cases.cycle_time_audit(cases.cycle_time(views.log_session(spark, sf, segment=False)), flags)
    return audit.select("n_cases", "n_missing_ct", *r6("intervention_rate", "ct_with", "ct_without", "ct_overall", "delta_days"), F.round("delta_pct", 5).alias("delta_pct"))


# fixed values: a linear scorer over (value, prefix_len, count_view), one row per action
SCORER = ((0.02, -0.3, 0.125), (0.05, 0.1, -0.25))


def linear_scorer():
    """A user's model: built once per worker, matrices in and out."""
    import numpy as np

    weights = np.array(SCORER)
    return lambda states: states @ weights.T + np.array([0.5, 0.0])


_Q = [f"(value * {a}::DOUBLE + prefix_len * {b}::DOUBLE + count_view * {c}::DOUBLE + {d}::DOUBLE)" for (a, b, c), d in zip(SCORER, (0.5, 0.0), strict=True)]


@query("scorer_values", f"SELECT case_id, t, round({_Q[0]}, 6) + 0.0 AS q0, round({_Q[1]}, 6) + 0.0 AS q1, CAST({_Q[1]} > {_Q[0]} AS INTEGER) AS a_star FROM feat_session", ("feat_session",))
def scorer_values(spark, sf):
    """A user's vectorised model fills the value contract of the policy operators."""
    f = cases.case_features(views.log_session(spark, sf), ["value"], ["view"])
    q = scorers.with_values(f, ["value", "prefix_len", "count_view"], linear_scorer, 2)
    every = F.array(F.lit(1).cast("tinyint"), F.lit(1).cast("tinyint"))
    scored = q.withColumns({"q0": F.col("q")[0], "q1": F.col("q")[1], "a_star": values.greedy_action(F.col("q"), every).cast("int")})
    return scored.select("case_id", "t", *r6("q0", "q1"), "a_star")
