"""Queries on selection, attribution, clusters and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import render
from ..operators import cases, clean, encode, explain, values
from ..plans import ranking
from ..session import scratch_dir, stored
from ..sources import views
from .base import MAX_LEN, SPEC, cte, query, r6, session_splits, session_transitions, sql6
from .policy import GAMMA, N

N_CASES, N_RANDOM, P_REMOVE = 200, 5, (0.1, 0.2, 0.3, 0.5)
ACTIVITIES = views.EVENT_TYPES

cte("test_tr", "SELECT k.* FROM scored k JOIN splits USING (case_id) WHERE split = 'test'", "scored", "splits")
cte("picked", f"SELECT case_id FROM (SELECT DISTINCT case_id FROM test_tr) ORDER BY md5('123:' || case_id), case_id LIMIT {N_CASES}", "test_tr")
cte("items", "SELECT * FROM test_tr JOIN picked USING (case_id) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY t DESC) = 1", "test_tr", "picked")
cte("pos", f"""SELECT i.case_id, i.t, i.valid1, i.q0, i.q1, i.v, i.a_star, {MAX_LEN} - least(i.t, {MAX_LEN}) + e.t - greatest(i.t - {MAX_LEN}, 0) - 1 AS position,
    e.activity, least(i.t, {MAX_LEN}) AS n FROM items i JOIN seq_session e ON e.case_id = i.case_id AND e.t <= i.t AND e.t > i.t - {MAX_LEN}""", "items", "seq_session")


def rescored(name: str, removed: str, keys: str, *deps: str) -> None:
    """Values after removing the positions listed in ``removed`` (case_id, t, <keys>, position)."""
    on = "p.case_id = v.case_id AND p.t = v.t"
    extra = "".join(f", v.{k.strip()}" for k in keys.split(","))
    match = "".join(f" AND r.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    cte(f"{name}_state", f"""SELECT v.case_id, v.t{extra}, coalesce(arg_max(p.activity, p.position) FILTER (r.position IS NULL), '') AS la,
        count(*) FILTER (r.position IS NULL) AS n, coalesce(bool_or(p.activity = 'click') FILTER (r.position IS NULL), false) AS seen,
        any_value(p.valid1) AS valid1, any_value(p.q0) AS q0, any_value(p.q1) AS q1, any_value(p.v) AS v, any_value(p.a_star) AS a_star
        FROM (SELECT DISTINCT case_id, t, {keys} FROM {name}_all) v JOIN pos p ON {on}
        LEFT JOIN {removed} r ON r.case_id = v.case_id AND r.t = v.t{match} AND r.position = p.position GROUP BY ALL""", "pos", removed, f"{name}_all", *deps)
    cte(name, f"""SELECT s.*, q.q0 AS n0, q.q1 AS n1, CASE WHEN s.valid1 = 1 THEN greatest(q.q0, q.q1) ELSE q.q0 END AS nv,
        CASE WHEN s.valid1 = 1 AND q.q1 > q.q0 THEN 1 ELSE 0 END AS na FROM {name}_state s JOIN q_table q ON q.last_activity = s.la
        AND q.len_bin = CASE WHEN s.n < 5 THEN 0 WHEN s.n < 10 THEN 1 ELSE 2 END AND q.seen = s.seen""", f"{name}_state", "q_table")


cte("occ_all", "SELECT case_id, t, position AS gone FROM pos", "pos")
cte("occ_removed", "SELECT case_id, t, gone, gone AS position FROM occ_all", "occ_all")
rescored("occ", "occ_removed", "gone")
cte("attr", """SELECT o.case_id, o.t, o.gone AS position, v.id AS token_id, o.v, o.v - o.nv AS attribution, abs(o.v - o.nv) AS importance
    FROM occ o JOIN pos p ON p.case_id = o.case_id AND p.t = o.t AND p.position = o.gone JOIN vocab v ON v.token = p.activity""", "occ", "pos", "vocab")
cte("top", "SELECT *, row_number() OVER (PARTITION BY case_id, t ORDER BY importance DESC, position) AS rank FROM attr WHERE importance > 0 QUALIFY rank <= 10", "attr")
cte("gtop", """SELECT token_id, count(*) AS frequency, quantile_cont(importance, 0.5) AS median_importance FROM top GROUP BY 1
    ORDER BY frequency DESC, median_importance DESC, token_id LIMIT 10""", "top")


class Explained:
    """Scored test items of one run: transitions, vocabulary, value table by token id."""

    def __init__(self, spark, sf):
        log = views.log_session(spark, sf, segment=False)
        # read by the encoder, the value table and the decoder
        self.vocab = stored(encode.build_vocab(log))
        self.tr = values.with_state(session_transitions(spark, sf, self.vocab))
        self.q_table = values.return_table(values.state_cells(self.tr, GAMMA), N)
        self.table = explain.token_table(self.q_table, self.vocab)
        self.test = clean.filter_split(self.tr, session_splits(spark, sf), "test")
        hit = self.vocab.where(F.col("token") == SPEC.trigger).select("id").first()
        self.trigger_id = hit["id"] if hit else -1

    def items(self):
        chosen = explain.select_cases_random(self.test, N_CASES)
        picked = explain.select_transitions(self.test, chosen, "last").drop("len_bin", "seen")
        return values.with_greedy(explain.score_tokens(picked, self.table, self.trigger_id, "s", "s_mask"))

    def attributions(self, target="V"):
        # both the items and their rankings are read several times
        self.rows = stored(self.items())
        return explain.occlusion(self.rows, self.table, self.trigger_id, target)


# ---- selection -----------------------------------------------------------------------------------


@query("select_cases_random", "SELECT case_id FROM picked", ("picked",))
def select_cases_random(spark, sf):
    test = clean.filter_split(session_transitions(spark, sf), session_splits(spark, sf), "test")
    return explain.select_cases_random(test, N_CASES)


@query("select_cases_stratified", """SELECT case_id, reward_bin FROM
    (SELECT *, row_number() OVER (PARTITION BY reward_bin ORDER BY md5('123:' || case_id), case_id) AS rk, count(*) OVER (PARTITION BY reward_bin) AS sz, count(*) OVER () AS n FROM
      (SELECT case_id, CAST(x >= e.q1 AS INT) + CAST(x >= e.q2 AS INT) + CAST(x >= e.q3 AS INT) AS reward_bin FROM (SELECT case_id, sum(r) AS x FROM tr_session GROUP BY 1),
       (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM (SELECT sum(r) AS x FROM tr_session GROUP BY case_id)) e))
    WHERE rk <= least(greatest(1, floor(100.0::DOUBLE * sz / n)), sz) ORDER BY reward_bin, rk LIMIT 100""", ("tr_session",))
def select_cases_stratified(spark, sf):
    return explain.select_cases_stratified(cases.case_reward(session_transitions(spark, sf)), 100)


@query("select_transitions", "SELECT case_id, t FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t DESC) AS rn FROM test_tr JOIN picked USING (case_id)) WHERE rn <= 2", ("test_tr", "picked"))
def select_transitions(spark, sf):
    test = clean.filter_split(session_transitions(spark, sf), session_splits(spark, sf), "test")
    return explain.select_transitions(test, explain.select_cases_random(test, N_CASES), 2).select("case_id", "t")


@query("valid_action_gaps", "SELECT count(*) AS n_items, count(*) FILTER (t % 3 = 0) AS n_without_valid_action FROM tr_session", ("tr_session",))
def valid_action_gaps(spark, sf):
    none = F.transform("valid_actions", lambda _: F.lit(0).cast("tinyint"))
    return explain.valid_action_gaps(session_transitions(spark, sf).withColumn("valid_actions", F.when(F.col("t") % 3 == 0, none).otherwise(F.col("valid_actions"))))


# ---- attribution ---------------------------------------------------------------------------------


@query("occlusion", f"SELECT case_id, t, position, token_id, {sql6('attribution', 'importance')} FROM attr", ("attr",))
def occlusion(spark, sf):
    return Explained(spark, sf).attributions().select("case_id", "t", "position", "token_id", *r6("attribution", "importance"))


@query("top_tokens_item", "SELECT case_id, t, position, token_id, rank, round(importance, 6) AS importance FROM top WHERE rank <= 3", ("top",))
def top_tokens_item(spark, sf):
    return explain.top_tokens(Explained(spark, sf).attributions(), 3).select("case_id", "t", "position", "token_id", "rank", *r6("importance"))


@query("top_tokens_global", "SELECT token_id, frequency, round(median_importance, 6) AS median_importance FROM gtop", ("gtop",))
def top_tokens_global(spark, sf):
    top = explain.top_tokens(Explained(spark, sf).attributions(), 10)
    return explain.global_top_tokens(top, 10).select("token_id", "frequency", *r6("median_importance"))


@query("explanation_items", """SELECT i.case_id, i.t, i.a_star, round(i.v, 6) AS v,
    coalesce(string_agg(x.rank || ':' || x.position || ':' || w.token || ':' || coalesce(CAST(g.frequency AS VARCHAR), ''), ',' ORDER BY x.rank), '') AS tokens
    FROM items i LEFT JOIN top x ON x.case_id = i.case_id AND x.t = i.t LEFT JOIN vocab w ON w.id = x.token_id LEFT JOIN gtop g ON g.token_id = x.token_id GROUP BY ALL""",
       ("items", "top", "vocab", "gtop"))
def explanation_items(spark, sf):
    e = Explained(spark, sf)
    top = explain.top_tokens(e.attributions(), 10)
    out = explain.explanation_items(e.rows, top, e.vocab, explain.global_top_tokens(top, 10))
    tokens = F.array_join(F.transform("top_tokens", lambda s: F.concat_ws(":", s["rank"], s["position"], s["token_name"], F.coalesce(s["global_frequency"].cast("string"), F.lit("")))), ",")
    return out.select("case_id", "t", "a_star", *r6("v"), tokens.alias("tokens"))


@query("completeness", """SELECT count(*) AS n_items, round(avg(ae), 6) AS abs_mean, round(avg(re), 6) AS rel_mean, round(min(re), 6) AS rel_min, round(max(re), 6) AS rel_max,
    round(stddev_pop(re), 6) AS rel_std, round(quantile_cont(re, 0.5), 6) AS rel_median FROM
    (SELECT abs(s - (v - b)) AS ae, abs(s - (v - b)) / greatest(abs(v - b), 1.0) AS re FROM (SELECT case_id, t, sum(attribution) AS s, max(v) AS v FROM attr GROUP BY ALL),
     (SELECT greatest(q0, q1) AS b FROM q_table WHERE last_activity = '' AND len_bin = 0 AND NOT seen))""", ("attr", "q_table"))
def completeness(spark, sf):
    e = Explained(spark, sf)
    c = explain.completeness(e.attributions(), explain.empty_state_value(e.table))
    return c.select("n_items", *r6("abs_mean", "rel_mean", "rel_min", "rel_max", "rel_std", "rel_median"))


@query("linear_attribution", "SELECT case_id, t, round((value - 10.0) * 0.5, 6) AS attr_value, round((prefix_len - 1.0) * -2.0, 6) + 0.0 AS attr_prefix_len FROM feat_session", ("feat_session",))
def linear_attribution(spark, sf):
    f = cases.case_features(views.log_session(spark, sf), ["value"])
    return explain.linear_attribution(f, ["value", "prefix_len"], [0.5, -2.0], [10.0, 1.0]).select("case_id", "t", *r6("attr_value", "attr_prefix_len"))


# ---- clusters ------------------------------------------------------------------------------------

cte("clusters", """SELECT last_activity AS cluster_id, count(*) AS n, avg(v) AS mean_v, stddev_pop(v) AS std_v, avg(delta_q) AS mean_delta_q, avg(margin) AS mean_policy_margin,
    avg(a_star) AS share_1 FROM scored GROUP BY 1""", "scored")


def clusters(spark, sf):
    tr = values.with_state(session_transitions(spark, sf))
    s = values.with_greedy(values.score(tr, values.return_table(values.state_cells(tr, GAMMA), N)))
    return explain.cluster_profile(s.withColumn("cluster_id", F.col("last_activity")), N)


PROFILE = ("mean_v", "std_v", "mean_delta_q", "mean_policy_margin")


@query("cluster_profile", f"SELECT cluster_id, n, {sql6(*PROFILE, 'share_1')} FROM clusters", ("clusters",))
def cluster_profile(spark, sf):
    return clusters(spark, sf).select("cluster_id", "n", *r6(*PROFILE), F.round(F.col("action_distribution")["1"], 6).alias("share_1"))


cte("centers", """SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""")
cte("proto", """SELECT label AS cluster, vec_id AS state_id, d AS distance, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM
    (SELECT e.label, e.vec_id, sqrt(sum((e.x - c.c) * (e.x - c.c))) AS d FROM
      (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e JOIN centers c ON c.label = e.label AND c.i = e.i GROUP BY ALL)
    QUALIFY rank <= 3""", "centers")


@query("prototypes", "SELECT cluster, state_id, round(distance, 6) AS distance, rank FROM proto", ("proto",))
def prototypes(spark, sf):
    s = views.states(spark, sf)
    return explain.prototypes(s, explain.centroids(s, 64), 3).select("cluster", "state_id", *r6("distance"), "rank")


@query("cluster_summary", """SELECT label AS cluster, count(*) AS n, (SELECT string_agg(state_id, ',' ORDER BY rank) FROM proto p WHERE p.cluster = e.label) AS prototypes
    FROM embeddings e GROUP BY label""", ("proto",))
def cluster_summary(spark, sf):
    s = views.states(spark, sf)
    protos = explain.prototypes(s, explain.centroids(s, 64), 3)
    out = explain.cluster_summary(s.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), protos, "cluster")
    return out.select("cluster", "n", render(F.transform("prototypes", lambda p: p["state_id"])).alias("prototypes"))


@query("kmeans_states")
def kmeans_states(spark, sf):
    e = Explained(spark, sf)
    ids = {r["token"]: r["id"] for r in e.vocab.where(F.col("token").isin(list(ACTIVITIES))).collect()}  # five names
    f = explain.state_features(e.tr, ACTIVITIES, "s", ids)
    names = [f"n_{a}" for a in ids] + [f"last_{a}" for a in ACTIVITIES] + ["prefix_len"]
    return explain.kmeans_states(f, names, 8, 123, n_init=2).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("kmeans_certificate", "SELECT count(*) AS n_states, true AS k_used, 0 AS n_misplaced FROM tr_session", ("tr_session",))
def kmeans_certificate(spark, sf):
    """Clusters of the states at convergence: no state is nearer to another cluster's mean."""
    f = cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click"])
    names = ["value", "prefix_len", "count_view", "count_click"]
    rows = session_transitions(spark, sf).select("case_id", "t").join(f.select("case_id", "t", *names), ["case_id", "t"])
    got = explain.kmeans_certificate(explain.kmeans_states(stored(rows), names, 8, 123, 1, 300, 1e-12), names)
    return got.select("n_states", F.col("n_clusters").between(2, 8).alias("k_used"), "n_misplaced")


cte("state_feat", """SELECT t.case_id, t.t, CAST(t.t AS DOUBLE) AS prefix_len, CAST(t.last_activity = 'view' AS INT)::DOUBLE AS last_view,
    (SELECT count(*) FROM seq_session e WHERE e.case_id = t.case_id AND e.t <= t.t AND e.t > t.t - 10 AND e.activity = 'view')::DOUBLE AS n_view FROM tr_session t""", "tr_session", "seq_session")


@query("state_features", "SELECT * FROM state_feat", ("state_feat",))
def state_features(spark, sf):
    vocab = encode.build_vocab(views.log_session(spark, sf, segment=False), max_size=1000)
    tr = session_transitions(spark, sf, vocab)
    view_id = vocab.where("token = 'view'").select("id").first()["id"]
    return explain.state_features(tr, ["view"], "s", {"view": view_id}).select("case_id", "t", "prefix_len", "last_view", "n_view")


# ---- fidelity ------------------------------------------------------------------------------------

cte("grid", f"""SELECT case_id, t, p, rep, CAST(greatest(1, ceil(p * n)) AS BIGINT) AS k FROM (SELECT DISTINCT case_id, t, n FROM pos),
    (VALUES {', '.join(f'({p}::DOUBLE)' for p in P_REMOVE)}) g(p), range(-1, {N_RANDOM}) r(rep)""", "pos")
cte("fid_removed", """SELECT g.case_id, g.t, g.p, g.rep, x.position, x.rank AS rk FROM grid g JOIN top x ON x.case_id = g.case_id AND x.t = g.t AND g.rep = -1 AND x.rank <= g.k UNION ALL
    SELECT case_id, t, p, rep, position, rk FROM (SELECT g.*, o.position, row_number() OVER (PARTITION BY g.case_id, g.t, g.p, g.rep
      ORDER BY md5('123:' || g.case_id || ':' || g.t || ':' || g.rep || ':' || o.position), o.position) AS rk FROM grid g JOIN pos o ON o.case_id = g.case_id AND o.t = g.t WHERE g.rep >= 0) WHERE rk <= k""",
    "grid", "top", "pos")
cte("fid_all", "SELECT case_id, t, p, rep FROM grid", "grid")
rescored("fid", "fid_removed", "p, rep")
cte("drop_item", """SELECT p, case_id, t, max(v) AS o, max(v - nv) FILTER (rep = -1) AS top, avg(v - nv) FILTER (rep >= 0) AS rnd, stddev_pop(v - nv) FILTER (rep >= 0) AS rs
    FROM fid GROUP BY ALL""", "fid")
cte("qdrop", """SELECT p, unnest(['drop_topk', 'drop_topk_norm', 'drop_rand_mean', 'drop_rand_std', 'gap', 'gap_norm']) AS metric, unnest([avg(top), avg(top / (abs(o) + 1e-6)), avg(rnd), avg(rs),
    avg(top - rnd), avg((top - rnd) / (abs(o) + 1e-6))]) AS value, count(*) AS n_items FROM drop_item GROUP BY p""", "drop_item")


def variants(spark, sf, mode="mask_topk"):
    e = Explained(spark, sf)
    top = explain.top_tokens(e.attributions(), 10)
    return explain.perturbed(e.rows, top, e.table, e.trigger_id, P_REMOVE, N_RANDOM, 123, mode, 10)


@query("q_drop", "SELECT p AS p_remove, metric, round(value, 5) + 0.0 AS value, n_items FROM qdrop", ("qdrop",))
def q_drop(spark, sf):
    return explain.q_drop(variants(spark, sf)).select("p_remove", "metric", (F.round("value", 5) + F.lit(0.0)).alias("value"), "n_items")


cte("dq", """SELECT p, case_id, t, rep, CASE WHEN a_star = 1 THEN q1 - q0 ELSE 0.0 END AS o, CASE WHEN a_star = 1 THEN n1 - n0 ELSE 0.0 END AS nw FROM fid""", "fid")


@query("q_drop_delta", """SELECT p AS p_remove, round(avg(top), 6) + 0.0 AS drop_topk, round(avg(top - rnd), 6) + 0.0 AS gap FROM
    (SELECT p, case_id, t, max(o - nw) FILTER (rep = -1) AS top, avg(o - nw) FILTER (rep >= 0) AS rnd FROM dq GROUP BY ALL) GROUP BY 1""", ("dq",))
def q_drop_delta(spark, sf):
    rows = explain.q_drop(variants(spark, sf), "delta_q")
    return explain.fidelity_pivot(rows, ["drop_topk", "gap"]).select("p_remove", *r6("drop_topk", "gap"))


@query("action_flip", """SELECT p AS p_remove, unnest(['flip_topk', 'flip_rand_mean', 'flip_rand_std', 'flip_gap', 'flip_possible_rate', 'flip_topk_on_possible', 'flip_rand_mean_on_possible', 'flip_gap_on_possible']) AS metric,
    unnest([round(a, 6), round(b, 6), round(c, 6), round(a - b, 6) + 0.0, round(k / n, 6), round(coalesce(d, 0), 6), round(coalesce(e, 0), 6), round(coalesce(d, 0) - coalesce(e, 0), 6) + 0.0]) AS value,
    unnest([n, n, n, n, n, k, k, k])::BIGINT AS n_items FROM
    (SELECT p, avg(f) FILTER (rep < 0) AS a, avg(f) FILTER (rep >= 0) AS b, stddev_pop(f) FILTER (rep >= 0) AS c, avg(f) FILTER (rep < 0 AND valid1 = 1) AS d, avg(f) FILTER (rep >= 0 AND valid1 = 1) AS e,
      count(*) FILTER (rep < 0)::DOUBLE AS n, count(*) FILTER (rep < 0 AND valid1 = 1)::DOUBLE AS k FROM (SELECT *, CASE WHEN na <> a_star THEN 1.0 ELSE 0.0 END AS f FROM fid) GROUP BY 1)""", ("fid",))
def action_flip(spark, sf):
    return explain.action_flip(variants(spark, sf)).select("p_remove", "metric", (F.round("value", 6) + F.lit(0.0)).alias("value"), "n_items")


@query("deletion_zero", """SELECT p AS p_remove, round(avg(v - nv), 6) + 0.0 AS drop_topk FROM
    (SELECT s.p, s.v, CASE WHEN s.valid1 = 1 THEN greatest(q.q0, q.q1) ELSE q.q0 END AS nv FROM
      (SELECT f.case_id, f.t, f.p, f.v, f.valid1, f.seen, least(f.t, 10) AS n,
        CASE WHEN EXISTS (SELECT 1 FROM fid_removed r WHERE r.case_id = f.case_id AND r.t = f.t AND r.p = f.p AND r.rep = -1 AND r.position = 9) THEN '' ELSE f.la END AS la
       FROM fid f WHERE f.rep = -1) s
     JOIN q_table q ON q.last_activity = s.la AND q.len_bin = CASE WHEN s.n < 5 THEN 0 WHEN s.n < 10 THEN 1 ELSE 2 END AND q.seen = s.seen) GROUP BY 1""", ("fid", "fid_removed", "q_table"))
def deletion_zero(spark, sf):
    rows = explain.q_drop(variants(spark, sf, "zero_topk"))
    return explain.fidelity_pivot(rows, ["drop_topk"]).select("p_remove", *r6("drop_topk"))


# every listed position takes the token of the next one in the list; the last position and with it the last activity may change
cte("turned", """SELECT a.case_id, a.t, a.p, a.rep, o.activity FROM (SELECT *, count(*) OVER (PARTITION BY case_id, t, p, rep) AS m FROM fid_removed) a
    JOIN fid_removed b ON b.case_id = a.case_id AND b.t = a.t AND b.p = a.p AND b.rep = a.rep AND b.rk = a.rk % a.m + 1
    JOIN pos o ON o.case_id = a.case_id AND o.t = a.t AND o.position = b.position WHERE a.position = 9""", "fid_removed", "pos")
cte("perm", """SELECT s.*, CASE WHEN valid1 = 1 THEN greatest(coalesce(q.q0, e.q0), coalesce(q.q1, e.q1)) ELSE coalesce(q.q0, e.q0) END AS nv FROM
    (SELECT g.case_id, g.t, g.p, g.rep, o.valid1, o.v, o.n, coalesce(m.activity, o.activity) AS la, k.seen FROM grid g JOIN pos o ON o.case_id = g.case_id AND o.t = g.t AND o.position = 9
     JOIN (SELECT case_id, t, bool_or(activity = 'click') AS seen FROM pos GROUP BY ALL) k ON k.case_id = g.case_id AND k.t = g.t
     LEFT JOIN turned m ON m.case_id = g.case_id AND m.t = g.t AND m.p = g.p AND m.rep = g.rep) s
    LEFT JOIN q_table q ON q.last_activity = s.la AND q.len_bin = CASE WHEN s.n < 5 THEN 0 WHEN s.n < 10 THEN 1 ELSE 2 END AND q.seen = s.seen
    JOIN (SELECT q0, q1 FROM q_table WHERE last_activity = '' AND len_bin = 0 AND NOT seen) e ON true""", "grid", "pos", "turned", "q_table")


@query("deletion_permute", """SELECT p AS p_remove, round(avg(top), 6) + 0.0 AS drop_topk, round(avg(rnd), 6) + 0.0 AS drop_rand_mean FROM
    (SELECT p, case_id, t, max(v - nv) FILTER (rep = -1) AS top, avg(v - nv) FILTER (rep >= 0) AS rnd FROM perm GROUP BY ALL) GROUP BY 1""", ("perm",))
def deletion_permute(spark, sf):
    rows = explain.q_drop(variants(spark, sf, "permute_topk"))
    return explain.fidelity_pivot(rows, ["drop_topk", "drop_rand_mean"]).select("p_remove", *r6("drop_topk", "drop_rand_mean"))


@query("rank_consistency", """SELECT metric, round(value, 6) AS value, n AS n_items, 'mean_v' AS score_q_used,
    (SELECT string_agg(DISTINCT CASE WHEN mean_policy_margin IS NOT NULL THEN 'mean_policy_margin' WHEN std_v IS NOT NULL THEN 'std_v' ELSE 'mean_v' END, ',') FROM clusters) AS score_ope_used FROM (
    SELECT 'spearman' AS metric, corr(rx, ry) AS value, count(*) AS n FROM (SELECT rank() OVER (ORDER BY mean_v) AS rx, rank() OVER (ORDER BY mean_policy_margin) + (count(*) OVER (PARTITION BY mean_policy_margin) - 1) / 2.0 AS ry FROM clusters)
    UNION ALL SELECT 'kendall', sum(sign(a.mean_v - b.mean_v) * sign(a.mean_policy_margin - b.mean_policy_margin)) / sqrt(sum(abs(sign(a.mean_v - b.mean_v))) * sum(abs(sign(a.mean_policy_margin - b.mean_policy_margin)))),
      (SELECT count(*) FROM clusters) FROM clusters a, clusters b)""", ("clusters",))
def rank_consistency(spark, sf):
    return explain.rank_consistency(clusters(spark, sf)).select("metric", *r6("value"), "n_items", "score_q_used", "score_ope_used")


_UNITS = "SELECT round(value) AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) + round(value / 25) AS y FROM events WHERE event_type <> 'error'"


@query("rank_units", f"""WITH u AS ({_UNITS}), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS nx, sum(abs(sign(a.y - b.y))) AS ny FROM u a, u b)
    SELECT round((SELECT corr(rx, ry) FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM u)), 6) AS spearman,
    round(s / sqrt(nx * ny), 6) AS kendall, (SELECT count(*) FROM u) AS n FROM s""")
def rank_units(spark, sf):
    """Rank agreement of thousands of units with many ties: events by value and by a score."""
    units = views.events(spark, sf).where("event_type <> 'error'").select(
        F.round("value").alias("x"), (F.get_json_object("props", "$.k").cast("double") + F.round(F.col("value") / 25)).alias("y"))
    both = ranking.kendall(units, "x", "y", cell=100).withColumn("spearman", ranking.spearman(units, "x", "y").select("spearman").scalar())
    return both.select(*r6("spearman", "kendall"), "n")


@query("cluster_fit", "SELECT round(regr_slope(mean_policy_margin, mean_v), 6) AS slope, round(regr_intercept(mean_policy_margin, mean_v), 6) AS intercept, count(*) AS n FROM clusters", ("clusters",))
def cluster_fit(spark, sf):
    return explain.cluster_fit(clusters(spark, sf)).select(*r6("slope", "intercept"), "n")


@query("fidelity_pivot", """SELECT p AS p_remove, round(max(value) FILTER (metric = 'drop_topk'), 6) + 0.0 AS drop_topk, round(max(value) FILTER (metric = 'drop_rand_mean'), 6) + 0.0 AS drop_rand_mean,
    round(max(value) FILTER (metric = 'gap'), 6) + 0.0 AS gap FROM qdrop GROUP BY 1""", ("qdrop",))
def fidelity_pivot(spark, sf):
    e = Explained(spark, sf)
    top = explain.top_tokens(e.attributions(), 10)
    rows = explain.fidelity(e.rows, top, e.table, e.trigger_id, P_REMOVE, N_RANDOM, cap=10, run={"config_hash": "default"})
    return explain.fidelity_pivot(rows.where("test = 'q_drop'"), ["drop_topk", "drop_rand_mean", "gap"]).select("p_remove", *r6("drop_topk", "drop_rand_mean", "gap"))


@query("fidelity_store", "SELECT p AS p_remove, metric, round(value, 6) + 0.0 AS value, n_items, 'c1' AS config_hash, 'g1' AS git_commit FROM qdrop", ("qdrop",))
def fidelity_store(spark, sf):
    """The table of the tests with the columns of its run, written and read back."""
    e = Explained(spark, sf)
    top = explain.top_tokens(e.attributions(), 10)
    path = scratch_dir(spark, "fidelity")
    explain.fidelity(e.rows, top, e.table, e.trigger_id, P_REMOVE, N_RANDOM, cap=10, tests=("q_drop",), run={"config_hash": "c1", "git_commit": "g1"}).write.parquet(path)
    return spark.read.parquet(path).select("p_remove", "metric", (F.round("value", 6) + F.lit(0.0)).alias("value"), "n_items", "config_hash", "git_commit")
