"""Hand-computed values and invariants on tiny inputs."""

import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from tracelake.functions import arrays as A
from tracelake.operators import cases, clean, encode, explain, guard, monitor, ope, splits, transitions, values
from tracelake.operators.distill import rule_list
from tracelake.operators.transitions import DecisionSpec
from tracelake.plans.sequence import segment_cases

BOTH = ("wait", "remind")
PLAIN = DecisionSpec(actions=BOTH, trigger="remind", noop="wait", default_valid=("wait",))
SPEC = replace(PLAIN, by_last_activity={"lend": BOTH, "renew": BOTH})


@pytest.fixture(scope="module")
def log(tiny_log):
    return clean.require_valid(clean.parse_timestamps(tiny_log))


@pytest.fixture(scope="module")
def vocab(log):
    return encode.build_vocab(log)


@pytest.fixture(scope="module")
def tr(log, vocab):
    return transitions.build_transitions(log, SPEC, ("max", F.col("outcome")), vocab, 10)


# ---- cleaning ------------------------------------------------------------------------------------


def test_bad_timestamps_become_null(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("nonsense",)], "timestamp string")
    assert [r[0] is None for r in clean.parse_timestamps(df).collect()] == [False, True]
    naive = clean.parse_timestamps(df, tz_in="Europe/Madrid").select(F.date_format("timestamp", "HH:mm")).first()[0]
    assert naive == "09:00"
    assert dict(clean.parse_timestamps(df, tz_out=None).dtypes)["timestamp"] == "timestamp_ntz"


def test_replay_is_not_capped(spark):
    drawn = values.replay_sample(spark.range(20_000).selectExpr("id AS case_id", "id AS t"), 20.0).count()
    assert drawn == pytest.approx(400_000, rel=0.01)
    with pytest.raises(ValueError, match="at most 1"):
        values.replay_sample(spark.range(3), 2.0, with_replacement=False, keys=("id",))


def test_terminal_rewards_of_a_large_level(spark):
    tr = spark.createDataFrame([(i, t, 0, 1e9 + i % 2 if t == 2 else 0.0, int(t == 2)) for i in range(100) for t in (1, 2)], "case_id long, t int, a int, r double, done int")
    split = spark.range(100).selectExpr("id AS case_id", "'train' AS split")
    assert splits.split_profile(tr, split, 1).first()["terminal_reward_std"] == pytest.approx(0.5)


def test_missing_columns_and_nulls_raise(spark, log):
    with pytest.raises(ValueError, match="missing_column"):
        clean.require_valid(log.drop("activity"))
    with pytest.raises(ValueError, match="null_values"):
        clean.require_valid(log.withColumn("activity", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="empty_log"):
        clean.require_valid(log.limit(0))


def test_schema_differences(log):
    want = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("activity", T.StringType()), T.StructField("resource", T.StringType())])
    assert rows(clean.schema_differences(log, want)) == [("resource", "string", None)]


def test_first_duplicate_is_kept(spark, log):
    twice = log.unionByName(log.withColumn("event_id", F.col("event_id") + 100))
    assert rows(clean.drop_duplicate_events(twice), "event_id") == rows(log, "event_id")


def test_dense_case_ids_follow_string_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("10",), ("9",), ("b",)], "case_id string")
    assert rows(clean.encode_case_ids(df, out="n").distinct()) == [("10", 0), ("9", 1), ("a", 2), ("b", 3)]


def test_lifecycle_filter_ignores_case_and_absent_column(spark, log):
    df = spark.createDataFrame([("COMPLETE",), ("start",), (None,)], "lifecycle string")
    assert clean.filter_lifecycle(df, ["complete"]).count() == 1
    assert clean.filter_lifecycle(log, ["complete"]).count() == 12


def test_constant_column_normalises_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r[0] for r in clean.normalize_numeric(df, ["x"]).collect()] == [0.0, 0.0]


# ---- cases ---------------------------------------------------------------------------------------


def test_outcomes(log):
    assert rows(cases.presence_outcome(log, ["lost"])) == [(1, 0.0), (2, 0.0), (3, 1.0)]
    assert rows(cases.presence_outcome(log, [])) == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert rows(cases.terminal_value(log)) == [(1, 7.0), (2, 1.0), (3, 3.0)]


def test_cycle_time(log):
    got = dict(rows(cases.cycle_time(log)))
    assert got[1] == pytest.approx(120 / 1440) and got[2] == pytest.approx(45 / 1440)


def test_features_clamp_and_unknown_case(spark, log):
    f = cases.case_features(log, ["outcome", "absent"], ["return"])
    want = spark.createDataFrame([(1, 99), (1, 0), (77, 2)], "case_id long, t int")
    got = {(r["case_id"], r["t"]): r for r in cases.features_at(f, want, cases.case_sizes(log)).collect()}
    assert got[(1, 99)]["prefix_len"] == 5.0 and got[(1, 99)]["count_return"] == 1.0
    assert got[(1, 0)]["prefix_len"] == 1.0 and got[(1, 0)]["absent"] == 0.0
    assert got[(77, 2)]["missing"] and got[(77, 2)]["outcome"] == 0.0


# ---- encoding ------------------------------------------------------------------------------------


def test_vocabulary_order(vocab):
    assert rows(vocab, "id", "token") == [(2, "lend"), (3, "return"), (4, "fine"), (5, "renew"), (6, "lost"), (7, "remind")]


def test_vocabulary_limits(log):
    assert rows(encode.build_vocab(log, min_freq=2), "token") == [("fine",), ("lend",), ("renew",), ("return",)]
    assert rows(encode.build_vocab(log, max_size=4), "id") == [(2,), (3,)]


def test_truncation_keeps_last_or_first(spark):
    df = spark.createDataFrame([(1, a, i) for i, a in enumerate("ABCDE")], "case_id int, activity string, event_id int")
    v = encode.build_vocab(df)
    left = encode.encode_prefixes(df, v, 3, order=("event_id",)).where("t = 5").first()
    right = encode.encode_prefixes(df, v, 3, truncation="right", padding="right", order=("event_id",)).where("t = 5").first()
    assert (left["x"], left["mask"], left["t"]) == ([4, 5, 6], [1, 1, 1], 5)
    assert right["x"] == [2, 3, 4]
    short = encode.encode_prefixes(df, v, 3, order=("event_id",)).where("t = 2").first()
    assert (short["x"], short["mask"], short["length"]) == ([0, 2, 3], [0, 1, 1], 2)


def test_unknown_tokens(log, vocab):
    small = vocab.where("id <= 3")
    p = encode.encode_prefixes(log, small, 5)
    assert encode.unk_rate(p).first()[0] == pytest.approx(100 * 6 / 12)
    assert p.where("case_id = 3 AND t = 3").first()["x"] == [0, 0, 2, 1, 1]


def test_encoding_twice_is_equal(log, vocab):
    assert rows(encode.encode_prefixes(log, vocab, 10)) == rows(encode.encode_prefixes(log, vocab, 10))


# ---- transitions ---------------------------------------------------------------------------------


def test_transitions_by_hand(tr):
    got = rows(tr.withColumn("v", A.render(F.col("valid_actions"))), "case_id", "t", "last_activity", "next_activity", "a", "v", "done", "r")
    assert got == [
        (1, 1, "lend", "remind", 1, "1,1", 0, 0.0), (1, 2, "remind", "fine", 0, "1,0", 0, 0.0), (1, 3, "fine", "renew", 0, "1,0", 0, 0.0),
        (1, 4, "renew", "return", 0, "1,1", 1, 8.0), (2, 1, "lend", "renew", 0, "1,1", 0, 0.0), (2, 2, "renew", "return", 0, "1,1", 1, 2.0),
        (3, 1, "lend", "lost", 0, "1,1", 0, 0.0), (3, 2, "lost", "fine", 0, "1,0", 0, 0.0), (3, 3, "fine", "return", 0, "1,0", 1, 9.0)]


@pytest.mark.parametrize("max_rows", [1_000_000, 2])
def test_last_outcome_is_the_last_that_is_known(log, max_rows):
    cut = segment_cases(log, max_rows=max_rows)
    last = transitions.build_transitions(cut, SPEC, ("last", F.col("outcome")))
    assert rows(last.where("done = 1"), "case_id", "r") == [(1, 7.0), (2, 1.0), (3, 3.0)]


def test_transitions_are_events_minus_cases(log, tr):
    assert tr.count() == log.count() - log.select("case_id").distinct().count()


def test_next_state_is_the_following_state(tr):
    a = {(r["case_id"], r["t"]): r for r in tr.collect()}
    for (c, t), r in a.items():
        if (c, t + 1) in a:
            assert r["s_next"] == a[(c, t + 1)]["s"] and r["s_next_mask"] == a[(c, t + 1)]["s_mask"]
    assert all(r["propensity"] == -1.0 and r["behavior_action"] == r["a"] for r in a.values())


def test_masked_action_is_dropped_and_counted(log):
    strict = PLAIN
    assert transitions.build_transitions(log, strict, ("max", F.col("outcome"))).count() == 8
    assert transitions.drop_counts(transitions.steps(log, strict, ("max", F.col("outcome")))).first()["n_masked"] == 1


def test_mask_of_unknown_names_is_the_default(spark):
    spec = DecisionSpec(by_last_activity={"x": ("fly",)})
    df = spark.createDataFrame([("x",), ("y",), (None,)], "last string")
    assert [r[0] for r in df.select(transitions.action_mask(F.col("last"), spec)).collect()] == [[1, 0]] * 3


def test_inclusive_action(log):
    st = transitions.steps(log, replace(SPEC, inclusive=True), ("max", F.col("outcome")))
    assert [r["a"] for r in st.where("case_id = 1").orderBy("t").collect()] == [1, 1, 0, 0]


def test_feedback_pairs(spark):
    data = [("a", 1, {"x": 1.0}, 0, None, False), ("a", 2, {"x": 2.0}, 1, 9.0, True), ("a", 3, {}, 0, 4.0, True), ("b", 1, {"x": 5.0}, 0, 3.0, True)]
    fb = spark.createDataFrame(data, "case_id string, t int, state_features map<string,double>, action_executed int, reward double, done boolean")
    got = rows(transitions.feedback_transitions(fb, ["x", "y"]), "case_id", "t", "s", "s_next", "a", "r", "done")
    assert got == [("a", 1, [1.0, 0.0], [2.0, 0.0], 0, 0.0, 0), ("a", 2, [2.0, 0.0], [0.0, 0.0], 1, 9.0, 1)]
    assert transitions.feedback_transitions(fb, ["x"], terminal="emit").count() == 3
    assert transitions.feedback_transitions(fb, ["x"], min_cases=2).count() == 0
    assert rows(transitions.feedback_transitions(fb, ["x", "y"], max_rows=1), "case_id", "t", "s", "s_next", "a", "r", "done") == got


# ---- validation and splits -----------------------------------------------------------------------


def test_structure_checks(tr):
    assert all(n == 0 for _, n in rows(splits.structure_violations(tr, 10, 2)))
    with pytest.raises(ValueError, match="missing:a"):
        splits.require_sound(tr.drop("a"), 10, 2)
    with pytest.raises(ValueError, match="invalid_action"):
        splits.require_sound(tr.withColumn("a", F.lit(1)), 10, 2)


def test_split_quotas(spark):
    for n, want in [(3, (2, 0, 1)), (10, (7, 1, 2)), (1, (0, 0, 1)), (100, (70, 10, 20))]:
        got = dict(rows(splits.split_random(spark.range(n).withColumnRenamed("id", "case_id")).groupBy("split").count()))
        # three cases: 2 / 0 leaves one case, which the min-one rule does not take from test
        assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_temporal_split_orders_cases(log):
    got = rows(splits.split_temporal(cases.case_start(log)), "case_id", "split")
    assert got == [(1, "train"), (2, "train"), (3, "test")]
    with pytest.raises(ValueError, match="ratios"):
        splits.split_random(log, ratios=(0.5, 0.1, 0.1))


def test_split_checks_find_overlap(spark, log):
    s = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val"), (9, "test")], "case_id long, split string")
    assert splits.split_checks(s, log).first().asDict() == {"n_overlapping": 1, "n_uncovered": 1, "n_unknown": 1}


def test_repeated_steps_are_found(tr):
    assert splits.monotonic_violations(tr).count() == 0
    assert splits.monotonic_violations(tr.union(tr)).count() == 9


# ---- values, policies, evaluation ----------------------------------------------------------------


def test_masking_and_greedy(spark):
    df = spark.createDataFrame([([1.0, 5.0, 3.0], [1, 0, 1]), ([2.0, 2.0, 1.0], [0, 1, 1]), ([4.0, 1.0, 1.0], [1, 0, 0])], "q array<double>, valid_actions array<int>")
    got = values.with_greedy(df, contrast=0).collect()
    assert [r["a_star"] for r in got] == [2, 1, 0]
    assert [r["v"] for r in got] == [3.0, 2.0, 4.0]
    assert [r["margin"] for r in got] == [2.0, 1.0, 0.0]
    assert [r["a_contrast"] for r in got] == [0, 1, 0]
    assert [r["delta_q"] for r in got] == [2.0, 0.0, 0.0]
    assert df.select(A.masked(F.col("q"), F.col("valid_actions"))).first()[0] == [1.0, -1e9, 3.0]


def test_policies_sum_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1, 1], 3), ([1.0, 2.0], [0, 1], 7), ([1.0, 2.0], [0, 0], 1)], "q array<double>, v array<int>, n int")
    q, v = F.col("q"), F.col("v")
    soft, noop, heur = (list(c) for c in zip(*[tuple(r) for r in df.select(
        values.softmax_policy(q, v), values.noop_policy(v, 0, 2), values.heuristic_policy(v, F.col("n"), 2)).collect()]))
    assert soft[0][1] == pytest.approx(math.e / (1 + math.e)) and soft[1] == [0.0, 1.0]
    assert noop == [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]
    assert heur == [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]
    assert all(sum(p) == pytest.approx(1.0) for p in soft + noop + heur)


def test_evaluation_by_hand(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.5, 0.5], [1, 1], 0, 2.0), (2, [0.0, 1.0], [0.5, 0.5], [1, 1], 0, 4.0)],
                               "case_id int, q array<double>, pi_b array<double>, valid_actions array<int>, a int, r double")
    noop = values.noop_policy(F.col("valid_actions"), 0, 2)
    e = ope.evaluate(ope.policy_steps(df, {"noop": noop})).first()
    # rho = 2 for both; dr = 2 (r - q_sa) + v
    assert e["dr_mean"] == pytest.approx(((2 * (2 - 1) + 1) + (2 * (4 - 0) + 1)) / 2)
    assert e["wis_mean"] == pytest.approx(3.0) and e["ess"] == pytest.approx(2.0) and e["rho_p99"] == 2.0
    capped = ope.evaluate(ope.policy_steps(df, {"noop": noop}, cap=1.0)).first()
    assert capped["dr_mean"] == pytest.approx((2 + 5) / 2)


def test_bootstrap_intervals_contain_the_estimate(spark):
    df = spark.range(300).select(
        F.col("id").alias("case_id"), F.lit("p").alias("policy"), (F.col("id") % 10).cast("double").alias("r"), F.lit(0.0).alias("q_sa"), F.lit(0.0).alias("v"),
        F.lit(1.0).alias("rho"), (F.col("id") % 10).cast("double").alias("dr"))
    for method in ("multinomial", "poisson"):
        ci = ope.bootstrap(df, 100, method=method).first()
        assert ci["dr_lo"] < 4.5 < ci["dr_hi"] and ci["n_replicates"] == 100
        assert ci["dr_hi"] - ci["dr_lo"] < 1.5


def test_multinomial_draws_meet_the_cases_in_a_shuffle_and_match_brute_force(spark):
    df = spark.createDataFrame([(i % 40, p, float(i % 7), 0.5, 1.0, 0.3 + i % 3, float(i % 11)) for i in range(90) for p in "xy"],
                               "case_id long, policy string, r double, q_sa double, v double, rho double, dr double")
    boot = ope.bootstrap(df, 25, 7)
    # an estimate of the draws does not see that each case becomes ``replicates`` rows; broadcast, they pass through the driver
    assert "ShuffledHashJoin [i#" in boot._jdf.queryExecution().executedPlan().toString()
    order = sorted(range(40), key=lambda c: hashlib.md5(f"7:order:{c}".encode()).hexdigest())
    data = df.toPandas()
    for policy in "xy":
        sums = data[data.policy == policy].assign(rr=lambda d: d.rho * d.r).groupby("case_id").agg(n=("r", "size"), dr=("dr", "sum"), rho=("rho", "sum"), rr=("rr", "sum"))
        drawn = [sums.loc[[order[int(hashlib.md5(f"7:{b}:{i}".encode()).hexdigest()[:15], 16) % 40] for i in range(40)]].sum() for b in range(25)]
        got = boot.where(F.col("policy") == policy).first()
        for name, values_ in (("dr", [d.dr / d.n for d in drawn]), ("wis", [d.rr / d.rho for d in drawn])):
            assert [got[f"{name}_lo"], got[f"{name}_hi"]] == pytest.approx(list(np.quantile(values_, [0.025, 0.975])))
        assert got["n_replicates"] == 25


def test_return_table_falls_back(tr):
    t = values.return_table(values.state_cells(tr), 2)
    q = {(r["last_activity"], r["len_bin"], r["seen"]): r["q"] for r in t.collect()}
    assert q[("lend", 0, False)] == [pytest.approx((0.99 * 2.0 + 0.99 ** 2 * 9.0) / 2), pytest.approx(0.99 ** 3 * 8.0)]
    # renew never sees action 1: the overall mean of that action stands in
    assert q[("renew", 0, False)] == [pytest.approx(2.0), pytest.approx(0.99 ** 3 * 8.0)]
    assert len(q) == 6 * 6


def test_sweeps_reach_the_discounted_outcome(tr):
    masks = {"lend": [1, 1], "renew": [1, 1]}
    t = values.sweep_table(tr, 2, "remind", masks, [1, 0], sweeps=6, target_every=1)
    q = {(r["last_activity"], r["seen"]): r["q"] for r in t.collect()}
    assert q[("renew", True)][0] == pytest.approx(8.0)
    assert q[("fine", False)][0] == pytest.approx(9.0)
    assert q[("lost", False)][0] == pytest.approx(0.99 * 9.0)


# ---- explanation ---------------------------------------------------------------------------------


def test_deletion_modes(spark):
    df = spark.createDataFrame([([0, 7, 8, 9], [0, 1, 1, 1], [1, 3])], "x array<int>, m array<tinyint>, p array<int>")
    get = lambda mode: [list(c) for c in df.select(*explain.remove_positions(F.col("x"), F.col("m"), F.col("p"), mode)).first()]
    assert get("mask_topk") == [[0, 0, 8, 0], [0, 0, 1, 0]]
    assert get("zero_topk") == [[0, 0, 8, 0], [0, 1, 1, 1]]
    assert get("permute_topk") == [[0, 9, 8, 7], [0, 1, 1, 1]]


def test_rank_consistency_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "mean_v double, mean_policy_margin double").withColumn("std_v", F.lit(0.0))
    assert dict(rows(explain.rank_consistency(df), "metric", "value")) == {"spearman": pytest.approx(0.8), "kendall": pytest.approx(4 / 6)}
    flat = df.withColumn("mean_policy_margin", F.lit(1.0))
    assert dict(rows(explain.rank_consistency(flat), "metric", "value")) == {"spearman": 0.0, "kendall": 0.0}


# ---- guard ---------------------------------------------------------------------------------------

GUARD = guard.GuardSpec(0.3, 3.0, 0, 0, "do_nothing", {"amount": (10000.0, 2000.0), "flat": (5.0, 0.0)})


def _guarded(spark, amount, conf, valid=None, override=None):
    df = spark.createDataFrame([(float(amount), 99.0, (1, conf), valid, override)],
                               "amount double, flat double, surrogate struct<action_id:int,confidence:double>, valid_actions array<int>, override struct<action_id:int,action_name:string,reason:string>")
    return guard.guard(df, GUARD, ["amount", "flat", "unknown"], actions=BOTH).first()


def test_guard_precedence(spark):
    assert _guarded(spark, 11000, 0.9)["source"] == "surrogate"
    odd = _guarded(spark, 20000, 0.9)
    assert (odd["source"], odd["ood"], odd["reason"]) == ("baseline", True, "OOD detected")
    masked = _guarded(spark, 20000, 0.9, [0])
    assert (masked["source"], masked["ood"], masked["reason"]) == ("baseline", False, "invalid_action=1")
    unsure = _guarded(spark, 11000, 0.5, [0, 1])
    assert unsure["reason"] == "uncertainty=0.500 > threshold=0.3"
    human = _guarded(spark, 20000, 0.1, [0], (1, None, None))
    assert (human["source"], human["action_id"], human["action_name"], human["reason"]) == ("override", 1, "unknown", "human decision")


def test_request_validation_rejects(spark):
    df = spark.createDataFrame([(-1.0, 0.5, 1.0), (float("nan"), 1.5, 0.0), (1.0, 0.0, 1.0)], "amount double, est_quality double, prefix_len double")
    assert [r["errors"] for r in clean.request_errors(df, ()).collect()] == [
        ["amount:negative"], ["amount:not_finite", "est_quality:outside_0_1", "prefix_len:below_1"], []]
    assert clean.request_errors(df, ["amount", "cum_cost"]).first()["errors"] == ["cum_cost:missing", "amount:negative"]
    counted = df.selectExpr("*", "IF(isnan(amount), -1, NULL) AS count_calls")
    assert [r["errors"][:1] for r in clean.request_errors(counted, ()).collect()] == [["amount:negative"], ["count_calls:negative"], []]


def test_rules_first_match_and_sql(spark):
    r = rule_list([("x > 10", "remind", 0.8), ("x > 5", "wait", 0.6)], BOTH)
    df = spark.createDataFrame([(20.0,), (7.0,), (1.0,)], "x double")
    got = df.select(r.decision().alias("d")).select("d.*").collect()
    assert [tuple(g) for g in got] == [(1, 0.8), (0, 0.6), (0, 0.0)]
    df.createOrReplaceTempView("case_features")
    assert [x[0] for x in spark.sql(r.sql()).collect()] == ["remind", "wait", "wait"]


# ---- monitoring ----------------------------------------------------------------------------------


def test_drift_needs_a_full_lookback(spark):
    days = [(f"2024-01-{d:02d}", 0.05 if d < 9 else 0.9, 0.95, 0.01) for d in range(1, 11)]
    daily = spark.createDataFrame(days, "date string, ood_rate double, coverage double, override_rate double").withColumn("date", F.to_date("date"))
    s = monitor.drift_signals(daily)
    assert s.count() == 4
    hit = rows(s.where("drift_detected").select(F.date_format("date", "dd")))
    assert hit == [("09",), ("10",)]
    assert monitor.drift_signals(daily.limit(6)).count() == 0
    assert monitor.drift_persistence(s, 2).first()["persistent"]


def test_psi_of_equal_and_disjoint_samples(spark):
    a = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert monitor.psi(a, a, ["x"]).first()["psi"] == pytest.approx(0.0)
    assert monitor.psi(a.withColumn("x", F.col("x") + 1000), a, ["x"]).first()["level"] == "critical"
    flat = a.withColumn("x", F.lit(1.0))
    assert monitor.psi(flat, flat, ["x"]).first()["psi"] == pytest.approx(0.0)


def test_ks_of_disjoint_samples(spark):
    a = spark.range(50).select(F.col("id").cast("double").alias("x"))
    assert monitor.ks(a.withColumn("x", F.col("x") + 100), a, "x").first()["ks"] == pytest.approx(1.0)
    assert monitor.ks(a, a, "x").first()["ks"] == 0.0


def test_upsert_replaces_days(spark):
    old = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, n int")
    new = spark.createDataFrame([("2024-01-02", 9), ("2024-01-03", 3)], "date string, n int")
    assert rows(monitor.upsert_daily(old, new)) == [("2024-01-01", 1), ("2024-01-02", 9), ("2024-01-03", 3)]


def test_a_poisson_draw_hashes_once(spark):
    rows = spark.range(10).select(F.col("id").alias("case_id"), F.col("id").alias("t"))
    plan = values.replay_sample(rows, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
