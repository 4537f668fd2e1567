"""Scorers of the user, boxes of rules and certificates of fitted models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import boxes, distill, explain, scorers, splits

ACTIONS = ("wait", "call")


def linear(width=2):
    weights = np.array([[1.0, -2.0], [0.5, 0.25], [3.0, 1.0]])[:, :width]
    return lambda: lambda states: states @ weights


def test_scorer_in_batches(spark):
    df = spark.createDataFrame([(i, float(i), -float(i) if i % 3 else None, 1.0) for i in range(50)], "i long, a double, b double, c double").repartition(3)
    got = {r.i: r.q for r in scorers.with_values(df, ["a", "b", "c"], linear(), 2, batch=7).collect()}
    for i in range(50):
        assert got[i] == pytest.approx((np.array([i, -i if i % 3 else 0.0, 1.0]) @ np.array([[1.0, -2.0], [0.5, 0.25], [3.0, 1.0]])).tolist())
    states = spark.createDataFrame([(None,), ([1.0, 2.0, 3.0],)], "s array<double>")
    assert sorted(map(str, (r.q for r in states.select(scorers.scorer(linear(), 2)("s").alias("q")).collect()))) == ["None", "[11.0, 1.5]"]
    assert scorers.with_values(df.limit(0), ["a"], linear(), 2).count() == 0


@pytest.mark.parametrize("model, message", [(linear(1), "shape"), (lambda: lambda s: s[:, :2] * math.inf, "finite"), (lambda: lambda s: s[:1, :2], "shape")])
def test_scorer_of_wrong_width_fails(spark, model, message):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "a double, b double, c double").coalesce(1)
    with pytest.raises(Exception, match=message):
        scorers.with_values(df, ["a", "b", "c"], model, 2).collect()


def test_interval_algebra():
    a, b = boxes.box([("x", "<=", 3.0), ("x", ">", 1.0), ("x", "<=", 5.0)], "wait"), boxes.box([("x", ">", 3.0)], "call")
    assert a.intervals == {"x": (1.0, 3.0)} and boxes.intersection(a.intervals, b.intervals) is None
    c = boxes.box([("y", "<=", 0.0)], "wait")
    assert boxes.overlaps([a, b, c]) == 2
    assert boxes.uncovered([a, b]) == [{"x": (-math.inf, 1.0)}]
    draw = random.Random(1)
    point = lambda: {f: draw.uniform(-1, 1) for f in "xyz"}
    inside = lambda p, s: all(lo < p[f] <= hi for f, (lo, hi) in s.items())
    for _ in range(50):
        some = [boxes.box([(draw.choice("xyz"), draw.choice(("<=", ">")), draw.uniform(-1, 1)) for _ in range(3)], "wait") for _ in range(4)]
        some = [s for s in some if all(lo < hi for lo, hi in s.intervals.values())]
        rest = boxes.uncovered(some)
        for p in (point() for _ in range(40)):
            assert sum(inside(p, r) for r in rest) == int(not any(inside(p, s.intervals) for s in some))


def test_exports_are_read_back(spark):
    df = spark.createDataFrame([(float(i % 17), float(i % 5), int((i % 17 > 8) != (i % 5 > 2))) for i in range(600)], "long_name double, b double, label int")
    _, rules = distill.fit_tree(df, ["long_name", "b"], ACTIONS, "label", 3, 10)
    by_text, by_sql = boxes.boxes_of_text(rules.text, ACTIONS), boxes.boxes_of_sql(rules.sql())
    assert by_text == by_sql and len(by_text) == rules.leaves > 2
    assert boxes.uncovered(by_text) == [] and boxes.overlaps(by_text) == 0
    out = boxes.decided_by_boxes(distill.apply_rules(df, rules), by_text)
    assert out.where("n_boxes != 1 OR box_action != recommended_action").count() == 0
    assert boxes.boxes_table(by_text, spark).select("box").distinct().count() == len(by_text)
    ok = distill.leaf_certificate(df, rules, "label", 10).first()
    assert tuple(ok) == (600, 0, 0, 0)
    wrong = distill.leaf_certificate(df.withColumn("label", 1 - F.col("label")), rules, "label", 10_000).first()
    assert wrong.small_leaves == rules.leaves and wrong.wrong_majority > 0


def test_certificates_notice_what_is_wrong(spark):
    points = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 10.0), (1, 11.0)], "cluster_id int, x double")
    assert tuple(explain.kmeans_certificate(points, ["x"]).first()) == (4, 2, 0)
    moved = points.union(spark.createDataFrame([(0, 9.0)], points.schema))
    assert explain.kmeans_certificate(moved, ["x"]).first().n_misplaced == 1


def test_split_totals_add_up(spark):
    tr = spark.createDataFrame([(i % 7, "abc"[i % 3] if i % 5 else None, float(i % 4), int(i % 2)) for i in range(90)], "case_id long, last_activity string, r double, done int")
    parts = spark.createDataFrame([(i, "train" if i < 5 else "test") for i in range(7)], "case_id long, split string")
    got = {(r.split, r.last_activity, r.level): r for r in splits.split_totals(tr, parts).collect()}
    both = tr.join(parts, "case_id")
    for split in ("train", "test", None):
        one = both.where(F.col("split") == split) if split else both
        n, mean, dev = one.agg(F.count("*"), F.avg("r"), F.stddev_pop("r")).first()
        row = got[split, None, 1 if split else 3]
        assert (row.n_transitions, row.reward_mean, row.reward_std) == (n, pytest.approx(mean), pytest.approx(dev))
    assert got[None, None, 3].cases_about == 7 and got["train", None, 0].n_transitions > 0
    assert len(got) == 2 * 4 + 2 + 1
