"""Ranks, quotas and percentiles against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracelake.plans import ranking
from tracelake.plans.ranking import average_ranks, global_rank, hash_rank, percentiles, running_totals, spearman
from tracelake.plans.sizing import dimension


@pytest.fixture(scope="module")
def numbers(spark):
    df = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 4).cast("string"))).alias("g"),
        F.when(F.col("id") % 3 == 1, F.lit(7.5)).otherwise(F.pmod(F.col("id") * 7919, F.lit(1013)) / 3.0).alias("x"))
    return df


def test_hash_rank_is_a_permutation(numbers):
    def ranks(seed):
        return {r["id"]: r["rank"] for r in hash_rank(numbers, seed, ["id"]).collect()}

    assert sorted(ranks(1).values()) == list(range(1, 5001))
    assert ranks(1) == ranks(1) != ranks(2)


def test_hash_rank_per_group_counts_null_group(numbers):
    ranked = hash_rank(numbers, 1, ["id"], ["g"], size="n")
    for r in ranked.groupBy("g").agg(F.count("*").alias("c"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("d"), F.max("n").alias("n")).collect():
        assert (r["lo"], r["hi"], r["d"], r["n"]) == (1, r["c"], r["c"], r["c"])
    assert ranked.where("g IS NULL").count() == numbers.where("g IS NULL").count() > 0


def test_hash_rank_needs_no_second_shuffle_of_the_rows(numbers):
    plan = hash_rank(numbers.hint("shuffle_hash"), 1, ["id"], ["g"])
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert "<=>" not in text


def test_global_rank(numbers):
    got = {r["id"]: r["rank"] for r in global_rank(numbers.select("id", "x"), ["x", "id"]).collect()}
    want = sorted((r["x"], r["id"]) for r in numbers.collect())
    assert got == {i: n + 1 for n, (_, i) in enumerate(want)}


def test_running_totals(numbers):
    got = {r["id"]: (r["a"], r["b"]) for r in running_totals(numbers.select("id"), ["id"], {"a": F.col("id"), "b": F.lit(2)}).collect()}
    assert got[0] == (0, 2) and got[4999] == (4999 * 5000 // 2, 10000) and got[100] == (5050, 202)


@pytest.mark.parametrize("setting", [{}, {"accuracy": 50}, {"accuracy": 200}])
def test_percentiles_match_numpy(numbers, setting):
    probs = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    xs = np.array([r["x"] for r in numbers.collect()])
    one = percentiles(numbers, "x", probs, **setting).first()
    for n, p in probs.items():
        assert one[n] == pytest.approx(np.percentile(xs, 100 * p)), n
    for r in percentiles(numbers, "x", probs, ["g"], **setting).collect():
        mine = np.array([v["x"] for v in numbers.where(F.col("g").eqNullSafe(F.lit(r["g"]))).collect()])
        for n, p in probs.items():
            assert r[n] == pytest.approx(np.percentile(mine, 100 * p)), (r["g"], n)


def test_percentiles_on_small_groups(spark):
    for n in range(1, 12):
        df = spark.range(n).select(F.col("id").cast("double").alias("x"))
        one = percentiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
        assert [one[c] for c in "abc"] == pytest.approx(list(np.percentile(np.arange(n), [10, 50, 90])))


def _mean_ranks(x):
    order = np.sort(x)
    return np.array([(np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in x])


def test_average_ranks_and_spearman(numbers):
    data = numbers.select("x", (F.col("id") % 17).cast("double").alias("y"))
    xy = np.array([(r["x"], r["y"]) for r in data.collect()])
    got = {r["x"]: r["rk"] for r in average_ranks(data, "x", "rk").collect()}
    want = _mean_ranks(xy[:, 0])
    assert all(got[v] == pytest.approx(w) for v, w in zip(xy[:, 0], want))
    rho = np.corrcoef(want, _mean_ranks(xy[:, 1]))[0, 1]
    assert spearman(data, "x", "y").first()["spearman"] == pytest.approx(rho)
    assert spearman(data.withColumn("y", F.lit(1.0)), "x", "y").first()["spearman"] is None


def test_dimension_broadcasts_only_when_small(numbers):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(dimension(numbers.limit(10)))
    big = dimension(numbers, max_rows=100)
    assert not hinted(big) and rows(big) == rows(numbers)


def test_spearman_of_large_values(spark):
    rows_ = [(1e9 + i, 1e9 - i + (i % 3)) for i in range(200)]
    data = spark.createDataFrame(rows_, "x double, y double")
    frame = data.toPandas()
    assert spearman(data, "x", "y").first()["spearman"] == pytest.approx(frame["x"].corr(frame["y"].rank(), method="pearson"), abs=1e-6)


def test_deviation_of_large_rewards(spark):
    from tracelake.operators.transitions import transition_stats

    tr = spark.createDataFrame([(i // 2, 1e9 + i % 2, 1) for i in range(100)], "case_id long, r double, done int")
    got = transition_stats(tr).first()
    assert got["reward_std"] == pytest.approx(0.5) and got["n_cases"] == 50 and got["n_transitions"] == 100


@pytest.mark.parametrize("cell", [1_000_000, 40])
def test_kendall_with_ties_and_hot_values(spark, cell):
    draw = random.Random(5)
    data = [(float(draw.randrange(60)), float(draw.randrange(40))) for _ in range(500)] + [(7.0, float(i)) for i in range(120)] + [(float(i), 3.0) for i in range(120)] + [(2.0, 2.0)] * 150
    sgn = lambda d: (d > 0) - (d < 0)
    s = sum(sgn(a - c) * sgn(b - d) for a, b in data for c, d in data)
    nx, ny = (sum(p[i] != q[i] for p in data for q in data) for i in (0, 1))
    table = spark.createDataFrame(data + [(None, 1.0), (1.0, None)], "x double, y double")
    got = ranking.kendall(table, "x", "y", cell=cell).first()
    assert got.n == len(data) and got.kendall == pytest.approx(s / math.sqrt(nx * ny))
    assert ranking.kendall(table.where("x = 7"), "x", "y").first().kendall is None
    assert tuple(ranking.kendall(table.limit(0), "x", "y").first()) == (None, 0)


def test_inversions_of_weights_beyond_a_long():
    values, weights = np.array([3.0, 1.0, 2.0, 1.0]), np.array([1 << 40, 1 << 40, 5, 7])
    assert ranking.inversions(values, weights) == (1 << 40) * ((1 << 40) + 5 + 7) + 5 * 7
