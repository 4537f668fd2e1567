"""Every registered query against its DuckDB statement, and the shape of key plans."""

import pytest

from tests.compare import compare, connect
from tracelake.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    ok, message = compare(spark, con, sf, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(QUERIES["pruned_scan"](spark, sf))
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value), EqualTo(event_type,purchase), GreaterThan(value,50.0)]" in p
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in p


def test_duplicates_are_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["clean_dedupe"](spark, sf))


@pytest.mark.parametrize("name, most", [("split_random", 0), ("ope_bootstrap", 0), ("ope_policies", 2), ("surrogate_fidelity", 2), ("guard_decisions", 1)])
def test_scans_of_the_log(spark, sf, name, most):
    """Upstream work is stored once; what is left in the plan reads the log this often."""
    assert plan(QUERIES[name](spark, sf)).count("events.parquet") <= most


@pytest.mark.parametrize("name", ["transitions", "split_profile", "greedy_policy", "ope_policies", "case_features", "prefixes_left", "daily_metrics", "guard_decisions"])
def test_no_cartesian_and_no_python_in_the_plan(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert word not in p
