"""Composed flows on the tiny log and on skewed data."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_sequence import enriched
from tracelake.catalog.base import SPEC as SESSION_SPEC
from tracelake.catalog.base import outcome_value
from tracelake.operators.transitions import DecisionSpec
from tracelake.plans import flows
from tracelake.sources import views, writers

SPEC = DecisionSpec(
    actions=("wait", "remind"), trigger="remind", noop="wait", default_valid=("wait",), by_last_activity={"lend": ("wait", "remind"), "renew": ("wait", "remind")})


@pytest.fixture(scope="module")
def raw(tiny_log):
    source = tiny_log.withColumnsRenamed({"case_id": "case_nr", "activity": "task"}).withColumn("case_nr", F.concat(F.lit("c"), "case_nr")).withColumn("state", F.lit("Complete"))
    noise = source.limit(2).withColumns({"state": F.lit("start"), "task": F.lit("phone"), "event_id": F.col("event_id") + 50})
    return source.unionByName(noise).unionByName(source.limit(3).withColumn("event_id", F.col("event_id") + 900))


def prepared(raw):
    return flows.prepare_log(
        raw, {"case_id": "case_nr", "activity": "task", "lifecycle": "state"}, keep_lifecycle=["complete"], positive=["lost", "phone"],
        columns=["case_id", "activity", "timestamp"])


def test_prepare_log(raw):
    log = prepared(raw)
    assert log.count() == 12
    # phone is filtered out before the outcome is computed
    assert rows(log.select("case_id", "outcome").distinct()) == [(0, 0.0), (1, 0.0), (2, 1.0)]


@pytest.mark.parametrize("method", ["random_case", "temporal_case"])
def test_decision_dataset_and_report(raw, method):
    data = flows.decision_dataset(prepared(raw), SPEC, ("max", F.col("outcome")), max_len=5, method=method)
    assert data.transitions.count() == 9 and data.splits.count() == 3
    report = {(r["section"], r["name"]): r["value"] for r in flows.validation_report(data, 2, 5).collect()}
    assert all(v == 0 for (s, _), v in report.items() if s in ("structure", "continuity", "splits"))
    assert report[("reward", "n_terminal")] == 3
    with pytest.raises(ValueError, match="split method"):
        flows.decision_dataset(prepared(raw), SPEC, ("max", F.col("outcome")), method="other")


def test_dataset_of_a_skewed_log_equals_the_unsegmented_one(spark, sf):
    log = views.log_user(spark, sf, segment=False).withColumn("case_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("case_id")))

    def build(limit):
        d = flows.decision_dataset(log, SESSION_SPEC, outcome_value(), max_len=6, max_rows=limit)
        return rows(d.transitions, "case_id", "t", "s", "s_mask", "s_next", "a", "r", "done", "n_trigger", "ts_next")

    assert build(11) == build(1_000_000)


def test_bucketed_log_needs_no_shuffle(spark, sf, tmp_path):
    log = views.log_user(spark, sf, segment=False)
    writers.write_bucketed_log(log, "bucketed_log", str(tmp_path / "b"), 4)
    try:
        again = enriched(spark.table("bucketed_log"))
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
        assert rows(again, "event_id", "t", "nxt") == rows(enriched(log), "event_id", "t", "nxt")
    finally:
        spark.sql("DROP TABLE bucketed_log")


def test_log_on_disk_is_in_case_order(spark, sf, tmp_path):
    log = views.log_session(spark, sf, segment=False)
    writers.write_log(log, str(tmp_path / "log"), ("timestamp", "activity", "event_id"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert rows(back, "event_id", "case_id") == rows(log, "event_id", "case_id")
