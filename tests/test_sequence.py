"""Segmented and plain ordering must agree, whatever the skew."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracelake.plans.sequence import SEGMENT, WHOLE, ordered, segment_cases
from tracelake.sources import views


def enriched(log):
    return ordered(
        log,
        lead={"nxt": F.col("activity"), "nxt_ts": F.col("timestamp")},
        lag={"prv": F.col("activity")},
        running={"clicks": F.when(F.col("activity") == "click", 1).otherwise(0), "errs": F.when(F.col("activity") == "error", 1)},
        history={"hist": (F.col("activity"), 7), "one": (F.col("activity"), 1)},
        totals={"top": ("max", F.col("value")), "first": ("min", F.col("timestamp")), "n_view": ("sum", (F.col("activity") == "view").cast("int"))},
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """One user holds a third of all events; many share a second."""
    log = views.log_user(spark, "/root/testdata/sf0.01", segment=False)
    third = F.col("event_id") % 3 == 0
    return log.withColumn("case_id", F.when(third, F.lit(-1)).otherwise(F.col("case_id"))).withColumn(
        "timestamp", F.when(third, F.date_trunc("hour", "timestamp")).otherwise(F.col("timestamp")))


COLS = ["case_id", "event_id", "t", "n_events", "nxt", "nxt_ts", "prv", "clicks", "errs", "hist", "one", "top", "first", "n_view"]


@pytest.mark.parametrize("max_rows", [7, 40, 500])
def test_segments_do_not_change_results(skewed, max_rows):
    plain = rows(enriched(skewed), *COLS)
    cut = segment_cases(skewed, max_rows=max_rows)
    assert SEGMENT in cut.columns
    assert rows(enriched(cut), *COLS) == plain


def test_hot_case_is_spread(skewed):
    cut = segment_cases(skewed, max_rows=200)
    sizes = cut.groupBy("case_id", SEGMENT).count()
    biggest = sizes.agg(F.max("count")).first()[0]
    total = skewed.where("case_id = -1").count()
    assert total > 3000 and biggest < 500
    # cases below the limit stay whole
    assert sizes.where("case_id <> -1").agg(F.max(SEGMENT)).first()[0] == WHOLE


def test_every_big_case_is_cut(skewed):
    cut = segment_cases(skewed, max_rows=10)
    assert cut.where(f"{SEGMENT} > 0").select("case_id").distinct().count() > 1
    assert rows(enriched(cut), *COLS) == rows(enriched(skewed), *COLS)


def test_events_of_one_time_are_spread(skewed):
    """Cuts run through the events of one timestamp, with ties in the activity as well, and results do not change."""
    same = skewed.withColumn("timestamp", F.when(F.col("case_id") == -1, F.lit("2024-01-01").cast("timestamp")).otherwise(F.col("timestamp")))
    same = same.withColumn("activity", F.when(F.col("event_id") % 4 == 0, F.lit("view")).when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise(F.col("activity")))
    cut = segment_cases(same, max_rows=200)
    assert cut.where("case_id = -1").groupBy(SEGMENT).count().agg(F.max("count")).first()[0] < 500
    assert rows(enriched(cut), *COLS) == rows(enriched(same), *COLS)


def test_small_log_is_returned_unchanged(skewed):
    assert SEGMENT not in segment_cases(skewed).columns


def test_segmenting_by_turn(spark, sf):
    chat = views.log_chat(spark, sf, segment=False)
    cut = segment_cases(chat, time="turn", max_rows=3)
    get = lambda d: rows(ordered(d, ("turn",), lead={"nxt": F.col("activity")}), "case_id", "turn", "t", "n_events", "nxt")
    assert SEGMENT in cut.columns and get(cut) == get(chat)


def test_plan_has_one_exchange_per_chain(spark, sf):
    log = views.log_session(spark, sf, segment=False)
    plan = enriched(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan
    assert plan.count("Sort [") == 1
