"""Stateful streams against the batch operators."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd

from tests.conftest import rows
from tracelake.operators import cases, sessions
from tracelake.plans.sequence import segment_cases
from tracelake.streaming import cases as cstream
from tracelake.streaming import metrics
from tracelake.streaming import sessions as ssessions

EVENT = "case_id long, activity string, timestamp timestamp, event_id long, value double, token_id int"
START = datetime(2024, 3, 1)


def event(case, minute, activity, event_id, value=None):
    return case, activity, START + timedelta(minutes=minute), event_id, value, 2 + len(activity or "")


def run_parts(spark, tmp_path, parts, spec):
    """One run per part, each from the checkpoint of the one before; the rows and how many came too late."""
    late = 0
    for part in parts:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        query = cstream.start_cases(stream, spec, str(tmp_path / "out"), str(tmp_path / "ck"), partitions=2)
        query.awaitTermination()
        late += metrics.late_rows(query)
    return spark.read.parquet(str(tmp_path / "out")).collect(), late


def test_case_state_over_batches_with_late_rows(spark, tmp_path):
    first = [event(1, 0, "view", 1, 2.0), event(1, 30, "click", 2), event(2, 10, "view", 3), event(1, 30, "buy", 4), event(1, 30, "buy", None), event(1, 30, None, 9)]
    second = [event(1, 20, "click", 5, 1.5), event(2, 50, "view", 6), event(3, 45, "click", 7)]  # 20 is late, but within the delay
    third = [event(2, 200, "buy", 8), event(2, 100, "view", 10)]
    tardy = [event(1, 1, "view", 11), event(4, 5000, "view", 12)]  # behind the watermark: dropped
    close = [event(None, 20_000, "beat", None)]
    spec = cstream.CaseStream(("value",), ("view", "click"), 3, "60 minutes", 10_000 * 60)
    got, late = run_parts(spark, tmp_path, [first, second, third, tardy, close], spec)
    assert late == 1
    log = spark.createDataFrame(first + second + third + tardy[1:], EVENT)
    want = {(r.case_id, r.t): r for r in cases.case_features(log, ["value"], ["view", "click"]).collect()}
    assert {(r.case_id, r.t) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r.case_id, r.t]
        assert (r.value, r.prefix_len, r.elapsed_time, r.count_view, r.count_click) == (w.value, w.prefix_len, w.elapsed_time, w.count_view, w.count_click)
    assert [r.activity for r in sorted(got, key=lambda r: r.t) if r.case_id == 1] == ["view", "click", None, "buy", "buy", "click"]
    assert {r.t: r.tokens for r in got if r.case_id == 1}[6] == [5, 5, 7]
    assert max(len(r.tokens) for r in got) == 3


class Kept:
    """A list or value state and how often it was asked or told."""

    def __init__(self):
        self.values, self.calls = [], 0

    def _call(self, values=None):
        self.calls += 1
        if values is not None:
            self.values = values

    def appendValue(self, value):  # noqa: N802
        self._call([*self.values, value])

    def exists(self):
        self._call()
        return bool(self.values)

    def put(self, values):
        self._call(values)

    def clear(self):
        self._call([])


class KeptList(Kept):
    def get(self):
        self._call()
        return iter(self.values)


class KeptValue(Kept):
    def get(self):
        self._call()
        return self.values[0]

    def update(self, value):
        self._call([value])


def test_a_shard_costs_the_same_state_calls_whatever_its_cases():
    """Each call is a round trip to Spark's state server; per case they took most of the time."""

    def calls(n):
        kept, timers = {"waiting": KeptList(), "progress": KeptValue()}, []
        handle = SimpleNamespace(getListState=lambda name, _: kept[name], getValueState=lambda name, _: kept[name], registerTimer=timers.append)
        processor = cstream.CaseProcessor(cstream.CaseStream((), ("view",), 5, "1 minute", 60))
        rows_, seen = [(str(c), 1_000_000 * s, "view", None, 7, []) for c in range(n) for s in (2, 1)], []
        for watermark in (1_500, 5_000, 100_000):
            processor.init(handle)
            if watermark == 1_500:
                assert list(processor.handleInputRows((0,), iter([pd.DataFrame(rows_, columns=["case", "micros", "activity", "event_id", "token_id", "numbers"])]), None)) == []
            for _ in range(2):  # a second timer of the batch has nothing to do
                found = list(processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), None))
                seen += [(r.case, r.t, r.micros) for f in found for r in f.itertuples()]
        assert sorted(seen) == sorted((str(c), s, 1_000_000 * s) for c in range(n) for s in (1, 2))
        assert [k.values for k in kept.values()] == [[], []] and timers == [1001, 2001, 62_001]
        return sum(k.calls for k in kept.values())

    assert calls(300) == calls(1)


def test_idle_cases_are_evicted(spark, tmp_path):
    spec = cstream.CaseStream((), ("view",), 5, "10 minutes", 60 * 60)
    parts = [[event(1, 0, "view", 1), event(1, 5, "view", 2)], [event(2, 300, "view", 3)], [event(2, 310, "view", 4)], [event(1, 600, "view", 5)], [event(None, 2000, "beat", None)]]
    got, _ = run_parts(spark, tmp_path, parts, spec)
    # the case came back after its state was gone, so its prefix starts anew
    assert sorted((r.case_id, r.t, r.count_view) for r in got) == [(1, 1, 1.0), (1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 2.0)]


def test_sessions_of_batch_and_stream(spark, tmp_path):
    """Late events bridge two sessions; a gap as long as the limit does not part them."""
    parts = [[event(1, 0, "view", 1, 1.0), event(1, 100, "view", 2, 5.0), event(2, 0, "click", 3)], [event(1, 50, "click", 4), event(2, 60, "view", 5), event(2, 121, "view", 6, 2.0)],
             [event(3, 300, "view", 7)], [event(None, 9000, "beat", None)]]
    late = 0
    for part in parts:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        query = ssessions.start_sessions(stream, "60 minutes", str(tmp_path / "out"), str(tmp_path / "ck"), "2 hours", ["view"], ["value"], partitions=2)
        query.awaitTermination()
        late += metrics.late_rows(query)
    log = spark.createDataFrame([e for p in parts[:3] for e in p], EVENT)
    batch = sessions.session_summary(log, "60 minutes", ["view"], ["value"])
    want = [(1, 3, 6000.0, 2, 5.0), (2, 1, 0.0, 1, 2.0), (2, 2, 3600.0, 1, None), (3, 1, 0.0, 1, None)]
    for got in (batch, spark.read.parquet(str(tmp_path / "out"))):
        assert rows(got, "case_id", "n_events", "duration", "count_view", "max_value") == want
    assert late == 0
    cases_of = sessions.session_cases(log, 3600)
    assert rows(cases_of.groupBy("case_id", "session").count(), "case_id", "count") == [(1, 3), (2, 1), (2, 2), (3, 1)]
    cut = sessions.session_cases(segment_cases(log, max_rows=1), 3600, max_rows=1)
    assert rows(cut, "event_id", "session") == rows(cases_of, "event_id", "session")
