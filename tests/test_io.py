"""Readers, writers and streams on small files."""

import gzip
import json

from pyspark.sql import functions as F

from tests.conftest import rows
from tracelake.sources import readers, writers
from tracelake.sources.generations import GenerationStore
from tracelake.streaming import feedback as fstream
from tracelake.streaming import metrics as mstream

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
  <extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
  <trace>
    <string key="concept:name" value="case-1"/>
    <event><string key="concept:name" value="A"/><string key="lifecycle:transition" value="complete"/><date key="time:timestamp" value="2024-01-01T10:00:00.000+01:00"/></event>
    <event><string key="concept:name" value="B"/><int key="amount" value="7"/><date key="time:timestamp" value="2024-01-01T11:00:00.000+01:00"/></event>
  </trace>
  <trace>
    <string key="concept:name" value="case-2"/><float key="budget" value="2.5"/>
    <event><string key="concept:name" value="A"/><date key="time:timestamp" value="2024-01-02T10:00:00.000+00:00"/></event>
  </trace>
</log>
"""


def test_xes_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.xes").write_text(XES)
    with gzip.open(tmp_path / "b.xes.gz", "wt") as f:
        f.write(XES)
    for name in ("a.xes", "b.xes.gz"):
        df = readers.read_xes(spark, str(tmp_path / name), ("concept:name", "time:timestamp", "lifecycle:transition", "amount"), ("concept:name", "budget"))
        got = rows(df, "`case:concept:name`", "`case:budget`", "`concept:name`", "`lifecycle:transition`", "amount")
        assert got == [("case-1", None, "A", "complete", None), ("case-1", None, "B", None, "7"), ("case-2", "2.5", "A", None, None)]


def test_a_long_trace_is_read_by_several_tasks(spark, tmp_path):
    events = "".join(f'<event>\n<string key="concept:name" value="a&amp;{i}"/><date key="time:timestamp" value="2024-01-01T00:00:00Z"/>\n</event>\n' for i in range(9000))
    traces = [("first", 3), ("none", 0), ("long", 9000), ("last", 2)]
    inside = "".join(f'<trace>\n<string key="concept:name" value="{n}"/>\n' + "".join(events.split("</event>\n")[i] + "</event>\n" for i in range(k)) + "</trace>\n" for n, k in traces)
    (tmp_path / "x.xes").write_text(f"<log>\n<global scope='event'><string key='concept:name' value='?'/></global>\n{inside}</log>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        df = readers.read_xes(spark, str(tmp_path / "x.xes"), ("concept:name",))
        got = rows(df, "`case:concept:name`", "`concept:name`")
        assert spark.read.text(str(tmp_path / "x.xes")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(((n, f"a&{i}") for n, k in traces for i in range(k)), key=str)


def test_decision_log_skips_blank_and_keeps_bad_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-01T10:00:00Z", "request_id": "r1", "case_id": "c", "t": 1, "action_id": 0, "source": "surrogate", "confidence": 0.9, "ood": False, "latency_ms": 1.5}
    late = dict(good, request_id="r2", timestamp="2024-02-01T00:00:00Z")
    (tmp_path / "log.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(late) + "\n{broken\n")
    df = readers.read_decisions(spark, str(tmp_path / "log.jsonl"))
    assert df.count() == 3 and rows(df.where("_corrupt_record IS NULL"), "request_id") == [("r1",), ("r2",)]
    assert rows(readers.read_decisions(spark, str(tmp_path / "log.jsonl"), since="2024-01-15"), "request_id") == [("r2",)]


def test_items_wrapped_or_bare(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.json").write_text(json.dumps({"items": [{"case_id": 1, "delta_q": 0.5}, {"case_id": 2, "delta_q": None}]}))
    (tmp_path / "w" / "b.json").write_text(json.dumps([{"case_id": 3, "delta_q": 1.5}]))
    assert rows(readers.read_items(spark, str(tmp_path / "w"), "case_id bigint, delta_q double")) == [(1, 0.5), (2, None), (3, 1.5)]


def test_requests_flatten(spark, tmp_path):
    body = {"request_id": "r", "case_id": "c", "t": 3, "features": {"amount": 10.0, "prefix_len": 3}, "override": {"action_id": 1, "action_name": "x"}}
    (tmp_path / "r.json").write_text(json.dumps(body))
    r = readers.read_requests(spark, str(tmp_path / "r.json")).first()
    assert r["amount"] == 10.0 and r["prefix_len"] == 3 and r["override"]["action_id"] == 1 and r["valid_actions"] is None


def test_fingerprint_ignores_row_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert rows(readers.fingerprint(a)) == rows(readers.fingerprint(a.orderBy(F.desc("id")).repartition(5)))
    assert rows(readers.fingerprint(a)) != rows(readers.fingerprint(a.withColumn("x", F.col("x") + 1)))


def test_daily_table_upsert(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, n int").withColumn("date", F.to_date("date"))
    writers.append_daily(spark, day, path)
    out = writers.append_daily(spark, day.where("n = 2").withColumn("n", F.lit(5)), path)
    assert rows(out.select("n")) == [(1,), (5,)]


def test_metrics_stream_updates_over_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "timestamp timestamp, source string, confidence double, ood boolean, latency_ms double"

    def add(rows_):
        df = spark.createDataFrame(rows_, "ts string, source string, confidence double, ood boolean, latency_ms double")
        df.select(F.to_timestamp("ts").alias("timestamp"), "source", "confidence", "ood", "latency_ms").coalesce(1).write.mode("append").json(src)

    late = []

    def run():
        stream = spark.readStream.schema(schema).json(src)
        query = mstream.start_daily(mstream.daily_stream(stream), out, ck)
        query.awaitTermination()
        late.append(mstream.late_rows(query))
        return rows(mstream.read_daily(spark, out).select(F.date_format("date", "dd"), "total_requests", F.round("coverage", 3)))

    add([("2024-01-01 10:00:00", "surrogate", 0.9, False, 1.0)])
    assert run() == [("01", 1, 1.0)]
    add([("2024-01-01 12:00:00", "baseline", 0.9, True, 3.0), ("2024-01-05 00:00:00", "surrogate", 0.5, False, 1.0)])
    assert run() == [("01", 2, 0.5), ("05", 1, 1.0)]
    # day 1 closed with the watermark: a late event no longer changes it
    add([("2024-01-01 23:00:00", "override", 0.9, False, 1.0), ("2024-01-05 01:00:00", "surrogate", 0.5, False, 1.0)])
    assert run() == [("01", 2, 0.5), ("05", 2, 1.0)]
    assert late == [0, 0, 1]


def test_feedback_stream_extends_cases(spark, tmp_path):
    src, store, out, ck = (str(tmp_path / n) for n in ("src", "store", "out", "ck"))
    schema = "case_id string, t int, state_features map<string,double>, action_executed int, reward double, done boolean, timestamp timestamp"

    def add(ts):
        df = spark.createDataFrame([("c", t, {"x": float(t)}, t % 2, 1.0, False, None) for t in ts], schema)
        df.coalesce(1).write.mode("append").json(src)

    def run():
        stream = spark.readStream.schema(schema).json(src)
        fstream.start_consolidation(stream, GenerationStore(store), out, ck, ["x"]).awaitTermination()
        return rows(fstream.read_transitions(spark, out), "t", "s", "s_next", "a")

    add([1, 2])
    assert run() == [(1, [1.0], [2.0], 1)]
    add([3])
    assert run() == [(1, [1.0], [2.0], 1), (2, [2.0], [3.0], 0)]
    assert fstream.consolidate(fstream.stored_feedback(spark, GenerationStore(store), schema), ["x"]).count() == 2


def test_generations_bound_what_a_batch_lists(spark, tmp_path):
    store = GenerationStore(str(tmp_path / "store"), buckets=3, fan=3)
    schema, sent, most = "case_id string, t int", [], 0
    for version in range(14):
        batch = [(str(c), version) for c in range(version % 5, 12)]
        sent += batch
        keys = store.append(spark.createDataFrame(batch, schema), version, F.xxhash64("t"))
        assert rows(keys, "case_id") == sorted((c,) for c, _ in batch)
        live = store.live(spark, version)
        # fewer than ``fan`` folders per bucket and level: 14 versions of 3 buckets would be 42
        assert all(sum(f.bucket == b and f.level == k for f in live) < 3 for b in range(3) for k in range(4))
        most = max(most, len(live))
    assert most <= 3 * 2 * 3
    assert store.latest(spark) == 13
    assert rows(store.read(spark, schema, 13)) == sorted(sent, key=str)
    touched = store.read(spark, schema, 13, [1])
    assert rows(touched) == sorted((r for r in sent if r[0] in {x[0] for x in rows(touched)}), key=str)
    # folders on disk belong to the last three versions, merged ones included
    named = {f.name for v in (12, 13) for f, _ in store._manifest(spark, v)}
    assert {f"data/{p.parent.name}/{p.name}" for p in (tmp_path / "store/data").glob("*/bucket=*")} <= named
    # a replay of the last version replaces it
    store.append(spark.createDataFrame([("x", 1)], schema), 13)
    assert ("x", 1) in rows(store.read(spark, schema, 13)) and store.read(spark, schema, 13).where("t = 13").count() == 0
