"""Queries on stateful streams: case state and session cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrays import render
from ..operators import encode, sessions
from ..plans.sequence import segment_cases
from ..session import scratch_dir
from ..sources import views
from ..streaming import cases as cstream
from ..streaming import sessions as ssessions
from .base import cte, query, r6, sql6


def arriving(log):
    """Events in three parts of ten days, a seventh of them 20 hours late, then a heartbeat that closes the log."""
    came = F.col("timestamp") + F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 20 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    parts = log.withColumn("part", F.least(F.floor((F.dayofmonth(came) - 1) / 10), F.lit(2)).cast("int"))
    end = log.agg(F.lit(None).cast(log.schema["case_id"].dataType).alias("case_id"), F.lit(None).cast("string").alias("activity"), (F.max("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("timestamp"),
                  F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"))
    return [*[parts.where(F.col("part") == i).drop("part") for i in range(3)], end]


@query("stream_case_features", f"""SELECT case_id, t, {sql6('value', 'prefix_len', 'elapsed_time', 'count_view', 'count_click')},
    array_to_string(list_concat(list_resize([]::INTEGER[], 10 - len(toks), 0), toks), ',') AS x FROM (SELECT f.*, list(CAST(v.id AS INTEGER)) OVER (PARTITION BY f.case_id ORDER BY f.t ROWS 9 PRECEDING) AS toks
    FROM feat_session f JOIN seq_session s ON s.case_id = f.case_id AND s.t = f.t JOIN vocab v ON v.token = s.activity)""", ("feat_session", "seq_session", "vocab"))
def stream_case_features(spark, sf):
    """Features and prefixes of a stream of single events, late ones included, equal those of the batch."""
    path, out, ck = (scratch_dir(spark, n) for n in ("case-log", "case-out", "case-ck"))
    vocab = encode.build_vocab(views.log_session(spark, sf, segment=False))
    spec = cstream.CaseStream(("value",), ("view", "click"), 10, "1 day", 86_400)
    for part in arriving(views.log_session(spark, sf, segment=False)):
        part.write.mode("append").parquet(path)
        # every run goes on from the checkpoint of the one before
        stream = spark.readStream.schema(part.schema).parquet(path)
        cstream.start_cases(encode.encode_tokens(stream, vocab), spec, out, ck, partitions=8).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("case_id", "t", *r6("value", "prefix_len", "elapsed_time", "count_view", "count_click"), render(A.pad(F.col("tokens"), 10, "left", encode.PAD)).alias("x"))


GAP = 7 * 3600
cte("islands", f"""SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(timestamp) - epoch_us(before) > {GAP * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY timestamp, activity, event_id ROWS UNBOUNDED PRECEDING) AS session
    FROM (SELECT *, lag(timestamp) OVER (PARTITION BY case_id ORDER BY timestamp, activity, event_id) AS before FROM log_user)""", "log_user")
SESSIONS = """SELECT case_id, CAST(epoch_us(min(timestamp)) AS BIGINT) AS start_us, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 6) AS duration, count(*) AS n_events,
    count(*) FILTER (activity = 'view') AS count_view, round(max(value), 6) AS max_value FROM islands GROUP BY case_id, session"""


def _shown(summary):
    return summary.select("case_id", F.unix_micros("start_ts").alias("start_us"), *r6("duration"), "n_events", "count_view", *r6("max_value"))


@query("session_cases", "SELECT case_id, event_id, CAST(session AS BIGINT) AS session FROM islands", ("islands",))
def session_cases(spark, sf):
    return sessions.session_cases(views.log_user(spark, sf), GAP).select("case_id", "event_id", "session")


@query("session_cases_cut", "SELECT case_id, event_id, CAST(session AS BIGINT) AS session FROM islands", ("islands",))
def session_cases_cut(spark, sf):
    """The same with every case of more than 20 events cut."""
    return sessions.session_cases(segment_cases(views.log_user(spark, sf, segment=False), max_rows=20), GAP, max_rows=20).select("case_id", "event_id", "session")


@query("session_summary", SESSIONS, ("islands",))
def session_summary(spark, sf):
    return _shown(sessions.session_summary(views.log_user(spark, sf, segment=False), f"{GAP} seconds", ["view"], ["value"]))


@query("stream_session_summary", SESSIONS, ("islands",))
def stream_session_summary(spark, sf):
    """Sessions whose events arrive in three batches, bridged by late ones, equal those of the batch."""
    path, out, ck = (scratch_dir(spark, n) for n in ("session-log", "session-out", "session-ck"))
    for part in arriving(views.log_user(spark, sf, segment=False)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(part.schema).parquet(path)
        ssessions.start_sessions(stream, f"{GAP} seconds", out, ck, "1 day", ["view"], ["value"], partitions=8).awaitTermination()
    return _shown(spark.read.parquet(out))
