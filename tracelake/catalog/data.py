"""Queries on cleaning, case derivation, encoding, transitions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import render
from ..operators import cases, clean, encode, splits, transitions
from ..plans import flows
from ..plans.sequence import segment_cases
from ..sources import views
from .base import (MAX_LEN, POSITIVE, SEED, SPEC, cte, outcome_value, query, r6, session_splits, session_transitions, sql6)

# ---- scans -------------------------------------------------------------------------------------


@query("pruned_scan", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' AND value > 50.0 GROUP BY 1")
def pruned_scan(spark, sf):
    return (views.table(spark, sf, "events").where("event_type = 'purchase' AND value > 50.0")
            .select("user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))


# ---- cleaning ----------------------------------------------------------------------------------


@query("rename_parse", """SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts_epoch, user_id AS case_id, event_type AS activity,
    CAST(floor(epoch(ts)) AS BIGINT) - 3600 AS utc_epoch FROM events""")
def rename_parse(spark, sf):
    raw = views.events(spark, sf).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("when"), "ts")
    named = clean.rename_columns(raw, {"case_id": "user_id", "activity": "event_type", "timestamp": "when", "resource": "absent"})
    utc = clean.parse_timestamps(named, tz_in="+01:00")
    return utc.select(F.unix_timestamp("ts").alias("ts_epoch"), "case_id", "activity", F.unix_timestamp("timestamp").alias("utc_epoch"))


@query("parse_offsets", """SELECT event_id, CAST(floor(epoch(CASE event_id % 5 WHEN 0 THEN timezone('Europe/Madrid', s) - to_hours(CAST(s >= TIMESTAMP '2024-10-27 02:00:00' AND s < TIMESTAMP '2024-10-27 03:00:00' AS INTEGER)) WHEN 4 THEN NULL ELSE timezone('UTC', s) END)) AS BIGINT) AS utc_epoch
    FROM (SELECT event_id, ts + to_days(CAST(event_id % 365 AS INTEGER)) AS s FROM events)""")
def parse_offsets(spark, sf):
    """Naive times in a zone with daylight saving, times with an offset, and bad ones; of two hours with one name the first counts."""
    moved = views.events(spark, sf).select("event_id", F.expr("ts + make_dt_interval(cast(event_id % 365 as int))").alias("s"))
    text = lambda shift, tail: F.concat(F.date_format(F.col("s") + F.expr(f"interval {shift} hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    kind = F.col("event_id") % 5
    raw = moved.select("event_id", F.when(kind == 0, text(0, "")).when(kind == 1, text(2, "+02:00")).when(kind == 2, text(0, "Z")).when(kind == 3, text(-5, "-05:00")).otherwise(
        F.concat(F.lit("soon "), text(0, ""))).alias("timestamp"))
    return clean.parse_timestamps(raw, tz_in="Europe/Madrid", tz_out="Asia/Tokyo").select("event_id", F.unix_timestamp("timestamp").alias("utc_epoch"))


@query("clean_dedupe", """SELECT lifecycle, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT case_id) AS BIGINT) AS n_cases,
    CAST(sum(event_id) AS BIGINT) AS id_sum FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity, timestamp ORDER BY event_id) AS rn
    FROM log_customer) WHERE rn = 1 GROUP BY 1""", ("log_customer",))
def clean_dedupe(spark, sf):
    kept = clean.drop_duplicate_events(views.log_customer(spark, sf, segment=False))
    per_case = kept.groupBy("lifecycle", "case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))
    return per_case.groupBy("lifecycle").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_cases"), F.sum("s").alias("id_sum"))


@query("schema_violations", """SELECT 'missing_column' AS "check", 'case_id' AS column_name, CAST(0 AS BIGINT) AS n UNION ALL
    SELECT 'missing_column', 'activity', 0 UNION ALL SELECT 'missing_column', 'resource', 1 UNION ALL
    SELECT 'null_values', 'case_id', count(*) FILTER (user_id IS NULL) FROM events UNION ALL
    SELECT 'null_values', 'activity', count(*) FILTER (CASE WHEN event_type <> 'error' THEN event_type END IS NULL) FROM events UNION ALL
    SELECT 'empty_log', '*', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM events UNION ALL
    SELECT 'no_cases', 'case_id', CASE WHEN count(user_id) = 0 THEN 1 ELSE 0 END FROM events""")
def schema_violations(spark, sf):
    log = views.log_user(spark, sf, segment=False).withColumn("activity", F.when(F.col("activity") != "error", F.col("activity")))
    return clean.schema_violations(log, ("case_id", "activity", "resource"))


@query("lifecycle_filter", "SELECT case_id, CAST(count(*) AS BIGINT) AS n FROM log_customer WHERE lower(lifecycle) IN ('f', 'o') GROUP BY 1", ("log_customer",))
def lifecycle_filter(spark, sf):
    return clean.filter_lifecycle(views.log_customer(spark, sf, segment=False), ["F", "o"]).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query("case_ids_dense", """SELECT event_id, CAST(dense_rank() OVER (ORDER BY case_id) - 1 AS BIGINT) AS case_no FROM log_session""", ("log_session",))
def case_ids_dense(spark, sf):
    return clean.encode_case_ids(views.log_session(spark, sf, segment=False), out="case_no").select("event_id", "case_no")


@query("select_and_sort", "SELECT case_id, activity, event_id, amount FROM log_customer", ("log_customer",))
def select_and_sort(spark, sf):
    picked = clean.select_columns(views.log_customer(spark, sf, segment=False), ["case_id", "activity", "timestamp", "event_id", "amount", "nope"])
    return clean.sort_for_write(picked, ("timestamp", "activity", "event_id")).drop("timestamp")


@query("case_length_filter", """SELECT case_id, event_id FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM log_session)
    WHERE n BETWEEN 2 AND 4""", ("log_session",))
def case_length_filter(spark, sf):
    return clean.filter_case_length(views.log_session(spark, sf, segment=False), 2, 4).select("case_id", "event_id")


@query("incomplete_cases", """SELECT case_id, event_id FROM (SELECT *, last_value(activity) OVER (PARTITION BY case_id ORDER BY timestamp, activity, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS la FROM log_session) WHERE la IN ('purchase', 'signup')""", ("log_session",))
def incomplete_cases(spark, sf):
    return clean.drop_incomplete_cases(views.log_session(spark, sf, segment=False), ["purchase", "signup"]).select("case_id", "event_id")


def _holes(spark, sf):
    return views.events(spark, sf).select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
                                          F.get_json_object("props", "$.k").cast("double").alias("k"))


cte("holes", """SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")


@query("impute_numeric", """SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM holes)), 6) AS median_fill,
    round(coalesce(value, (SELECT avg(value) FROM holes)), 6) AS mean_fill, coalesce(value, 0.0) AS zero_fill FROM holes""", ("holes",))
def impute_numeric(spark, sf):
    base = _holes(spark, sf)
    filled = base.withColumns({"median_fill": F.col("value"), "mean_fill": F.col("value"), "zero_fill": F.col("value")})
    out = clean.impute_numeric(filled, ["median_fill"], "median")
    out = clean.impute_numeric(out, ["mean_fill"], "mean")
    out = clean.impute_numeric(out, ["zero_fill"], "zero")
    return out.select("event_id", *r6("median_fill", "mean_fill"), "zero_fill")


@query("normalize_numeric", """SELECT event_id, round((value - s.m) / s.d, 6) + 0.0 AS value_z, round((k - s.lo) / (s.hi - s.lo), 6) + 0.0 AS k_mm
    FROM holes, (SELECT avg(value) AS m, stddev_pop(value) AS d, min(k) AS lo, max(k) AS hi FROM holes) s""", ("holes",))
def normalize_numeric(spark, sf):
    z = clean.normalize_numeric(_holes(spark, sf), ["value"], "zscore", "_z")
    return clean.normalize_numeric(z, ["k"], "minmax", "_mm").select("event_id", *r6("value_z", "k_mm"))


@query("range_checks", """SELECT 'value' AS column_name, CAST(1.0 AS DOUBLE) AS lo, CAST(200.0 AS DOUBLE) AS hi, count(value) AS n_checked,
    count(*) FILTER (value < 1.0) AS n_below, count(*) FILTER (value > 200.0) AS n_above FROM holes UNION ALL
    SELECT 'k', 0.0, 90.0, count(k), count(*) FILTER (k < 0.0), count(*) FILTER (k > 90.0) FROM holes""", ("holes",))
def range_checks(spark, sf):
    return clean.range_violations(_holes(spark, sf), {"value": (1.0, 200.0), "k": (0.0, 90.0)})


@query("day_filter", """SELECT case_id, event_id FROM log_user WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-06'""", ("log_user",))
def day_filter(spark, sf):
    return clean.filter_day(views.log_user(spark, sf, segment=False), "2024-01-05").select("case_id", "event_id")


@query("split_filter", "SELECT l.case_id, l.event_id FROM log_session l JOIN splits s USING (case_id) WHERE s.split = 'val'", ("log_session", "splits"))
def split_filter(spark, sf):
    return clean.filter_split(views.log_session(spark, sf, segment=False), session_splits(spark, sf), "val").select("case_id", "event_id")


@query("nan_to_null", """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value FROM events""")
def nan_to_null(spark, sf):
    odd = views.events(spark, sf).select("event_id", F.when(F.col("event_type") == "error", F.lit(float("nan")))
                                         .when(F.col("event_type") == "view", F.lit(float("-inf"))).otherwise(F.col("value")).alias("value"))
    return clean.nan_to_null(odd, ["value"])


@query("time_deltas", """SELECT event_id, CAST(floor(epoch(timestamp)) - floor(epoch(lag(timestamp) OVER
    (PARTITION BY case_id ORDER BY timestamp, activity, event_id))) AS BIGINT) AS delta_t FROM log_user""", ("log_user",))
def time_deltas(spark, sf):
    return clean.time_deltas(views.log_user(spark, sf)).select("event_id", "delta_t")


@query("request_errors", """SELECT event_id, array_to_string([x FOR x IN [
      'cum_cost:missing', CASE WHEN count_click < 0 THEN 'count_click:negative' END, CASE WHEN amount < 0 THEN 'amount:negative' END,
      CASE WHEN elapsed_time < 0 THEN 'elapsed_time:negative' END,
      CASE WHEN est_quality NOT BETWEEN 0 AND 1 THEN 'est_quality:outside_0_1' END,
      CASE WHEN unc_quality NOT BETWEEN 0 AND 1 THEN 'unc_quality:outside_0_1' END,
      CASE WHEN prefix_len IS NULL THEN 'prefix_len:not_finite' WHEN prefix_len < 1 THEN 'prefix_len:below_1' END] IF x IS NOT NULL], ',') AS errors
    FROM (SELECT event_id, value - 5.0 AS amount, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 90.0 AS est_quality,
      value - 3.0 AS elapsed_time, value / 100.0 AS unc_quality, CASE WHEN event_id % 3 = 0 THEN event_id % 5 - 2 END AS count_click,
      CASE WHEN event_type <> 'view' THEN user_id END AS prefix_len FROM events)""")
def request_errors(spark, sf):
    req = views.events(spark, sf).select(
        "event_id", (F.col("value") - 5.0).alias("amount"), (F.get_json_object("props", "$.k").cast("double") / 90.0).alias("est_quality"),
        (F.col("value") - 3.0).alias("elapsed_time"), (F.col("value") / 100.0).alias("unc_quality"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5 - 2).alias("count_click"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("prefix_len"))
    return clean.request_errors(req).select("event_id", F.array_join("errors", ",").alias("errors"))


# ---- cases -------------------------------------------------------------------------------------


@query("outcome_presence", """SELECT event_id, max(CASE WHEN activity = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY case_id)::DOUBLE AS outcome
    FROM log_session""", ("log_session",))
def outcome_presence(spark, sf):
    return cases.with_outcome(views.log_session(spark, sf, segment=False), [POSITIVE]).select("event_id", "outcome")


@query("outcome_last_matching", """SELECT case_id, CASE WHEN arg_max(activity, (timestamp, activity, event_id)) = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome
    FROM log_session GROUP BY 1""", ("log_session",))
def outcome_last_matching(spark, sf):
    return cases.presence_outcome(views.log_session(spark, sf, segment=False), [POSITIVE], "last_matching")


@query("terminal_value", """SELECT case_id, arg_max(value, (timestamp, activity, event_id)) FILTER (activity <> 'error') AS value
    FROM log_session GROUP BY 1""", ("log_session",))
def terminal_value(spark, sf):
    log = views.log_session(spark, sf, segment=False).withColumn("value", F.when(F.col("activity") != "error", F.col("value")))
    return cases.terminal_value(log, "value")


@query("ingest_stats", """SELECT e.*, l.* FROM
    (SELECT count(*) AS n_events, CAST(floor(min(epoch(timestamp))) AS BIGINT) AS first_epoch, CAST(floor(max(epoch(timestamp))) AS BIGINT) AS last_epoch,
      CAST(100.0 * avg(CASE WHEN activity IS NULL THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS missing_activity_pct FROM log_session) e,
    (SELECT count(*) AS n_cases, min(c) AS len_min, round(avg(c), 6) AS len_mean, quantile_cont(c, 0.5) AS len_p50, round(quantile_cont(c, 0.95), 6) AS len_p95,
      max(c) AS len_max FROM (SELECT count(*) AS c FROM log_session GROUP BY case_id)) l""", ("log_session",))
def ingest_stats(spark, sf):
    s = cases.ingest_stats(views.log_session(spark, sf, segment=False))
    return s.select("n_events", F.unix_timestamp("first_event").alias("first_epoch"), F.unix_timestamp("last_event").alias("last_epoch"),
                    "missing_activity_pct", "n_cases", "len_min", *r6("len_mean"), "len_p50", *r6("len_p95"), "len_max")


@query("top_activities", "SELECT activity, count(*) AS cnt FROM log_customer GROUP BY 1 ORDER BY cnt DESC, activity LIMIT 3", ("log_customer",))
def top_activities(spark, sf):
    return cases.top_activities(views.log_customer(spark, sf, segment=False), 3)


cte("feat_session", """SELECT case_id, t, n_events, value, CAST(t AS DOUBLE) AS prefix_len, (epoch_us(timestamp) - epoch_us(start_ts)) / 86400000000.0 AS elapsed_time,
    CAST(sum(CASE WHEN activity = 'view' THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS count_view,
    CAST(sum(CASE WHEN activity = 'click' THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS count_click
    FROM seq_session WINDOW w AS (PARTITION BY case_id ORDER BY t ROWS UNBOUNDED PRECEDING)""", "seq_session")


def session_features(spark, sf):
    return cases.case_features(views.log_session(spark, sf), ["value"], ["view", "click"])


@query("case_features", f"SELECT case_id, t, {sql6('value', 'prefix_len', 'elapsed_time', 'count_view', 'count_click')} FROM feat_session", ("feat_session",))
def case_features(spark, sf):
    f = session_features(spark, sf)
    return f.select("case_id", "t", *r6("value", "prefix_len", "elapsed_time", "count_view", "count_click"))


cte("wanted_states", """SELECT CASE WHEN event_type = 'error' THEN 'ghost-' || event_id ELSE user_id || '-' || strftime(ts, '%Y-%m-%d') END AS case_id,
    CAST(floor(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10) AS INTEGER) AS t, event_id FROM events""")


@query("features_at_t", """SELECT w.event_id, f.case_id IS NULL AS missing, round(coalesce(f.value, 0.0), 6) AS value, coalesce(f.prefix_len, 0.0) AS prefix_len,
    coalesce(f.count_view, 0.0) AS count_view FROM wanted_states w
    LEFT JOIN (SELECT case_id, max(t) AS n FROM feat_session GROUP BY 1) n ON n.case_id = w.case_id
    LEFT JOIN feat_session f ON f.case_id = w.case_id AND f.t = greatest(1, least(w.t, n.n))""", ("feat_session", "wanted_states"))
def features_at_t(spark, sf):
    wanted = views.events(spark, sf).select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("ghost-"), "event_id"))
        .otherwise(F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd"))).alias("case_id"),
        F.floor(F.get_json_object("props", "$.k").cast("double") / 10).cast("int").alias("t"), "event_id")
    sizes = cases.case_sizes(views.log_session(spark, sf, segment=False))
    return cases.features_at(session_features(spark, sf), wanted, sizes).select("event_id", "missing", *r6("value"), "prefix_len", "count_view")


@query("cycle_time", "SELECT case_id, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0, 6) AS ct_days FROM log_session GROUP BY 1", ("log_session",))
def cycle_time(spark, sf):
    return cases.cycle_time(views.log_session(spark, sf, segment=False)).select("case_id", *r6("ct_days"))


@query("feature_stats", """SELECT 'value' AS feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM feat_session UNION ALL
    SELECT 'prefix_len', round(avg(prefix_len), 6), round(stddev_pop(prefix_len), 6) FROM feat_session UNION ALL
    SELECT 'count_view', round(avg(count_view), 6), round(stddev_pop(count_view), 6) FROM feat_session""", ("feat_session",))
def feature_stats(spark, sf):
    return cases.feature_stats(session_features(spark, sf), ["value", "prefix_len", "count_view"]).select("feature", *r6("mean", "std"))


@query("case_start", "SELECT case_id, CAST(floor(epoch(min(timestamp))) AS BIGINT) AS start_epoch FROM log_session GROUP BY 1", ("log_session",))
def case_start(spark, sf):
    return cases.case_start(views.log_session(spark, sf, segment=False)).select("case_id", F.unix_timestamp("start_ts").alias("start_epoch"))


@query("case_reward", "SELECT case_id, round(sum(r), 6) AS total_reward, count(*) AS n_transitions FROM tr_session GROUP BY 1", ("tr_session",))
def case_reward(spark, sf):
    return cases.case_reward(session_transitions(spark, sf)).select("case_id", *r6("total_reward"), "n_transitions")


# ---- vocabulary and prefixes ---------------------------------------------------------------------

cte("vocab", """SELECT activity AS token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, activity) + 1 AS INTEGER) AS id
    FROM (SELECT activity, count(*) AS cnt FROM log_session GROUP BY 1)""", "log_session")
cte("pre_user", """SELECT s.*, coalesce(v.id, 1) AS token_id FROM seq_user s LEFT JOIN vocab4 v ON v.token = s.activity""", "seq_user", "vocab4")
cte("vocab4", "SELECT * FROM vocab WHERE id <= 4", "vocab")
cte("enc_user", """SELECT case_id, t, n_events, activity, token_id, CAST(floor(epoch(timestamp)) AS BIGINT) AS ts_last,
    list(token_id) OVER (PARTITION BY case_id ORDER BY t ROWS 49 PRECEDING) AS toks,
    list(token_id) OVER (PARTITION BY case_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS full_toks FROM pre_user""", "pre_user")


@query("vocab", "SELECT token, id, cnt FROM vocab", ("vocab",))
def vocab(spark, sf):
    return encode.build_vocab(views.log_session(spark, sf, segment=False))


@query("vocab_limited", """SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 1 AS INTEGER) AS id, cnt FROM
    (SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split(lower(text), ' ')) AS token FROM conversations) GROUP BY 1 HAVING count(*) >= 2)
    QUALIFY row_number() OVER (ORDER BY cnt DESC, token) <= 498""")
def vocab_limited(spark, sf):
    words = views.table(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    return encode.build_vocab(words, "word", min_freq=2, max_size=500)


def user_vocab(spark, sf):
    return encode.build_vocab(views.log_session(spark, sf, segment=False), max_size=5)


@query("prefixes_left", """SELECT case_id, t, ts_last, CAST(len(toks) AS INTEGER) AS length,
    array_to_string(list_concat(list_resize([]::INTEGER[], 50 - len(toks), 0), toks), ',') AS x FROM enc_user""", ("enc_user",))
def prefixes_left(spark, sf):
    p = encode.encode_prefixes(views.log_user(spark, sf), user_vocab(spark, sf), 50)
    return p.select("case_id", "t", "ts_last", "length", render(F.col("x")).alias("x"))


@query("prefixes_right", """SELECT case_id, t, CAST(least(t, 12) AS INTEGER) AS length,
    array_to_string(list_concat(full_toks[1:12], list_resize([]::INTEGER[], 12 - least(t, 12), 0)), ',') AS x,
    array_to_string(list_concat(list_resize([]::INTEGER[], least(t, 12), 1), list_resize([]::INTEGER[], 12 - least(t, 12), 0)), ',') AS mask
    FROM enc_user WHERE t >= 3""", ("enc_user",))
def prefixes_right(spark, sf):
    p = encode.encode_prefixes(views.log_user(spark, sf), user_vocab(spark, sf), 12, 3, "right", "right")
    return p.select("case_id", "t", "length", render(F.col("x")).alias("x"), render(F.col("mask")).alias("mask"))


@query("prefixes_chat", """SELECT case_id, t, array_to_string(list_concat(list_resize([]::INTEGER[], 8 - len(toks), 0), toks), ',') AS x FROM
    (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY turn) AS t, list(id) OVER (PARTITION BY case_id ORDER BY turn ROWS 7 PRECEDING) AS toks
     FROM log_chat JOIN (SELECT activity AS token, row_number() OVER (ORDER BY count(*) DESC, activity) + 1 AS id FROM log_chat GROUP BY 1) v ON v.token = activity)""",
       ("log_chat",))
def prefixes_chat(spark, sf):
    log = views.log_chat(spark, sf)
    p = encode.encode_prefixes(log, encode.build_vocab(log), 8, order=("turn",))
    return p.select("case_id", "t", render(F.col("x")).alias("x"))


@query("encode_stats", """SELECT count(*) AS n_prefixes, count(*) FILTER (t = n_events) AS n_cases, round(100.0 * avg(CASE WHEN token_id = 1 THEN 1.0 ELSE 0.0 END), 6) AS unk_pct,
    CAST(min(len(toks)) AS INTEGER) AS len_min, round(avg(len(toks)), 6) AS len_mean, round(quantile_cont(len(toks), 0.5), 6) AS len_p50,
    round(quantile_cont(len(toks), 0.95), 6) AS len_p95, CAST(max(len(toks)) AS INTEGER) AS len_max, (SELECT count(*) + 2 FROM vocab4) AS vocab_size,
    (SELECT string_agg(token || ':' || cnt, ',' ORDER BY cnt DESC, token) FROM vocab4) AS top_tokens FROM enc_user""", ("enc_user", "vocab4"))
def encode_stats(spark, sf):
    v = user_vocab(spark, sf)
    s = encode.encode_stats(encode.encode_prefixes(views.log_user(spark, sf), v, 50), v)
    top = F.array_join(F.transform("top_tokens", lambda x: F.concat_ws(":", x["token"], x["cnt"])), ",")
    return s.select("n_prefixes", "n_cases", *r6("unk_pct"), "len_min", *r6("len_mean", "len_p50", "len_p95"), "len_max", "vocab_size", top.alias("top_tokens"))


@query("unk_rate", """SELECT round(100.0 * avg(CASE WHEN token_id = 1 THEN 1.0 ELSE 0.0 END), 6) AS unk_pct FROM pre_user""", ("pre_user",))
def unk_rate(spark, sf):
    return encode.unk_rate(encode.encode_tokens(views.log_user(spark, sf, segment=False), user_vocab(spark, sf))).select(*r6("unk_pct"))


@query("encode_flow", """SELECT case_id, t, array_to_string(list_concat(list_resize([]::INTEGER[], 10 - len(toks), 0), toks), ',') AS x FROM
    (SELECT case_id, t, list(CAST(v.id AS INTEGER)) OVER (PARTITION BY case_id ORDER BY t ROWS 9 PRECEDING) AS toks FROM seq_session JOIN vocab v ON v.token = activity)""",
       ("seq_session", "vocab"))
def encode_flow(spark, sf):
    """Vocabulary and prefixes of a log in one call."""
    _, prefixes = encode.encode_log(views.log_session(spark, sf), max_len=10)
    return prefixes.select("case_id", "t", render(F.col("x")).alias("x"))


@query("decode_last", """SELECT case_id, t, CASE WHEN token_id = 1 THEN '<UNK>' ELSE activity END AS last_token FROM enc_user""", ("enc_user",))
def decode_last(spark, sf):
    v = user_vocab(spark, sf)
    return encode.decode_last(encode.encode_prefixes(views.log_user(spark, sf), v, 50), v).select("case_id", "t", "last_token")


@query("oov_audit", """SELECT CAST(10 * count(*) AS BIGINT) AS n_tokens, CAST(sum(len([x FOR x IN toks10 IF x >= 5])) AS BIGINT) AS n_oov, 5 AS vocab_size,
    round(100.0 * sum(len([x FOR x IN toks10 IF x >= 5])) / (10 * count(*)), 6) AS oov_pct, 'error' AS severity
    FROM (SELECT list(v.id) OVER (PARTITION BY case_id ORDER BY t ROWS 9 PRECEDING) AS toks10 FROM seq_user JOIN vocab v ON v.token = activity)""", ("seq_user", "vocab"))
def oov_audit(spark, sf):
    full = encode.build_vocab(views.log_session(spark, sf, segment=False))
    p = encode.encode_prefixes(views.log_user(spark, sf), full, 10)
    return encode.oov_audit(p, user_vocab(spark, sf)).select("n_tokens", "n_oov", "vocab_size", *r6("oov_pct"), "severity")


@query("encode_tabular", f"SELECT case_id, t, {sql6('value', 'count_view')} FROM feat_session WHERE t >= 2", ("feat_session",))
def encode_tabular(spark, sf):
    return encode.encode_tabular(views.log_session(spark, sf), ["value"], ["view", "click"], 2).select("case_id", "t", *r6("value", "count_view"))


# ---- transitions ---------------------------------------------------------------------------------

cte("enc_session", f"""SELECT s.case_id, s.t, list(v.id) OVER (PARTITION BY case_id ORDER BY t ROWS {MAX_LEN - 1} PRECEDING) AS toks,
    list(v.id) OVER (PARTITION BY case_id ORDER BY t ROWS BETWEEN {MAX_LEN - 2} PRECEDING AND 1 FOLLOWING) AS next_toks
    FROM seq_session s JOIN vocab v ON v.token = s.activity""", "seq_session", "vocab")


@query("transitions", f"""SELECT t.case_id, t.t, last_activity, a, CAST(1 + valid1 AS INTEGER) AS n_valid, r, done, CAST(-1.0 AS DOUBLE) AS propensity,
    array_to_string(list_concat(list_resize([]::INTEGER[], {MAX_LEN} - len(toks), 0), toks), ',') AS s,
    array_to_string(list_concat(list_resize([]::INTEGER[], {MAX_LEN} - len(next_toks), 0), next_toks), ',') AS s_next
    FROM tr_session t JOIN enc_session e ON e.case_id = t.case_id AND e.t = t.t""", ("tr_session", "enc_session"))
def transitions_query(spark, sf):
    v = encode.build_vocab(views.log_session(spark, sf, segment=False))
    tr = session_transitions(spark, sf, v)
    return tr.select("case_id", "t", "last_activity", "a", F.aggregate("valid_actions", F.lit(0), lambda s, x: s + x.cast("int")).alias("n_valid"),
                     "r", "done", "propensity", render(F.col("s")).alias("s"), render(F.col("s_next")).alias("s_next"))


@query("transitions_by_decision_point", """SELECT case_id, t, a, done FROM tr_user WHERE last_activity IN ('view', 'signup')""", ("tr_user",))
def transitions_by_decision_point(spark, sf):
    from dataclasses import replace

    spec = replace(SPEC, mode="by_last_activity", decision_activities=("view", "signup"))
    return transitions.build_transitions(views.log_user(spark, sf), spec, outcome_value()).select("case_id", "t", "a", "done")


@query("behavior_inclusive", """SELECT case_id, t, CASE WHEN next_activity = 'click' OR last_activity = 'click' THEN 1 ELSE 0 END AS a FROM steps_session""", ("steps_session",))
def behavior_inclusive(spark, sf):
    from dataclasses import replace

    st = transitions.steps(views.log_session(spark, sf), replace(SPEC, inclusive=True), outcome_value())
    return st.select("case_id", "t", "a")


@query("drop_counts", """SELECT count(*) AS n_steps, count(*) FILTER (NOT d) AS n_not_decision, count(*) FILTER (d AND a = 1 AND valid1 = 0) AS n_masked,
    count(*) FILTER (d AND (a = 0 OR valid1 = 1)) AS n_kept, count(*) FILTER (done = 1 AND NOT (d AND (a = 0 OR valid1 = 1))) AS n_lost_terminal
    FROM (SELECT *, last_activity IN ('view', 'error') AS d FROM steps_session)""", ("steps_session",))
def drop_counts(spark, sf):
    from dataclasses import replace

    spec = replace(SPEC, mode="by_last_activity", decision_activities=("view", "error"))
    return transitions.drop_counts(transitions.steps(views.log_session(spark, sf), spec, outcome_value()))


@query("transition_stats", """SELECT count(*) AS n_transitions, count(DISTINCT case_id) AS n_cases, round(100.0 * avg(done), 6) AS done_pct, round(avg(r), 6) AS reward_mean,
    round(stddev_pop(r), 6) AS reward_std, round(quantile_cont(r, 0.5) FILTER (done = 1), 6) AS terminal_p50,
    round(quantile_cont(r, 0.95) FILTER (done = 1), 6) AS terminal_p95, round(100.0 * count(*) FILTER (done = 0 AND r = 0) / count(*) FILTER (done = 0), 6) AS nonterminal_zero_pct,
    round(100.0 * count(*) FILTER (done = 1 AND r <> 0) / count(*) FILTER (done = 1), 6) AS terminal_nonzero_pct FROM tr_session""", ("tr_session",))
def transition_stats(spark, sf):
    s = transitions.transition_stats(session_transitions(spark, sf))
    return s.select("n_transitions", "n_cases", *r6("done_pct", "reward_mean", "reward_std", "terminal_p50", "terminal_p95",
                                                    "nonterminal_zero_pct", "terminal_nonzero_pct"))


@query("transition_violations", """SELECT count(*) AS n, count(*) FILTER (t % 7 = 0) AS bad_mask_width, count(*) FILTER (t % 9 = 0) AS action_out_of_range,
    count(*) FILTER (t % 9 = 0 OR a = 1 AND (valid1 = 0 OR t % 7 = 0)) AS invalid_action, count(*) FILTER (t % 11 = 0) AS bad_done, count(*) FILTER (t % 13 = 0) AS negative_t FROM steps_user""", ("steps_user",))
def transition_violations(spark, sf):
    return transitions.transition_violations(broken(transitions.steps(views.log_user(spark, sf), SPEC, outcome_value())), 2)


def broken(tr):
    """Steps that break every rule now and then: mask width, action, flag and position."""
    t = F.col("t")
    return tr.withColumns({
        "valid_actions": F.when(t % 7 == 0, F.slice("valid_actions", 1, 1)).otherwise(F.col("valid_actions")), "a": F.when(t % 9 == 0, 5).otherwise(F.col("a")),
        "done": F.when(t % 11 == 0, 2).otherwise(F.col("done")), "t": F.when(t % 13 == 0, -t).otherwise(t)})


cte("fb", """SELECT case_id, t, n_events, value, activity, lead(value) OVER (PARTITION BY case_id ORDER BY t) AS next_value FROM seq_user""", "seq_user")


@query("feedback_transitions", """SELECT case_id, t, value || ',' || CAST(t AS DOUBLE) || ',0.0' AS s, next_value || ',' || CAST(t + 1 AS DOUBLE) || ',0.0' AS s_next,
    CASE WHEN activity = 'purchase' THEN 1 ELSE 0 END AS a, CASE WHEN t >= n_events - 1 THEN value ELSE 0.0 END AS r,
    CASE WHEN t >= n_events - 1 THEN 1 ELSE 0 END AS done FROM fb WHERE t < n_events AND n_events >= 2""", ("fb",))
def feedback_transitions(spark, sf):
    out = transitions.feedback_transitions(views.feedback(spark, sf), ["value", "prefix_len", "unseen"], min_cases=10)
    return out.select("case_id", "t", render(F.col("s")).alias("s"), render(F.col("s_next")).alias("s_next"), "a", "r", "done")


# ---- splits and validation -----------------------------------------------------------------------


@query("split_random", "SELECT case_id, split FROM splits", ("splits",))
def split_random(spark, sf):
    return session_splits(spark, sf)


cte("tsplit", """SELECT case_id, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT case_id, row_number() OVER (ORDER BY min(timestamp), case_id) AS rk, count(*) OVER () AS n FROM log_session GROUP BY 1)""", "log_session")


@query("split_temporal", "SELECT case_id, split FROM tsplit", ("tsplit",))
def split_temporal(spark, sf):
    return splits.split_temporal(cases.case_start(views.log_session(spark, sf, segment=False))).select("case_id", "split")


@query("split_manifest", f"""SELECT split, count(*) AS n_cases, 'random_case' AS method, {SEED} AS seed,
    CAST(CASE split WHEN 'train' THEN 0.7 WHEN 'val' THEN 0.1 ELSE 0.2 END AS DOUBLE) AS ratio FROM splits GROUP BY 1""", ("splits",))
def split_manifest(spark, sf):
    return splits.split_manifest(session_splits(spark, sf), "random_case", SEED)


# an intentionally overlapping assignment: random and temporal splits together
cte("mixed", "SELECT * FROM splits UNION SELECT * FROM tsplit", "splits", "tsplit")


def _mixed(spark, sf):
    return session_splits(spark, sf).union(split_temporal(spark, sf)).distinct()


@query("split_checks", """SELECT (SELECT count(*) FROM (SELECT case_id FROM mixed WHERE split <> 'test' GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n_overlapping,
    (SELECT count(DISTINCT case_id) FROM log_session WHERE case_id NOT IN (SELECT case_id FROM mixed WHERE split <> 'test')) AS n_uncovered,
    (SELECT count(DISTINCT case_id) FROM mixed WHERE split = 'val') AS n_unknown""", ("mixed", "log_session"))
def split_checks(spark, sf):
    """Splits that overlap, leave the test cases out and name cases nobody knows."""
    kept = _mixed(spark, sf).where("split <> 'test'")
    unknown = kept.where("split = 'val'").withColumn("case_id", F.concat(F.lit("no-"), "case_id"))
    return splits.split_checks(kept.unionByName(unknown), views.log_session(spark, sf, segment=False))


@query("validation_report", f"""SELECT section, name, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM (
    SELECT 'structure' AS section, unnest(['empty', 'width:s', 'width:s_mask', 'width:s_next', 'width:s_next_mask', 'binary:s_mask', 'binary:s_next_mask', 'width:valid_actions', 'invalid_action', 'binary:done', 'negative:t']) AS name,
      unnest([CAST(count(*) = 0 AS INT), count(*) FILTER (len(toks) > {MAX_LEN}), count(*) FILTER (len(toks) > {MAX_LEN}), count(*) FILTER (len(next_toks) > {MAX_LEN}), count(*) FILTER (len(next_toks) > {MAX_LEN}),
        count(*) FILTER (len(toks) < 1), count(*) FILTER (len(next_toks) < 2), count(*) FILTER (valid1 NOT IN (0, 1)), count(*) FILTER (a = 1 AND valid1 = 0), count(*) FILTER (done NOT IN (0, 1)), count(*) FILTER (t.t < 0)])::DOUBLE AS value
      FROM tr_session t JOIN enc_session e ON e.case_id = t.case_id AND e.t = t.t
    UNION ALL SELECT 'reward', unnest(['n_bad_intermediate', 'n_terminal', 'terminal_mean', 'terminal_std']),
      unnest([count(*) FILTER (done = 0 AND r <> 0), count(*) FILTER (done = 1), avg(r) FILTER (done = 1), stddev_pop(r) FILTER (done = 1)]) FROM tr_session
    UNION ALL SELECT 'continuity', 'n_gaps', count(*) FROM tr_session x WHERE done = 0 AND NOT EXISTS (SELECT 1 FROM tr_session y WHERE y.case_id = x.case_id AND y.t = x.t + 1)
    UNION ALL SELECT 'splits', unnest(['n_overlapping', 'n_uncovered', 'n_unknown']), unnest([(SELECT count(*) FROM (SELECT case_id FROM splits GROUP BY 1 HAVING count(DISTINCT split) > 1)),
      (SELECT count(DISTINCT case_id) FROM log_session WHERE case_id NOT IN (SELECT case_id FROM splits)), (SELECT count(DISTINCT case_id) FROM splits WHERE case_id NOT IN (SELECT case_id FROM log_session))])
    UNION ALL SELECT 'drift', unnest(['train_mean', 'test_mean', 'drift_pct', 'flagged']), unnest([a, b, 100.0 * abs(b - a) / a, CAST(100.0 * abs(b - a) / a > 20 AS INT)]) FROM
      (SELECT avg(l) FILTER (split = 'train') AS a, avg(l) FILTER (split = 'test') AS b FROM (SELECT case_id, max(t) AS l FROM tr_session GROUP BY 1) JOIN splits USING (case_id)))""", ("tr_session", "enc_session", "splits"))
def validation_report(spark, sf):
    """Raw events to a checked decision dataset, in one flow."""
    raw = views.events(spark, sf).select(
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("case_nr"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_id", "value")
    log = flows.prepare_log(raw, {"case_id": "case_nr", "activity": "event_type", "timestamp": "at"}, dense_ids=False, dedupe=False)
    data = flows.decision_dataset(log, SPEC, outcome_value(), max_len=MAX_LEN, seed=SEED)
    return flows.validation_report(data, 2, MAX_LEN).select("section", "name", *r6("value"))


@query("schema_document", """SELECT x.name AS column_name, x.kind AS expected, CASE c.column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS actual,
    (SELECT count(*) FROM events) AS n_rows FROM (VALUES ('event_id', 'string'), ('event_type', 'string'), ('resource', 'string'), ('value', 'double')) x(name, kind)
    LEFT JOIN (SELECT column_name, column_type FROM (DESCRIBE events)) c ON c.column_name = x.name WHERE c.column_type IS NULL OR
    CASE c.column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END <> x.kind""")
def schema_document(spark, sf):
    """Where the events differ from a schema document, and how many rows that concerns."""
    from pyspark.sql import types as T

    log = views.events(spark, sf)
    document = T.StructType.fromDDL("event_id string, event_type string, resource string, value double")
    return clean.schema_differences(log, document).withColumn("n_rows", log.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("split_leakage", """SELECT p.x || '&' || p.y AS pair, (SELECT count(*) FROM (SELECT case_id FROM mixed WHERE split = p.x INTERSECT SELECT case_id FROM mixed WHERE split = p.y)) AS n_shared
    FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) p(x, y)""", ("mixed",))
def split_leakage(spark, sf):
    return splits.split_overlaps(_mixed(spark, sf))


@query("transitions_last_outcome", """SELECT s.case_id, s.t, s.a, s.done, CASE WHEN s.done = 1 THEN coalesce(o.v, 0.0) ELSE 0.0 END AS r FROM tr_session s LEFT JOIN
    (SELECT case_id, arg_max(value, (timestamp, activity, event_id)) FILTER (activity <> 'view') AS v FROM log_session GROUP BY 1) o USING (case_id)""", ("tr_session", "log_session"))
def transitions_last_outcome(spark, sf):
    """The value of the last event other than a view; it varies inside a case and may be absent."""
    last = ("last", F.when(F.col("activity") != "view", F.col("value")))
    return transitions.build_transitions(views.log_session(spark, sf), SPEC, last).select("case_id", "t", "a", "done", "r")


@query("transitions_cut", """SELECT s.case_id, s.t, s.a, s.done, s.n_trigger, CASE WHEN s.done = 1 THEN coalesce(o.v, 0.0) ELSE 0.0 END AS r FROM tr_user s LEFT JOIN
    (SELECT case_id, arg_max(value, (timestamp, activity, event_id)) FILTER (activity <> 'view') AS v FROM log_user GROUP BY 1) o USING (case_id)""", ("tr_user", "log_user"))
def transitions_cut(spark, sf):
    """Cases of more than twenty events are cut into segments; the result is that of whole cases."""
    cut = segment_cases(views.log_user(spark, sf, segment=False), max_rows=20)
    last = ("last", F.when(F.col("activity") != "view", F.col("value")))
    return transitions.build_transitions(cut, SPEC, last).select("case_id", "t", "a", "done", "n_trigger", "r")


cte("profile", """SELECT split, count(*) AS n_cases, CAST(sum(kept) AS BIGINT) AS n_transitions, avg(len) AS episode_len_mean, stddev_pop(len) AS episode_len_std,
    100.0 * sum(d) / sum(kept) AS done_pct, sum(tr) / sum(d) AS terminal_reward_mean,
    stddev_pop(tr) AS terminal_reward_std,
    1.0 - sum(a1) / sum(kept) AS action_0_rate, sum(a1) / sum(kept) AS action_1_rate FROM
    (SELECT case_id, count(*) AS kept, max(t) AS len, sum(done) AS d, sum(r) FILTER (done = 1) AS tr, CAST(sum(a) AS DOUBLE) AS a1 FROM tr_session GROUP BY 1) JOIN splits USING (case_id) GROUP BY 1""",
    "tr_session", "splits")
PROFILE = ("episode_len_mean", "episode_len_std", "done_pct", "terminal_reward_mean", "terminal_reward_std", "action_0_rate", "action_1_rate")


def profile(spark, sf):
    return splits.split_profile(session_transitions(spark, sf), session_splits(spark, sf), 2)


@query("split_profile", f"SELECT split, n_cases, n_transitions, {sql6(*PROFILE)} FROM profile", ("profile",))
def split_profile(spark, sf):
    return profile(spark, sf).select("split", "n_cases", "n_transitions", *r6(*PROFILE))


@query("split_totals", """SELECT split, last_activity, CAST(GROUPING_ID(split, last_activity) AS INTEGER) AS level, count(*) AS n_transitions, CAST(sum(done) AS BIGINT) AS n_done, round(avg(r), 6) AS reward_mean, round(stddev_pop(r), 6) AS reward_std,
    true AS cases_near FROM tr_session JOIN splits USING (case_id) GROUP BY ROLLUP (split, last_activity)""", ("tr_session", "splits"))
def split_totals(spark, sf):
    tr, parts = session_transitions(spark, sf), session_splits(spark, sf)
    totals = splits.split_totals(tr, parts)
    exact = tr.join(parts.select("case_id", "split"), "case_id").rollup("split", "last_activity").agg(F.grouping_id().cast("int").alias("level"), F.count_distinct("case_id").alias("n_cases"))
    t, e = totals.alias("t"), exact.alias("e")
    both = t.join(e, (F.col("t.level") == F.col("e.level")) & F.col("t.split").eqNullSafe(F.col("e.split")) & F.col("t.last_activity").eqNullSafe(F.col("e.last_activity")))
    near = (F.abs(F.col("cases_about") - F.col("n_cases")) <= 3 + 0.08 * F.col("n_cases")).alias("cases_near")
    return both.select("t.split", "t.last_activity", "t.level", "n_transitions", "n_done", *r6("reward_mean", "reward_std"), near)


@query("episode_drift", """SELECT round(a.m, 6) AS train_mean, round(b.m, 6) AS test_mean, round(100.0 * abs(b.m - a.m) / a.m, 6) AS drift_pct,
    100.0 * abs(b.m - a.m) / a.m > 1.0 AS flagged FROM (SELECT episode_len_mean AS m FROM profile WHERE split = 'train') a,
    (SELECT episode_len_mean AS m FROM profile WHERE split = 'test') b""", ("profile",))
def episode_drift(spark, sf):
    return splits.episode_drift(profile(spark, sf), 1.0).select(*r6("train_mean", "test_mean", "drift_pct"), "flagged")


@query("continuity_gaps", """SELECT case_id, t FROM tr_session a WHERE done = 0 AND NOT EXISTS
    (SELECT 1 FROM tr_session b WHERE b.case_id = a.case_id AND b.t = a.t + 1)""", ("tr_session",))
def continuity_gaps(spark, sf):
    return splits.continuity_gaps(session_transitions(spark, sf)).select("case_id", "t")


@query("reward_sanity", """SELECT count(*) FILTER (done = 0 AND r <> 0) AS n_bad_intermediate, count(*) FILTER (done = 1) AS n_terminal,
    round(avg(r) FILTER (done = 1), 6) AS terminal_mean, round(stddev_pop(r) FILTER (done = 1), 6) AS terminal_std FROM tr_session""", ("tr_session",))
def reward_sanity(spark, sf):
    return splits.reward_sanity(session_transitions(spark, sf)).select("n_bad_intermediate", "n_terminal", *r6("terminal_mean", "terminal_std"))


@query("position_order", """SELECT count(*) AS n_rows, count(*) FILTER (event_id <= prev) AS n_not_increasing FROM
    (SELECT event_id, lag(event_id) OVER (PARTITION BY case_id ORDER BY timestamp, activity, event_id) AS prev FROM log_customer)""", ("log_customer",))
def position_order(spark, sf):
    log = views.log_customer(spark, sf).withColumn("t", F.col("event_id"))
    return splits.position_order_violations(log, ["timestamp", "activity", "event_id"])


@query("structure_violations", """SELECT unnest(['empty', 'width:s', 'width:s_mask', 'width:s_next', 'width:s_next_mask', 'binary:s_mask', 'binary:s_next_mask', 'width:valid_actions', 'invalid_action',
    'binary:done', 'negative:t', 'missing:case_id']) AS "check", unnest([CAST(count(*) = 0 AS BIGINT), count(*) FILTER (t % 2 = 0), count(*) FILTER (t % 3 = 0), count(*) FILTER (t % 4 = 0), count(*) FILTER (t % 5 = 0),
    count(*) FILTER (t % 6 = 1), count(*) FILTER (t % 8 = 1), count(*) FILTER (t % 7 = 0), count(*) FILTER (t % 9 = 0 OR a = 1 AND t % 7 = 0), count(*) FILTER (t % 11 = 0), count(*) FILTER (t % 13 = 0), 1]) AS n FROM tr_user""", ("tr_user",))
def structure_violations(spark, sf):
    v = encode.build_vocab(views.log_session(spark, sf, segment=False))
    tr = transitions.build_transitions(views.log_user(spark, sf), SPEC, outcome_value(), v, MAX_LEN)
    t, two = F.col("t"), F.lit(2).cast("tinyint")
    spoilt = tr.withColumns({
        "s": F.when(t % 2 == 0, F.slice("s", 1, 3)).otherwise(F.col("s")), "s_next": F.when(t % 4 == 0, F.slice("s_next", 1, 3)).otherwise(F.col("s_next")),
        "s_mask": F.when(t % 3 == 0, F.slice("s_mask", 1, 3)).otherwise(F.col("s_mask")), "s_next_mask": F.when(t % 5 == 0, F.slice("s_next_mask", 1, 3)).otherwise(F.col("s_next_mask")),
    }).withColumns({
        "s_mask": F.when(t % 6 == 1, F.transform("s_mask", lambda _: two)).otherwise(F.col("s_mask")),
        "s_next_mask": F.when(t % 8 == 1, F.transform("s_next_mask", lambda _: two)).otherwise(F.col("s_next_mask"))})
    return splits.structure_violations(broken(spoilt).drop("case_id"), MAX_LEN, 2)
