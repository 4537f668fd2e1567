"""Query registry, shared settings and the shared parts of the check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transitions
from ..operators.transitions import DecisionSpec
from ..session import tune
from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}

SEED = 42
POSITIVE = "purchase"
SPEC = DecisionSpec(
    actions=("do_nothing", "send_offer"), trigger="click", noop="do_nothing", default_valid=("do_nothing",),
    by_last_activity={k: ("do_nothing", "send_offer") for k in ("purchase", "signup", "view")},
)
MAX_LEN = 10


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query and, where SQL can express it, the statement it is checked against."""

    def keep(fn):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *uses)
        return fn

    return keep


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(sql: str, *names: str) -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in CTES[n][0]:
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    if not done:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + sql


def r6(*cols: str) -> list:
    """Round double columns to six digits, keeping names."""
    return [(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in cols]


def sql6(*cols: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in cols)


# ---- event-log views -------------------------------------------------------------------------
cte("log_user", "SELECT user_id AS case_id, event_type AS activity, ts AS timestamp, event_id, value FROM events")
cte("log_session", """SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS case_id, event_type AS activity,
    ts AS timestamp, event_id, value FROM events""")
cte("log_customer", """SELECT o_custkey AS case_id, o_orderpriority AS activity, o_orderdate AS timestamp,
    o_orderkey AS event_id, o_totalprice AS amount, o_orderstatus AS lifecycle FROM orders""")
cte("log_chat", "SELECT conv_id AS case_id, role AS activity, turn FROM conversations")
cte("decisions", """SELECT ts AS timestamp, 'req-' || event_id AS request_id, CAST(user_id AS VARCHAR) AS case_id, event_id AS t,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS action_id,
    event_type AS action_name,
    CASE event_type WHEN 'signup' THEN 'baseline' WHEN 'purchase' THEN 'override' ELSE 'surrogate' END AS source,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS confidence, event_type = 'error' AS ood, value AS latency_ms
    FROM events""")

# ---- ordered cases and transitions ---------------------------------------------------------------
for _log in ("session", "user"):
    cte(f"seq_{_log}", f"""SELECT *, row_number() OVER w AS t, count(*) OVER (PARTITION BY case_id) AS n_events,
        lead(activity) OVER w AS next_activity,
        lead(timestamp) OVER w AS next_ts, min(timestamp) OVER (PARTITION BY case_id) AS start_ts,
        CAST(sum(CASE WHEN activity = 'click' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_trigger,
        coalesce(max(CASE WHEN activity = 'purchase' THEN value END) OVER (PARTITION BY case_id), 0.0) AS outcome
        FROM log_{_log} WINDOW w AS (PARTITION BY case_id ORDER BY timestamp, activity, event_id)""", f"log_{_log}")
    cte(f"steps_{_log}", f"""SELECT case_id, t, n_events, activity AS last_activity, next_activity, n_trigger, start_ts,
        value, outcome, timestamp,
        CASE WHEN next_activity = 'click' THEN 1 ELSE 0 END AS a,
        CASE WHEN activity IN ('purchase', 'signup', 'view') THEN 1 ELSE 0 END AS valid1,
        CASE WHEN t + 1 = n_events THEN 1 ELSE 0 END AS done,
        CASE WHEN t + 1 = n_events THEN outcome ELSE 0.0 END AS r
        FROM seq_{_log} WHERE t < n_events""", f"seq_{_log}")
    cte(f"tr_{_log}", f"SELECT * FROM steps_{_log} WHERE a = 0 OR valid1 = 1", f"steps_{_log}")
cte("split_rank", f"""SELECT case_id, row_number() OVER (ORDER BY md5('{SEED}:' || case_id), case_id) AS rk, count(*) OVER () AS n
    FROM (SELECT DISTINCT case_id FROM log_session)""", "log_session")
cte("splits", """SELECT case_id, CASE WHEN rk <= q.t THEN 'train' WHEN rk <= q.t + q.v THEN 'val' ELSE 'test' END AS split
    FROM split_rank, (SELECT CAST(floor(max(n) * 0.7::DOUBLE) AS BIGINT) AS t, CAST(floor(max(n) * 0.1::DOUBLE) AS BIGINT) AS v FROM split_rank) q""",
    "split_rank")


def outcome_value():
    """Delayed reward of a case: its largest purchase."""
    return ("max", F.when(F.col("activity") == POSITIVE, F.col("value")))


def session_transitions(spark: SparkSession, folder: str, vocab: DataFrame | None = None, carry=()) -> DataFrame:
    return transitions.build_transitions(views.log_session(spark, folder), SPEC, outcome_value(), vocab, MAX_LEN, carry=carry)


def session_splits(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.splits import split_random

    return split_random(views.log_session(spark, folder, segment=False).select("case_id"), SEED)
