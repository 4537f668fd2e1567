"""Event-log views over the bundled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sequence import segment_cases

# fixed values: display order of the event types used as decision ids
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def log_user(spark: SparkSession, folder: str, segment: bool = True) -> DataFrame:
    """One case per user: long cases."""
    log = events(spark, folder).select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").alias("timestamp"), "event_id", "value")
    return segment_cases(log) if segment else log


def log_session(spark: SparkSession, folder: str, segment: bool = True) -> DataFrame:
    """One case per user and day: many short cases with string ids."""
    log = events(spark, folder).select(
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"), F.col("ts").alias("timestamp"), "event_id", "value")
    return segment_cases(log) if segment else log


def log_customer(spark: SparkSession, folder: str, segment: bool = True) -> DataFrame:
    """One case per customer over orders, with real timestamp ties."""
    log = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("activity"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderkey").alias("event_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("lifecycle"))
    return segment_cases(log) if segment else log


def log_chat(spark: SparkSession, folder: str, segment: bool = True) -> DataFrame:
    """Conversation turns: ordered by turn, no timestamps."""
    log = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("role").alias("activity"), "turn")
    return segment_cases(log, time="turn") if segment else log


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decision log: event types stand for actions, their kind for the decision source."""
    kind = F.col("event_type")
    ids = F.create_map(*[x for i, n in enumerate(EVENT_TYPES) for x in (F.lit(n), F.lit(i))])
    return events(spark, folder).select(
        F.col("ts").alias("timestamp"), F.concat(F.lit("req-"), "event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("case_id"), F.col("event_id").alias("t"),
        F.try_element_at(ids, kind).alias("action_id"), kind.alias("action_name"),
        F.when(kind == "signup", "baseline").when(kind == "purchase", "override").otherwise("surrogate").alias("source"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("confidence"),
        (kind == "error").alias("ood"), F.col("value").alias("latency_ms"))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback rows per user: features as a map, purchase as the executed action."""
    from ..plans.sequence import ordered

    seq = ordered(log_user(spark, folder))
    return seq.select(
        "case_id", "t", F.create_map(F.lit("value"), F.col("value"), F.lit("prefix_len"), F.col("t").cast("double")).alias("state_features"),
        F.lit(0).alias("action_recommended"), (F.col("activity") == "purchase").cast("int").alias("action_executed"),
        F.lit("surrogate").alias("source"), F.col("value").alias("reward"),
        # the outcome of a user is known one event before the log ends
        (F.col("t") >= F.col("n_events") - 1).alias("done"), "timestamp")


def states(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("state_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").alias("cluster"))
