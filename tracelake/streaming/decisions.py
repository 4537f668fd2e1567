"""Decision stream: requests in, guarded decisions out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.distill import Rules
from ..operators.guard import GuardSpec, decide

LOG_COLUMNS = ("timestamp", "request_id", "case_id", "t", "action_id", "action_name", "source", "confidence", "ood")


def decision_stream(requests: DataFrame, rules: Rules, spec: GuardSpec, features: Sequence[str], stats: Column | None = None) -> DataFrame:
    """Accepted decisions in log layout. Row expressions only: no state, no shuffle."""
    decided = decide(requests, rules, spec, features, stats)
    return decided.where("accepted").select(*[c for c in LOG_COLUMNS if c in decided.columns], "reason")


def rejected_stream(requests: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    from ..operators.clean import request_errors

    return request_errors(requests, required).where(F.size("errors") > 0).select("request_id", F.array_join("errors", ",").alias("errors"))


def append_log(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Exactly-once JSON append: the file sink commits each batch once."""
    writer = stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
