"""Case state in a stream: single events in, the features and the prefix after every event out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.clean import ACTIVITY, CASE, TIME
from ..session import reach_workers

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State rows are kept as Arrow bytes, one value per shard and batch: Spark hands values over one at a time.
STATE = "rows binary"
WAITING = pa.schema({"case": pa.string(), "at": pa.int64(), "activity": pa.string(), "event_id": pa.int64(), "token_id": pa.int32(), "numbers": pa.list_(pa.float64())})
PROGRESS = pa.schema({"case": pa.string(), "t": pa.int64(), "start": pa.int64(), "last": pa.int64(), "counts": pa.list_(pa.int64()), "tokens": pa.list_(pa.int32())})


def packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    """Rows as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema))
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> Iterator[tuple]:
    table = pa.ipc.open_stream(bytes(data)).read_all()
    return zip(*(column.to_pylist() for column in table.columns), strict=True)


@dataclass(frozen=True)
class CaseStream:
    """What is kept of a case: ``counted`` activities, ``numeric`` columns, the last ``max_len`` token ids.

    Events wait for ``delay``, and a case is forgotten ``idle_seconds`` after its last event. Cases are dealt to
    ``shards`` by hash, whose state is read and written at once; their number stays for the life of a checkpoint.
    """

    numeric: tuple[str, ...] = ()
    counted: tuple[str, ...] = ()
    max_len: int = 50
    delay: str = "1 hour"
    idle_seconds: int = 30 * 86_400
    shards: int = 1024


class CaseProcessor(StatefulProcessor):
    """Events wait in the list of their shard until the watermark has passed them, then join their cases in event order.

    A timer at the earliest waiting event releases what may no longer be preceded, for all cases of the shard at
    once; one at the first end of an idle case evicts it. State per case is its waiting events, one counter per counted
    activity and ``max_len`` ids.
    """

    def __init__(self, spec: CaseStream):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STATE)
        self.progress = handle.getValueState("progress", STATE)
        self.released = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            # batches are bounded; objects, because NULL integers would turn into doubles
            events = [(c, int(at), a, None if pd.isna(e) else int(e), int(i), [float(x) for x in n])
                      for c, at, a, e, i, n in zip(pdf["case"], pdf["micros"], pdf[ACTIVITY].astype(object).where(pdf[ACTIVITY].notna(), None), pdf["event_id"], pdf["token_id"], pdf["numbers"], strict=True)
                      if not pd.isna(c)]  # a heartbeat only moves the watermark
            if not events:
                continue
            self.waiting.appendValue((packed(events, WAITING),))
            earliest = min(e[1] for e in events)
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.released:
            return  # by another timer of this batch; no rows come after the first of them
        self.released.add(key)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [event for value in self.waiting.get() for event in unpacked(value[0])] if self.waiting.exists() else []
        ready = sorted((e for e in waiting if e[1] <= passed), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or "", e[3] is not None, e[3] or 0))
        later = [e for e in waiting if e[1] > passed]
        states = {case: state for case, *state in unpacked(self.progress.get()[0])} if self.progress.exists() else {}
        out = []
        for case, at, activity, event_id, token, numbers in ready:
            t, start, _, counts, tokens = states.get(case) or (0, at, 0, [0] * len(self.spec.counted), [])
            counts = [n + (activity == name) for n, name in zip(counts, self.spec.counted, strict=True)]
            tokens = [*tokens, token][-self.spec.max_len:]
            states[case] = [t + 1, start, at, counts, tokens]
            out.append((case, t + 1, at, activity, event_id, list(numbers), float(t + 1), (at - start) / 86_400_000_000.0, [float(n) for n in counts], tokens))
        if out:
            yield pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in zip(COLUMNS, zip(*out, strict=True), strict=True)})
        more = {e[0] for e in later}
        ends = {case: state[2] // 1000 + self.spec.idle_seconds * 1000 for case, state in states.items() if case not in more}
        kept = [(case, *state) for case, state in states.items() if case in more or ends[case] * 1000 > passed]
        if ready and later:
            self.waiting.put([(packed(later, WAITING),)])
        elif ready:
            self.waiting.clear()
        if kept and (ready or len(kept) < len(states)):
            self.progress.update((packed(kept, PROGRESS),))
        elif not kept:
            self.progress.clear()
        due = [e[1] // 1000 + 1 for e in later] + [end + 1 for end in ends.values() if end * 1000 > passed]
        if due:
            self.handle.registerTimer(min(due))

    def close(self) -> None:
        pass


COLUMNS = ("case", "t", "micros", ACTIVITY, "event_id", "numbers", "prefix_len", "elapsed_time", "counts", "tokens")


def case_stream(events: DataFrame, spec: CaseStream) -> DataFrame:
    """One row per event, in the order of time, activity and event id within its case, as the batch features have it.

    ``events`` is a stream with case_id, activity, timestamp, event_id, token_id (see ``encode_tokens``) and
    the numeric columns; it may be up to ``delay`` out of order. Later rows are dropped and counted by the query's progress.
    A row with a NULL case is a heartbeat: it moves the watermark and releases events without being
    one itself. Rows without time are dropped. Events of an evicted case start a new prefix.
    """
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in spec.numeric]).cast("array<double>")
    kind = events.schema[CASE].dataType
    case = F.col(CASE).cast("string")
    rows = events.where(F.col(TIME).isNotNull()).select(
        F.pmod(F.xxhash64(case), F.lit(spec.shards)).cast("int").alias("shard"), case.alias("case"), TIME, F.unix_micros(TIME).alias("micros"), ACTIVITY, F.col("event_id").cast("long").alias("event_id"), F.coalesce("token_id", F.lit(1)).alias("token_id"), numbers.alias("numbers"))
    schema = T.StructType.fromDDL(
        "case string, t long, micros long, activity string, event_id long, numbers array<double>, prefix_len double, elapsed_time double, counts array<double>, tokens array<int>")
    found = rows.withWatermark(TIME, spec.delay).groupBy("shard").transformWithStateInPandas(CaseProcessor(spec), schema, "append", "eventTime")
    return found.select(
        F.col("case").cast(kind).alias(CASE), "t", F.timestamp_micros("micros").alias(TIME), ACTIVITY, "event_id", *[F.col("numbers")[i].alias(c) for i, c in enumerate(spec.numeric)],
        "prefix_len", "elapsed_time", *[F.col("counts")[i].alias(f"count_{a}") for i, a in enumerate(spec.counted)], "tokens")


@contextmanager
def setting(spark: SparkSession, **conf: str | None) -> Iterator[None]:
    """Settings that a query reads when it starts; the session's own come back afterwards."""
    names = {k.replace("__", "."): v for k, v in conf.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_cases(events: DataFrame, spec: CaseStream, path: str, checkpoint: str, partitions: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Append case rows as Parquet. ``partitions`` fixes the number of state stores for the life of the checkpoint."""
    spark = events.sparkSession
    reach_workers(spark)
    writer = case_stream(events, spec).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    with setting(spark, spark__sql__streaming__stateStore__providerClass=PROVIDER, spark__sql__shuffle__partitions=None if partitions is None else str(partitions)):
        return (writer.trigger(availableNow=True) if available_now else writer).start()
