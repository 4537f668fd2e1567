"""Readers with explicit schemas; nothing is inferred by a second pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import dimension
from ..session import stored_table

EVENT_SCHEMA = "case_id string, activity string, timestamp string"

# fixed values: record layouts of the two append-only logs and of decision requests
DECISION_SCHEMA = (
    "timestamp timestamp, request_id string, case_id string, t long, action_id int, action_name string, "
    "source string, confidence double, ood boolean, latency_ms double, _corrupt_record string")
FEEDBACK_SCHEMA = (
    "case_id string, t long, state_features map<string,double>, action_recommended int, action_executed int, "
    "source string, reward double, next_state_features map<string,double>, done boolean, timestamp timestamp, _corrupt_record string")
REQUEST_SCHEMA = (
    "request_id string, case_id string, t long, timestamp timestamp, "
    "features struct<amount:double,est_quality:double,unc_quality:double,cum_cost:double,elapsed_time:double,prefix_len:int,"
    "count_validate_application:int,count_skip_contact:int,count_contact_headquarters:int>, "
    "valid_actions array<int>, override struct<action_id:int,action_name:string,reason:string>, _corrupt_record string")
_ATTR = "array<struct<_key:string,_value:string>>"
_KINDS = ("string", "date", "int", "float", "boolean")
XES_SCHEMA = ", ".join(f"{k} {_ATTR}" for k in _KINDS)


def read_csv(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, **options) -> DataFrame:
    """CSV event log with a header."""
    return spark.read.options(header=True, **options).schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_xes(spark: SparkSession, path: str, event_keys: Sequence[str] = ("concept:name", "time:timestamp", "lifecycle:transition"), case_keys: Sequence[str] = ("concept:name",)) -> DataFrame:
    """XES: one row per event, event attributes by key, trace attributes as ``case:<key>``.

    Files are read in blocks and cut at ``<event>``, so a trace of any length is read by several tasks. What stands
    between the end of an event and the next one tells whether a trace begins; the attributes of the latest trace are
    carried down the rows of a block and, through one summary row per block, into the blocks after it. Trace attributes
    stand before the events, as the format has it. An ``<event/>`` without attributes is no event. A .gz file is one block.
    """
    # a record is an event, its end tag and whatever follows up to the next event; the first one is the head of the file
    text = spark.read.option("lineSep", "<event>").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    body, end = F.substring_index("value", "</event>", 1), "</event>"
    is_event = F.contains("value", F.lit(end))
    rest = F.when(is_event, F.expr(f"substring(value, instr(value, '{end}') + {len(end)})")).otherwise(F.col("value"))
    opened = F.element_at(F.split(rest, "<trace(?=[ >])[^>]*>"), -1)

    def parsed(tag: str, inside):
        return F.from_xml(F.concat(F.lit(f"<{tag}>"), inside, F.lit(f"</{tag}>")), XES_SCHEMA)

    cut = text.select(
        "_file", "_block", F.monotonically_increasing_id().alias("_at"), F.when(is_event, parsed("event", body)).alias("e"),
        F.when(F.regexp_like(rest, F.lit("<trace[ >]")), parsed("trace", F.substring_index(opened, "</trace>", 1))).alias("c"))
    records = stored_table(cut)
    block = Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = records.groupBy("_file", "_block").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("_at"))).alias("c"))
    carried = last.select("_file", "_block", F.last("c", ignorenulls=True).over(earlier).alias("before"))
    rows = records.withColumn("_own", F.last("c", ignorenulls=True).over(block)).where(F.col("e").isNotNull())
    rows = rows.join(dimension(carried), ["_file", "_block"]).withColumn("_trace", F.coalesce("_own", "before"))

    def pick(key: str, owner: str):
        found = [F.get(F.filter(F.col(f"{owner}.{k}"), lambda a: a["_key"] == key), F.lit(0)).getField("_value") for k in _KINDS]
        return F.coalesce(*found)

    return rows.select(*[pick(k, "_trace").alias(f"case:{k}") for k in case_keys], *[pick(k, "e").alias(k) for k in event_keys])


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents, one row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_items(spark: SparkSession, path: str, item: str, lines: bool = False) -> DataFrame:
    """Items of ``{"items": [...]}`` documents or bare items; ``item`` is a DDL field list.

    A file is one document or one list of items; with ``lines`` every line is a document or an item, and
    files can be split.
    """
    fields = T.StructType.fromDDL(item)
    schema = T.StructType([T.StructField("items", T.ArrayType(fields)), *fields.fields])
    docs = spark.read.option("multiLine", not lines).schema(schema).json(path)
    # a bare list is read as one row per element; a wrapper document has no item columns
    own = F.array(F.struct(*[F.col(f.name) for f in fields.fields]))
    return docs.select(F.explode(F.coalesce("items", own)).alias("i")).select("i.*")


def read_decisions(spark: SparkSession, path: str, since: str | None = None, streaming: bool = False) -> DataFrame:
    """Decision log lines; blank lines vanish, malformed ones keep their text in ``_corrupt_record``."""
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(DECISION_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.where(F.col("timestamp") >= F.to_timestamp(F.lit(since))) if since else df


def read_feedback(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FEEDBACK_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Decision requests with their features flattened to columns."""
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(REQUEST_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.select("request_id", "case_id", "t", "timestamp", "features.*", "valid_actions", "override", "_corrupt_record")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest): order-insensitive table hash.

    Every row has an MD5 over its values as text (a mark before each value tells NULL from empty); two
    60-bit parts of it are summed as decimals, which cannot overflow.
    """
    values = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]
    h = F.md5(F.concat_ws("\x1f", *values).cast("binary"))
    low, high = (F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 16))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.substring(F.sha2(F.concat_ws(":", low, high), 256), 1, 16).alias("digest"))
