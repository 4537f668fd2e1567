"""Cleaning an event log: projection, filters, imputation, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite
from ..plans.ranking import global_rank, percentiles
from ..plans.sequence import ordered

CASE, ACTIVITY, TIME = "case_id", "activity", "timestamp"


#: A time of day followed by Z, an offset, or the name of a zone.
ZONED = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?|\[?[A-Za-z]+/[A-Za-z_/]+\]?)\s*$"
#: The features that a request must have.
REQUEST_FEATURES = ("amount", "est_quality", "unc_quality", "cum_cost", "elapsed_time", "prefix_len")


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Apply ``{standard: original}``; originals that are missing are ignored."""
    return df.withColumnsRenamed({orig: std for std, orig in mapping.items() if orig in df.columns and orig != std})


def parse_timestamps(
    df: DataFrame, col: str = TIME, tz_in: str | None = None, tz_out: str | None = "UTC", fmt: str | None = None
) -> DataFrame:
    """Strings to timestamps, bad values to NULL; times without a zone are read in ``tz_in``.

    A string that names its zone or offset is an instant already, and so is a timestamp column; both
    stay as they are. timestamp_ntz columns are times without a zone. ``tz_out`` never moves the
    instant: a zone only says how it is to be shown, None drops it and gives the wall clock in UTC
    (timestamp_ntz).
    """
    kind = dict(df.dtypes)[col]
    text = F.col(col)
    naive = F.lit(kind == "timestamp_ntz")
    if kind == "string":
        ts = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
        naive = ~F.coalesce(text.rlike(ZONED), F.lit(False))
    else:
        ts = text.cast("timestamp")
    if tz_in and tz_in != "UTC":
        ts = F.when(naive, F.to_utc_timestamp(ts, tz_in)).otherwise(ts)
    if tz_out is None:
        ts = ts.cast("timestamp_ntz")
    return df.withColumn(col, ts)


def filter_lifecycle(df: DataFrame, keep: Sequence[str], col: str = "lifecycle") -> DataFrame:
    """Keep events whose lifecycle is listed (any case); no-op when the column is absent."""
    if col not in df.columns:
        return df
    return df.where(F.lower(F.col(col)).isin([k.lower() for k in keep]))


def encode_case_ids(df: DataFrame, case: str = CASE, out: str = CASE) -> DataFrame:
    """Dense ids 0..n-1 in string order for non-integer case ids; integers pass through."""
    if dict(df.dtypes)[case] in ("int", "bigint", "smallint", "tinyint"):
        return df if out == case else df.withColumn(out, F.col(case))
    ids = global_rank(df.where(F.col(case).isNotNull()).select(case).distinct(), [case], "_rank")
    joined = df.join(ids, case, "left")
    dense = (F.col("_rank") - 1).cast("long")
    return joined.withColumn(out, dense).drop("_rank")


def select_columns(df: DataFrame, wanted: Sequence[str], always: Sequence[str] = ("outcome",)) -> DataFrame:
    names = [c for c in wanted if c in df.columns]
    return df.select(*names, *[c for c in always if c in df.columns and c not in names])


def sort_for_write(df: DataFrame, order: Sequence[str] = (TIME, ACTIVITY), case: str = CASE, partitions: int | None = None) -> DataFrame:
    """Canonical at-rest order. Range partitioning on the whole key also splits a hot case."""
    keys = [case, *order]
    placed = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return placed.sortWithinPartitions(*keys)


def drop_duplicate_events(
    df: DataFrame, keys: Sequence[str] = (CASE, ACTIVITY, TIME), tie: str = "event_id"
) -> DataFrame:
    """Keep the first event per key. The rank limit of one runs before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def schema_violations(df: DataFrame, required: Sequence[str] = (CASE, ACTIVITY, TIME)) -> DataFrame:
    """Long table (check, column_name, n): missing columns, nulls, empty log, no cases."""
    present = [c for c in required if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in present]
    one = df.agg(*aggs)
    items = [
        F.struct(F.lit("missing_column").alias("check"), F.lit(c).alias("column_name"),
                 F.lit(0 if c in present else 1).cast("long").alias("n"))
        for c in required
    ]
    items += [F.struct(F.lit("null_values").alias("check"), F.lit(c).alias("column_name"), F.col(f"_null_{c}").alias("n")) for c in present]
    items += [F.struct(F.lit("empty_log").alias("check"), F.lit("*").alias("column_name"),
                       (F.col("_rows") == 0).cast("long").alias("n"))]
    if CASE in present:
        items += [F.struct(F.lit("no_cases").alias("check"), F.lit(CASE).alias("column_name"),
                           (F.col("_rows") == F.col(f"_null_{CASE}")).cast("long").alias("n"))]
    return one.select(F.explode(F.array(*items)).alias("v")).select("v.*")


def require_valid(df: DataFrame, required: Sequence[str] = (CASE, ACTIVITY, TIME)) -> DataFrame:
    """Raise when a minimum-schema check fails; otherwise return the log."""
    bad = schema_violations(df, required).where("n > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}({r['column_name']})={r['n']}" for r in bad))
    return df


def schema_differences(df: DataFrame, expected: T.StructType) -> DataFrame:
    """(column_name, expected, actual) for required columns that are absent or differ in type."""
    actual = dict(df.dtypes)
    rows = [
        (f.name, f.dataType.simpleString(), actual.get(f.name))
        for f in expected.fields
        if actual.get(f.name) != f.dataType.simpleString()
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, actual string")


def filter_case_length(df: DataFrame, min_events: int | None = None, max_events: int | None = None, case: str = CASE) -> DataFrame:
    """Keep cases with a number of events in range: partial counts, then a semi join."""
    n = F.col("_n")
    ok = F.lit(True)
    if min_events is not None:
        ok = ok & (n >= min_events)
    if max_events is not None:
        ok = ok & (n <= max_events)
    good = df.groupBy(case).agg(F.count(F.lit(1)).alias("_n")).where(ok).select(case)
    return df.join(good, case, "left_semi")


def drop_incomplete_cases(
    df: DataFrame, terminal: Sequence[str], order: Sequence[str] = (TIME, ACTIVITY, "event_id"), case: str = CASE
) -> DataFrame:
    """Keep cases whose last activity is terminal. ``max_by`` pre-aggregates, so no case is gathered."""
    last = df.groupBy(case).agg(F.max_by(ACTIVITY, F.struct(*order)).alias("_last"))
    return df.join(last.where(F.col("_last").isin(list(terminal))).select(case), case, "left_semi")


def impute_numeric(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> DataFrame:
    """Fill numeric NULLs with one median / mean / zero per column."""
    fills: dict[str, Column] = {}
    if strategy == "mean":
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("s")).scalar()
        fills = {c: means.getField(c) for c in cols}
    for c in cols:
        if strategy == "median":
            fills[c] = percentiles(df, c, {"m": 0.5}).select("m").scalar()
        elif strategy == "zero":
            fills[c] = F.lit(0.0)
        elif strategy != "mean":
            raise ValueError(f"unknown strategy {strategy!r}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fills[c]) for c in cols})


def normalize_numeric(df: DataFrame, cols: Sequence[str], method: str = "zscore", suffix: str = "") -> DataFrame:
    """z-score (population) or min-max scaling; a constant column maps to 0."""
    if method == "zscore":
        pieces = [F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b")).alias(c) for c in cols]
    elif method == "minmax":
        pieces = [F.struct(F.min(c).cast("double").alias("a"), (F.max(c) - F.min(c)).cast("double").alias("b")).alias(c) for c in cols]
    else:
        raise ValueError(f"unknown method {method!r}")
    stats = df.agg(F.struct(*pieces).alias("s")).scalar()
    out = {}
    for c in cols:
        a, b = stats.getField(c).getField("a"), stats.getField(c).getField("b")
        scaled = F.try_divide(F.col(c) - a, b)
        out[c + suffix] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.coalesce(scaled, F.lit(0.0)))
    return df.withColumns(out)


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Long table (column_name, lo, hi, n_checked, n_below, n_above)."""
    aggs = []
    for c, (lo, hi) in ranges.items():
        aggs += [F.count(c).alias(f"{c}__n"), F.count_if(F.col(c) < lo).alias(f"{c}__b"), F.count_if(F.col(c) > hi).alias(f"{c}__a")]
    one = df.agg(*aggs)
    items = [
        F.struct(F.lit(c).alias("column_name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                 F.col(f"{c}__n").alias("n_checked"), F.col(f"{c}__b").alias("n_below"), F.col(f"{c}__a").alias("n_above"))
        for c, (lo, hi) in ranges.items()
    ]
    return one.select(F.explode(F.array(*items)).alias("v")).select("v.*")


def filter_day(df: DataFrame, day: str, col: str = TIME) -> DataFrame:
    """One calendar day as a half-open range that reaches the scan."""
    start = F.to_timestamp(F.lit(day))
    return df.where((F.col(col) >= start) & (F.col(col) < start + F.expr("INTERVAL 1 DAY")))


def filter_split(df: DataFrame, splits: DataFrame, name: str, case: str = CASE) -> DataFrame:
    """Rows whose case belongs to one split."""
    return df.join(splits.where(F.col("split") == name).select(case), case, "left_semi")


def request_errors(df: DataFrame, required: Sequence[str] = REQUEST_FEATURES) -> DataFrame:
    """Add ``errors``: one code per failed rule on the request features.

    A required feature that is no column at all is an error of every request. Activity counts may be
    absent or NULL, but not negative.
    """
    non_negative = ["amount", "cum_cost", "elapsed_time", "t"]
    unit = ["est_quality", "unc_quality"]
    positive = ["prefix_len"]
    bad: list[Column] = [F.lit(f"{c}:missing") for c in required if c not in df.columns]
    bad += [F.when(F.col(c) < 0, F.lit(f"{c}:negative")) for c in sorted(c for c in df.columns if c.startswith("count_"))]
    for c in (c for c in non_negative + unit + positive if c in df.columns):
        x = F.col(c).cast("double")
        odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        bad.append(F.when(odd, F.lit(f"{c}:not_finite")))
        if c in non_negative:
            bad.append(F.when(~odd & (x < 0), F.lit(f"{c}:negative")))
        elif c in unit:
            bad.append(F.when(~odd & ~x.between(0.0, 1.0), F.lit(f"{c}:outside_0_1")))
        else:
            bad.append(F.when(~odd & (x < 1), F.lit(f"{c}:below_1")))
    return df.withColumn("errors", F.array_compact(F.array(*bad)))


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def time_deltas(log: DataFrame, order: Sequence[str] = (TIME, ACTIVITY, "event_id"), out: str = "delta_t") -> DataFrame:
    """Seconds since the previous event of the case; NULL on the first."""
    seq = ordered(log, order, lag={"_prev": F.col(TIME)})
    return seq.withColumn(out, F.unix_timestamp(TIME) - F.unix_timestamp("_prev")).drop("_prev")
