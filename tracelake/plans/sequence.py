"""Ordered per-case computation that survives one case holding a third of the log.

``ordered`` gives every event its position, neighbours, running sums, recent history and case
totals. On an ordinary log that is one exchange and one sort on the case key. ``segment_cases``
cuts oversized cases into ordered segments first; windows then run per (case, segment) and the
segment summaries carry positions, sums and edge events across the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import last_n
from ..session import stored
from .sizing import dimension

SEGMENT = "_segment"
WHOLE = -1  # segment number of cases that are not cut


#: Sampled events per segment that cut points are taken from.
SAMPLED = 16


def segment_cases(
    log: DataFrame,
    case: str = "case_id",
    time: str = "timestamp",
    max_rows: int = 1_000_000,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add a segment number to the log when some case exceeds ``max_rows`` events.

    Case sizes come from a partial aggregate over the key column alone. Every oversized case is cut; there
    are at most events / ``max_rows`` of them, and their tables are broadcast only while they are small. Cut points lie in the
    order of events: by default time, activity and event id as far as the log has them, so events of one
    time spread as well. They are taken from a hash sample of about ``SAMPLED`` events per segment, stored once so that
    all readers agree on them. Only events that agree in the whole order stay together.
    A log without oversized cases is returned unchanged.
    """
    order = list(order) if order else [time, *[c for c in ("activity", "event_id") if c in log.columns and c != time]]
    at = F.struct(*order)
    sizes = log.groupBy(case).agg(F.count(F.lit(1)).alias("_n"))
    big = stored(sizes.where(F.col("_n") > max_rows))
    largest = big.agg(F.max("_n")).first()[0]
    if largest is None:
        return log
    pieces = -(-largest // max_rows)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(1), case, *order), 11) / F.lit(float(1 << 53)) < F.lit(min(1.0, SAMPLED / max_rows))
    cuts = (
        log.where(drawn).join(dimension(big), case)
        .groupBy(case)
        # SAMPLED events for each segment of the case
        .agg(F.ceil(F.first("_n") / max_rows).cast("int").alias("_pieces"), F.sort_array(F.collect_list(at)).alias("_sample"))
        .select(case, F.array_sort(F.array_distinct(F.expr(
            "transform(sequence(1, greatest(_pieces - 1, 1)), i -> _sample[cast(cast(i as bigint) * size(_sample) / _pieces as int)])"))).alias("_cuts"))
    )
    cuts = dimension(cuts)
    found = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(int(pieces).bit_length(), -1, -1)]),
        F.lit(0),
        lambda n, step: F.when(
            (n + step <= F.size("_cuts")) & (F.get(F.col("_cuts"), n + step - 1) < at), n + step
        ).otherwise(n),
    )
    return (
        log.join(cuts, case, "left")
        .withColumn(SEGMENT, F.when(F.col("_cuts").isNull(), F.lit(WHOLE)).otherwise(found))
        .drop("_cuts")
    )


def ordered(
    log: DataFrame,
    order: Sequence[str] = ("timestamp", "activity", "event_id"),
    case: str = "case_id",
    *,
    lead: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    history: Mapping[str, tuple[Column, int]] | None = None,
    totals: Mapping[str, tuple[str, Column]] | None = None,
    position: str = "t",
    count: str = "n_events",
) -> DataFrame:
    """Add position, case size, neighbours, running sums, bounded history and case totals.

    ``lead``/``lag`` map a new column to an expression of the neighbouring event, ``running`` to a
    number summed up to and including the event, ``history`` to (expression, n) for the last n
    values, ``totals`` to (fold, expression) over the whole case; the folds are sum, max, min and last,
    the last non-null value in event order.
    """
    lead, lag, running = dict(lead or {}), dict(lag or {}), dict(running or {})
    history, totals = dict(history or {}), dict(totals or {})
    at = F.struct(*order)
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at))}
    if SEGMENT in log.columns:
        return _ordered_segments(log, order, case, lead, lag, running, history, totals, position, count, fold)
    w = Window.partitionBy(case).orderBy(*order)
    whole = Window.partitionBy(case)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cols: dict[str, Column] = {position: F.row_number().over(w).cast("long"), count: F.count(F.lit(1)).over(whole)}
    cols |= {k: F.lead(c).over(w) for k, c in lead.items()}
    cols |= {k: F.lag(c).over(w) for k, c in lag.items()}
    cols |= {k: F.sum(c).over(upto) for k, c in running.items()}
    cols |= {k: F.collect_list(c).over(w.rowsBetween(-(n - 1), 0)) for k, (c, n) in history.items()}
    cols |= {k: fold[how](c).over(whole) for k, (how, c) in totals.items()}
    return log.withColumns(cols)


def _ordered_segments(log, order, case, lead, lag, running, history, totals, position, count, fold) -> DataFrame:
    key = [case, SEGMENT]
    w = Window.partitionBy(*key).orderBy(*order)
    segment = Window.partitionBy(*key)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own: dict[str, Column] = {"_pos": F.row_number().over(w), "_size": F.count(F.lit(1)).over(segment)}
    own |= {f"_v_{k}": c for k, c in [*lead.items(), *lag.items()]}
    own |= {f"_lead_{k}": F.lead(c).over(w) for k, c in lead.items()}
    own |= {f"_lag_{k}": F.lag(c).over(w) for k, c in lag.items()}
    own |= {f"_run_{k}": F.sum(c).over(upto) for k, c in running.items()}
    own |= {f"_hist_{k}": F.collect_list(c).over(w.rowsBetween(-(n - 1), 0)) for k, (c, n) in history.items()}
    own |= {f"_tot_{k}": fold[how](c).over(segment) for k, (how, c) in totals.items()}
    rows = log.withColumns(own)

    # summaries of cut cases only; the filter is on a partition key, so it runs before the exchange
    pos = F.col("_pos")
    aggs = [F.first("_size").alias("_s")]
    aggs += [F.min_by(F.col(f"_v_{k}"), pos).alias(f"_head_{k}") for k in lead]
    aggs += [F.max_by(F.col(f"_v_{k}"), pos).alias(f"_tail_{k}") for k in lag]
    aggs += [F.max_by(F.col(f"_run_{k}"), pos).alias(f"_sum_{k}") for k in running]
    aggs += [F.max_by(F.col(f"_hist_{k}"), pos).alias(f"_recent_{k}") for k in history]
    aggs += [F.first(f"_tot_{k}").alias(f"_part_{k}") for k in totals]
    parts = rows.where(F.col(SEGMENT) != WHOLE).groupBy(*key).agg(*aggs)

    # one row per segment of ``max_rows`` events: these windows run over summaries, not events.
    by_seg = Window.partitionBy(case).orderBy(SEGMENT)
    before = by_seg.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(case)
    carry: dict[str, Column] = {"_offset": F.coalesce(F.sum("_s").over(before), F.lit(0)), "_total": F.sum("_s").over(whole)}
    carry |= {f"_c_lead_{k}": F.lead(f"_head_{k}").over(by_seg) for k in lead}
    carry |= {f"_c_lag_{k}": F.lag(f"_tail_{k}").over(by_seg) for k in lag}
    carry |= {f"_c_run_{k}": F.sum(f"_sum_{k}").over(before) for k in running}
    for k, (_, n) in history.items():
        if n > 1:
            earlier = by_seg.rowsBetween(-(n - 1), -1)
            carry[f"_c_hist_{k}"] = last_n(F.flatten(F.collect_list(f"_recent_{k}").over(earlier)), n - 1)
    carry |= {f"_c_tot_{k}": (F.max_by(F.col(f"_part_{k}"), F.when(F.col(f"_part_{k}").isNotNull(), F.col(SEGMENT))) if how == "last" else fold[how](f"_part_{k}")).over(whole) for k, (how, _) in totals.items()}
    carried = parts.select(*key, *[c.alias(k) for k, c in carry.items()])

    # rows are already placed by (case, segment), so only the summaries move for this join
    out = rows.join(carried, key, "left")
    cut = F.col(SEGMENT) != WHOLE
    cols: dict[str, Column] = {
        position: (F.coalesce(F.col("_offset"), F.lit(0)) + pos).cast("long"),
        count: F.coalesce(F.col("_total"), F.col("_size")),
    }
    for k in lead:
        cols[k] = F.when(cut & (pos == F.col("_size")), F.col(f"_c_lead_{k}")).otherwise(F.col(f"_lead_{k}"))
    for k in lag:
        cols[k] = F.when(cut & (pos == 1), F.col(f"_c_lag_{k}")).otherwise(F.col(f"_lag_{k}"))
    for k in running:
        mine, earlier = F.col(f"_run_{k}"), F.col(f"_c_run_{k}")
        cols[k] = F.when(mine.isNull() & earlier.isNull(), F.lit(None)).otherwise(F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0)))
    for k, (_, n) in history.items():
        mine, earlier = F.col(f"_hist_{k}"), F.col(f"_c_hist_{k}") if n > 1 else None
        cols[k] = F.when(earlier.isNull(), mine).otherwise(last_n(F.concat(earlier, mine), n)) if n > 1 else mine
    for k in totals:
        cols[k] = F.when(cut, F.col(f"_c_tot_{k}")).otherwise(F.col(f"_tot_{k}"))
    names = [*log.columns, *cols]
    return out.withColumns(cols).select(*[n for n in names if n != SEGMENT])
