"""What came before and what comes next per hazard key, in time slices (see ``chunks``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hazardflow.functions.times import MICROS
from hazardflow.operators.chunks import (
    CHUNK,
    HOUR,
    TIME,
    attach,
    earlier_chunks,
    in_chunk,
    later_chunks,
    with_chunks,
)


def prior_event_count(
    events: DataFrame,
    keys: list[str],
    ts: str = "ts",
    hours: int = 24,
    chunk_seconds: int = HOUR,
    output: str = "prior_count",
) -> DataFrame:
    """Events of the same key in ``[t - hours, t)`` for each event. The slice width must divide the span.

    The span covers the head of the event's own slice, whole slices, and the tail of the slice ``hours`` ago.
    Each row is sent to its own slice and, shifted by the span and without its other columns, to the slice
    where it leaves the span. There both running counts come out of one window whose frame is always
    "everything before": a sliding frame would be rescanned for every row. Whole slices are counted on the
    grouped table. Rows move once.
    """
    span_us = hours * 3600 * MICROS
    if span_us % (chunk_seconds * MICROS):
        raise ValueError("the slice width must divide the span")
    slices_back = span_us // (chunk_seconds * MICROS)

    timed = with_chunks(events, ts, chunk_seconds)
    whole = timed.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    span = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK).rangeBetween(-slices_back, -1)
    between = whole.select(*keys, CHUNK, F.coalesce(F.sum("_n").over(span), F.lit(0)).alias("_between"))

    entering = F.struct(F.col(TIME).alias("us"), F.col(CHUNK).alias("slice"), F.lit(0).alias("left"))
    leaving = F.struct(
        (F.col(TIME) + F.lit(span_us)).alias("us"), (F.col(CHUNK) + F.lit(slices_back)).alias("slice"), F.lit(1).alias("left")
    )
    own = [c for c in events.columns if c not in keys]
    moved = timed.select(*keys, *own, F.explode(F.array(entering, leaving)).alias("_p")).select(
        *keys,
        *[F.when(F.col("_p.left") == 0, F.col(c)).alias(c) for c in own],
        F.col("_p.us").alias(TIME),
        F.col("_p.slice").alias(CHUNK),
        F.col("_p.left").alias("_left"),
    )
    before = in_chunk(keys, F.col(TIME)).rangeBetween(Window.unboundedPreceding, -1)
    counted = moved.withColumns(
        {
            "_entered": F.coalesce(F.sum(F.lit(1) - F.col("_left")).over(before), F.lit(0)),
            "_gone": F.coalesce(F.sum("_left").over(before), F.lit(0)),
        }
    ).where(F.col("_left") == 0)
    count = F.col("_between") + F.col("_entered") - F.col("_gone")
    joined = attach(counted, between, keys).withColumn(output, count.cast("bigint"))
    return joined.select(*events.columns, output)


def hours_since_last(
    events: DataFrame,
    keys: list[str],
    ts: str = "ts",
    event_id: str = "event_id",
    default: float = 720.0,
    chunk_seconds: int = HOUR,
    output: str = "hours_since_last",
) -> DataFrame:
    """Hours from the key's previous event; the first event of a key takes the default."""
    timed = with_chunks(events, ts, chunk_seconds)
    last = timed.groupBy(*keys, CHUNK).agg(F.max(TIME).alias("_last"))
    carried = last.withColumn("_carried", F.max("_last").over(earlier_chunks(keys))).drop("_last")
    order = in_chunk(keys, F.col(TIME), F.col(event_id))
    rows = attach(timed.withColumn("_prev", F.lag(TIME).over(order)), carried, keys)
    gap = (F.col(TIME) - F.coalesce("_prev", "_carried")) / F.lit(3600.0 * MICROS)
    return rows.withColumn(output, F.coalesce(gap, F.lit(default))).drop("_prev", "_carried", TIME, CHUNK)


def historical_average(
    events: DataFrame,
    keys: list[str],
    rank: str,
    ts: str = "ts",
    event_id: str = "event_id",
    default: float = 2.0,
    chunk_seconds: int = HOUR,
    output: str = "historical_severity_avg",
) -> DataFrame:
    """Mean rank of the key's earlier events, ordered by time and then id."""
    timed = with_chunks(events, ts, chunk_seconds)
    slices = timed.groupBy(*keys, CHUNK).agg(F.sum(rank).alias("_s"), F.count(rank).alias("_n"))
    before = earlier_chunks(keys)
    carried = slices.select(
        *keys,
        CHUNK,
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
    )
    earlier = in_chunk(keys, F.col(TIME), F.col(event_id)).rowsBetween(Window.unboundedPreceding, -1)
    rows = timed.withColumns(
        {
            "_s1": F.coalesce(F.sum(rank).over(earlier), F.lit(0)),
            "_n1": F.count(rank).over(earlier),
        }
    )
    rows = attach(rows, carried, keys)
    count = F.col("_n0") + F.col("_n1")
    mean = (F.col("_s0") + F.col("_s1")).cast("double") / count
    return rows.withColumn(output, F.when(count > 0, mean).otherwise(F.lit(default))).drop(
        "_s0", "_n0", "_s1", "_n1", TIME, CHUNK
    )


def escalation_labels(
    events: DataFrame,
    keys: list[str],
    rank: str,
    ts: str = "ts",
    horizons: tuple[int, ...] = (1, 3, 6),
    chunk_seconds: int = HOUR,
    top_rank: int = 4,
) -> DataFrame:
    """``escalated_{h}h`` = 1 when the key sees a higher rank within ``(t, t + h hours]``.

    For each rank level the next time of an event at or above it is found in one backward pass; every
    horizon is then a comparison, so no frame is scanned per horizon.
    """
    timed = with_chunks(events, ts, chunk_seconds)
    levels = range(2, top_rank + 1)

    def reached(level: int):
        return F.when(F.col(rank) >= F.lit(level), F.col(TIME))

    first = timed.groupBy(*keys, CHUNK).agg(*[F.min(reached(k)).alias(f"_f{k}") for k in levels])
    after = later_chunks(keys)
    carried = first.select(*keys, CHUNK, *[F.min(f"_f{k}").over(after).alias(f"_c{k}") for k in levels])
    # Backward in time, so "unbounded preceding to 1 before" is everything strictly later in the slice.
    strictly_later = (
        Window.partitionBy(*keys, CHUNK).orderBy(F.col(TIME).desc()).rangeBetween(Window.unboundedPreceding, -1)
    )
    rows = timed.withColumns({f"_n{k}": F.min(reached(k)).over(strictly_later) for k in levels})
    rows = attach(rows, carried, keys)
    next_higher = F.lit(None).cast("bigint")
    for k in reversed(levels):
        next_higher = F.when(F.col(rank) == F.lit(k - 1), F.coalesce(f"_n{k}", f"_c{k}")).otherwise(next_higher)
    rows = rows.withColumn("_next", next_higher)
    labels = {
        f"escalated_{h}h": F.coalesce(
            (F.col("_next") - F.col(TIME) <= F.lit(h * 3600 * MICROS)).cast("int"), F.lit(0)
        )
        for h in horizons
    }
    scratch = [f"{p}{k}" for k in levels for p in ("_n", "_c")]
    return rows.withColumns(labels).drop("_next", TIME, CHUNK, *scratch)
