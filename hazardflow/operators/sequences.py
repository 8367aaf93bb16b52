"""Sensor sequences: hourly bins, 24-step histories and escalation labels per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardflow import dims


def hourly_bins(
    events: DataFrame,
    key: str,
    types: list[str],
    type_column: str = "event_type",
    value: str = "value",
    rank: str = "severity_rank",
    ts: str = "ts",
) -> DataFrame:
    """Fifteen readings per key and hour on an hour grid without holes.

    The key's count, sum, average, minimum and maximum, then the count and the average per type over all keys
    in that hour. Hours without data read 0. Five types make the full width. The grid spans each key's
    first to last hour, so it grows with keys and time and not with rows.
    """
    hour = F.date_trunc("hour", F.col(ts)).alias("hour")
    own = events.groupBy(key, hour).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.max(rank).alias("top_rank"),
    )
    per_type = events.groupBy(hour).agg(
        *[F.count_if(F.col(type_column) == t).alias(f"type_n{i}") for i, t in enumerate(types)],
        *[F.avg(F.when(F.col(type_column) == t, F.col(value))).alias(f"type_avg{i}") for i, t in enumerate(types)],
    )
    spans = own.groupBy(key).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = spans.select(key, F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    joined = grid.join(own, [key, "hour"], "left").join(per_type, "hour", "left")
    readings: dict[str, Column] = {
        "r_count": F.col("n"),
        "r_sum": F.col("total"),
        "r_avg": F.col("total") / F.col("n"),
        "r_min": F.col("low"),
        "r_max": F.col("high"),
        **{f"r_type_n{i}": F.col(f"type_n{i}") for i in range(len(types))},
        **{f"r_type_avg{i}": F.col(f"type_avg{i}") for i in range(len(types))},
    }
    filled = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in readings.items()]
    return joined.select(key, "hour", *filled, F.coalesce("top_rank", F.lit(0)).alias("top_rank"))


def assemble(bins: DataFrame, key: str, steps: int = dims.SEQUENCE_STEPS) -> DataFrame:
    """Add ``sequence`` (oldest step first) and ``n_steps``; fewer than ``steps`` marks a short history."""
    readings = [c for c in bins.columns if c.startswith("r_")]
    past = Window.partitionBy(key).orderBy("hour").rowsBetween(-(steps - 1), 0)
    collected = F.collect_list(F.array(*readings)).over(past)
    return bins.withColumn("sequence", collected).withColumn("n_steps", F.size("sequence").cast("bigint"))


def step_labels(bins: DataFrame, key: str, horizons: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """``y{h}h`` = 1 when a higher rank appears in the next ``h`` hours of the key's grid."""
    order = Window.partitionBy(key).orderBy("hour")
    return bins.withColumns(
        {
            f"y{h}h": F.coalesce((F.max("top_rank").over(order.rowsBetween(1, h)) > F.col("top_rank")).cast("int"), F.lit(0))
            for h in horizons
        }
    )


def full_sequences(sequences: DataFrame, steps: int = dims.SEQUENCE_STEPS) -> DataFrame:
    """Only the rows with a complete history."""
    return sequences.where(F.col("n_steps") == steps)
