"""Ordered totals over values without sorting a whole group in one task.

Rows are first reduced to one per distinct value and stored. A quantile summary, which tasks build and Spark merges, cuts the
values into ranges that hold about equally many of these rows, whatever their distribution. The running total inside a
range is a small window, and what lies below the range comes from a table with one row per range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardflow.functions.search import edges_below
from hazardflow.operators.ranges import stored

RANGE_ROWS = 500_000
MOST_RANGES = 4096
# Error of a rank in the summary, as a part of a range.
SHARPNESS = 10


def range_edges(rows: DataFrame, columns: list[str], n: int) -> dict[str, list[float]]:
    """Cut points of each column at equal shares of its rows; all columns in one pass.

    Repeated cut points (a value with several shares) count once; an empty column has none.
    """
    if n < 2 or not columns:
        return {c: [] for c in columns}
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, SHARPNESS * n) for c in columns]).first()
    return {c: sorted({v for v in found or [] if not math.isnan(v)}) for c, found in zip(columns, row)}


def ranges_for(rows: int, range_rows: int = RANGE_ROWS) -> int:
    return max(1, min(MOST_RANGES, -(-rows // range_rows)))


def running_totals(
    counted: DataFrame, keys: list[str], value: str, weights: list[str], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Add ``cum_<weight>`` and ``all_<weight>``: weight at values up to the row's own, and in all, per key.

    ``counted`` has one row per key and value; it is stored first, and read again to find the ranges.
    """
    counted = stored(counted, "counted")
    edges = range_edges(counted, [value], ranges_for(counted.count(), range_rows))[value]
    return totals_in_ranges(counted.withColumn("_range", edges_below(F.col(value).cast("double"), edges)), keys, value, weights)


def totals_in_ranges(ranged: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """``running_totals`` of rows whose ``_range`` grows with the value inside a key."""
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    below = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce("_range", F.lit(-1)).alias("_range"),
        *[F.coalesce(F.sum(f"_t_{w}").over(below), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"all_{w}") for w in weights],
    )
    so_far = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("_range", F.coalesce("_range", F.lit(-1)))
    rows = rows.withColumns({f"_r_{w}": F.sum(w).over(so_far) for w in weights})
    joined = rows.join(offsets, [*keys, "_range"], "left")
    return joined.withColumns({f"cum_{w}": F.col(f"_o_{w}") + F.col(f"_r_{w}") for w in weights}).drop(
        "_range", *[f"{p}{w}" for w in weights for p in ("_o_", "_r_")]
    )


def value_at(share: float, value: str, weight: str, rounding) -> Column:
    """The value at a rounded rank of ``running_totals`` rows: the smallest one whose running weight passes it."""
    position = rounding(F.lit(share) * (F.col(f"all_{weight}") - 1))
    return F.min(F.when(F.col(f"cum_{weight}") > position, F.col(value)))


def quantile_aggregates(value: str, weight: str, quantiles: tuple[float, ...]) -> list[Column]:
    """What a group of ``running_totals`` rows must keep for ``interpolated``."""
    return [
        F.max(f"all_{weight}").alias("_size"),
        *[value_at(q, value, weight, F.floor).alias(f"_lo{i}") for i, q in enumerate(quantiles)],
        *[value_at(q, value, weight, F.ceil).alias(f"_hi{i}") for i, q in enumerate(quantiles)],
    ]


def interpolated(quantiles: tuple[float, ...]) -> list[Column]:
    """Columns ``p50`` and so on, linear between the neighbouring ranks."""

    def between(i: int, q: float) -> Column:
        position = F.lit(q) * (F.col("_size") - 1)
        share = position - F.floor(position)
        return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share

    return [between(i, q).alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)]


def exact_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles per key, columns ``p50`` and so on."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, keys, value, ["_n"], range_rows)
    found = ranked.groupBy(*keys).agg(*quantile_aggregates(value, "_n", quantiles))
    return found.select(*keys, *interpolated(quantiles))


def column_quantiles(
    rows: DataFrame, columns: list[str], quantiles: tuple[float, ...], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Exact quantiles of several columns at once: one row per column (``name``, ``p25`` and so on), none for an empty one.

    Every column has ranges of its own, from one pass over all of them.
    """
    entries = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]
    long = rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("value is not null")
    counted = stored(long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("_n")), "counted")
    n = ranges_for(counted.count(), range_rows)
    wide = counted.select(*[F.when(F.col("name") == c, F.col("value")).alias(f"_{i}") for i, c in enumerate(columns)])
    edges = range_edges(wide, wide.columns, n)
    place = F.lit(None).cast("int")
    for i, c in enumerate(columns):
        place = F.when(F.col("name") == c, edges_below(F.col("value"), edges[f"_{i}"])).otherwise(place)
    ranked = totals_in_ranges(counted.withColumn("_range", place), ["name"], "value", ["_n"])
    found = ranked.groupBy("name").agg(*quantile_aggregates("value", "_n", quantiles))
    return found.select("name", *interpolated(quantiles))
