"""Time chunks: ordered work on a key of any size without sorting the whole key in one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends all rows of a key to one task, and a key may hold a
third of the table. The operators built on this module cut each key's timeline into fixed slices, run the
row-level window inside ``(key, slice)``, and carry what the earlier slices contribute through a grouped
table with one row per slice. The grouped table grows with time, not with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from hazardflow.functions.times import MICROS, chunk, micros

CHUNK = "_chunk"
TIME = "_us"
HOUR = 3600
WIDTHS = [1, 5, 10, 60, 300, 900, HOUR]  # all divide an hour


def with_chunks(df: DataFrame, ts: str, seconds: int = HOUR) -> DataFrame:
    """Add the microsecond time and the slice number."""
    return df.withColumn(TIME, micros(F.col(ts))).withColumn(CHUNK, chunk(F.col(TIME), seconds))


def suggest_seconds(df: DataFrame, ts: str, rows_per_chunk: int = 4_000_000) -> int:
    """The widest slice that holds about ``rows_per_chunk`` rows at most if one key held every row.

    One aggregate over the time column; call it once per table and pass the result to the operators.
    """
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.min(micros(F.col(ts))).alias("lo"), F.max(micros(F.col(ts))).alias("hi")
    ).first()
    span = max(((row["hi"] or 0) - (row["lo"] or 0)) / MICROS, 1.0)
    fitting = [w for w in WIDTHS if row["n"] * w / span <= rows_per_chunk]
    return max(fitting, default=WIDTHS[0])


def in_chunk(keys: list[str], *order: Column) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def earlier_chunks(keys: list[str]) -> WindowSpec:
    """All earlier slices of a key; use it on the grouped table only."""
    return _slices(keys, F.col(CHUNK).asc()).rowsBetween(Window.unboundedPreceding, -1)


def later_chunks(keys: list[str]) -> WindowSpec:
    """All later slices of a key; use it on the grouped table only."""
    return _slices(keys, F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)


def _slices(keys: list[str], order: Column) -> WindowSpec:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)


def attach(rows: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Join the grouped table back on ``(keys, slice)``.

    Plain equality, so that the join reuses the partitioning of the row-level window; keys must not be null.
    """
    return rows.join(grouped, [*keys, CHUNK], "left")
