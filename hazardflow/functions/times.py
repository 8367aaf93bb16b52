"""Time helpers. Batch operators order by microseconds, which both time types convert to exactly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; wall-clock times are read as UTC (the session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def chunk(time_us: Column, seconds: int) -> Column:
    """Index of the fixed time slice a microsecond time falls in."""
    return F.floor(time_us / F.lit(seconds * MICROS)).cast("bigint")


def round_half_up(value: Column, digits: int) -> Column:
    """Round by ``floor(x * 10^d + 0.5) / 10^d`` so that every engine rounds the same way."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale
