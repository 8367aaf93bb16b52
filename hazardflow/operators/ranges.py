"""Sorted ranges: ordered work over keys of any size.

Rows are dealt into ranges of their whole order (key, then place in the key), so a key of any size spreads over as many
ranges as its rows fill, and equal row counts meet in every range. Tasks work through one range in order; what a
range hands on to the next one is a row for each range, not for each key or row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazardflow import session

PART = "_part"
TASK_ROWS = 250_000
SHARES = 16  # a combination of keys that holds most rows is summed up in so many parts first


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, so that a lost executor costs no earlier step."""
    path = session.shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The least ``value`` for each combination of the keys, which may be null and may hold most rows.

    Spark sorts for the least of strings, and a scan's tasks hold as many rows as their files pack. So rows are dealt first, in
    proportion to their number: a task sorts about TASK_ROWS rows however large the table is.
    """
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    share = F.pmod(F.xxhash64(value), F.lit(SHARES)).alias("_share")
    parts = rows.select(*keys, value, share).repartition(tasks, *keys, "_share")
    parts = parts.groupBy(*keys, "_share").agg(F.min(value).alias(value))
    return parts.repartition(tasks, *keys).groupBy(*keys).agg(F.min(value).alias(value))


def dealt(df: DataFrame, order: list[Column | str], purpose: str, parts: int | None = None) -> DataFrame:
    """The rows with the number of their range (``_part``); ranges follow the order. Stored.

    Without ``parts`` the session's shuffle partitions hold, which adaptive execution joins to its advisory size.
    """
    ranged = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    return stored(ranged.withColumn(PART, F.spark_partition_id()), purpose)


def in_order(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The dealt rows again, every range sorted inside one task."""
    return rows.repartition(PART).sortWithinPartitions(PART, *order)


def continued(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges that begin inside a key, with that key: at most one row for each range."""
    key = F.struct(*keys)
    bounds = rows.groupBy(PART).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    before = F.lag("last").over(W.orderBy(PART))
    return bounds.withColumn("before", before).where("before = first").select(PART, "first.*")


def next_above(queries: DataFrame, targets: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """For every query (keys, ``at``, other columns) the least ``value`` of the same key's targets above ``at``, as ``found``.

    Both sides are dealt into ranges of descending values; the last target of a range serves the ranges behind it.
    """
    rest = [c for c in queries.columns if c not in {*keys, "at"}]
    asked = queries.select(*keys, F.col("at").alias("_v"), F.lit(0).alias("_kind"), *rest)
    given = targets.select(*keys, F.col("value").alias("_v"), F.lit(1).alias("_kind"))
    both = asked.unionByName(given, allowMissingColumns=True)
    # At equal values a query comes first: only targets above it count.
    order = [*map(F.col, keys), F.desc("_v"), F.col("_kind")]
    rows = dealt(both, order, "as-of", parts)
    target = F.when(F.col("_kind") == 1, F.col("_v"))
    inside = W.partitionBy(PART, *keys).orderBy(F.desc("_v"), "_kind").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.last(target, ignorenulls=True).over(inside)).where("_kind = 0")
    carried = rows.groupBy(PART, *keys).agg(F.min(target).alias("_least"))
    carried = carried.withColumn("_carried", F.last("_least", ignorenulls=True).over(earlier)).drop("_least")
    found = own.join(carried, [PART, *keys]).withColumn("found", F.coalesce("_own", "_carried"))
    return found.select(*keys, F.col("_v").alias("at"), *rest, "found")
