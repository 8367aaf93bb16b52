"""Feed bookkeeping: poll log, status report, staleness and item counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardflow import dims
from hazardflow.functions.times import MICROS, micros, round_half_up


def item_counts(items: DataFrame) -> DataFrame:
    """Items per source."""
    return items.groupBy("source").agg(F.count(F.lit(1)).alias("item_count"))


def latest_status(polls: DataFrame) -> DataFrame:
    """Last poll per source from an append-only log; a later row replaces an earlier one.

    Equal poll times are settled by the log position ``seq``.
    """
    last = F.max_by(F.struct("item_count", "polled_at"), F.struct("polled_at", "seq"))
    return polls.groupBy("source").agg(last.alias("l")).select("source", "l.item_count", "l.polled_at")


def merge_status(current: DataFrame, polls: DataFrame) -> DataFrame:
    """Status table after a batch of polls: last write wins per source."""
    old = current.select("source", "item_count", "polled_at", F.lit(-1).cast("bigint").alias("seq"))
    return latest_status(old.unionByName(polls.select("source", "item_count", "polled_at", "seq")))


def status_report(status: DataFrame, as_of: Column, interval_seconds: int = dims.STALE_SECONDS) -> DataFrame:
    """The fixed feeds with count 0 and ``as_of`` where unseen.

    A feed is ``initializing`` before its first poll, ``active`` when polled within the interval, else ``idle``.
    The status side has one row per source and is left to the optimizer.
    """
    feeds = dims.feed_dim(status.sparkSession)
    age = (micros(as_of) - micros(F.col("polled_at"))) / F.lit(float(MICROS))
    state = (
        F.when(F.col("polled_at").isNull(), "initializing").when(age <= interval_seconds, "active").otherwise("idle")
    )
    return feeds.join(status, "source", "left").select(
        "source",
        state.alias("status"),
        F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
        F.coalesce("polled_at", as_of).alias("last_poll"),
    )


def staleness(polls: DataFrame, as_of: Column, threshold_seconds: float = dims.STALE_SECONDS) -> DataFrame:
    """Age of the last poll per seen source; exactly the threshold is still healthy."""
    last = polls.groupBy("source").agg(F.max("polled_at").alias("_last"))
    age = (micros(as_of) - micros(F.col("_last"))) / F.lit(float(MICROS))
    return last.select(
        "source",
        round_half_up(age, 1).alias("last_poll_seconds_ago"),
        F.when(age > F.lit(float(threshold_seconds)), "STALE").otherwise("HEALTHY").alias("status"),
    )


def active_feeds(polls: DataFrame, as_of: Column, threshold_seconds: float = dims.STALE_SECONDS) -> DataFrame:
    """Number of sources that are not stale."""
    return staleness(polls, as_of, threshold_seconds).agg(
        F.count_distinct(F.when(F.col("status") == "HEALTHY", F.col("source"))).alias("active_feeds")
    )
