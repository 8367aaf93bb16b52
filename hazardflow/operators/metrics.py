"""Monitoring aggregates over triage logs: counters, histograms, rates, quantiles and the snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardflow import dims
from hazardflow.functions.times import MICROS, micros, round_half_up

OPEN_BOUND = float("inf")


def class_distribution(rows: DataFrame, label: str = "severity") -> DataFrame:
    """Rows and percentage per class, largest first."""
    grouped = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return (
        grouped.withColumn("total", total)
        .withColumn("pct", F.col("n") * F.lit(100.0) / F.col("total"))
        .orderBy(F.col("n").desc(), F.col(label))
    )


def feature_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per column at 2 decimals, one row per column."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = rows.agg(
        *[
            F.struct(*[round_half_up(f(c), 2).alias(s) for s, f in stats.items()]).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("s")) for i, c in enumerate(columns)]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.feature", *[f"e.s.{s}" for s in stats])


def prediction_counters(
    log: DataFrame, severity: str = "severity", likely: str = "escalation_likely"
) -> DataFrame:
    """Total, per-severity and escalation counters as ``(name, value)``."""
    grouped = log.groupBy(F.col(severity).alias("_sev")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(likely)).alias("esc")
    )
    per_class = grouped.select(F.concat(F.lit("severity_"), "_sev").alias("name"), F.col("n").alias("value"))
    totals = grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("predictions_total"),
        F.coalesce(F.sum("esc"), F.lit(0)).alias("escalations_predicted"),
    )
    return totals.unpivot([], ["predictions_total", "escalations_predicted"], "name", "value").unionByName(per_class)


def feed_counters(polls: DataFrame) -> DataFrame:
    """Events, polls, summed latency and the last poll per source, from ``(source, item_count, polled_at)``."""
    return polls.groupBy("source").agg(
        F.sum("item_count").cast("bigint").alias("feed_events"),
        F.count(F.lit(1)).alias("feed_polls"),
        F.max("polled_at").alias("feed_last_poll"),
    )


def error_counters(errors: DataFrame, totals: bool = False) -> DataFrame:
    """Errors per source and type; with ``totals`` also per source and over all.

    ``level`` says what a row counts (0 one type, 1 a source, 3 all), so a null source is never mistaken for the total.
    """
    counts = F.count(F.lit(1)).alias("errors")
    if not totals:
        return errors.groupBy("source", "error_type").agg(counts)
    return errors.rollup("source", "error_type").agg(counts, F.grouping_id().cast("int").alias("level"))


def bucket_bound(latency_ms: Column) -> Column:
    """Upper bound of the bucket a latency falls in; bounds belong to their bucket, the last one is open."""
    column = F.when(latency_ms <= dims.LATENCY_BOUNDS[0], F.lit(dims.LATENCY_BOUNDS[0]))
    for bound in dims.LATENCY_BOUNDS[1:]:
        column = column.when(latency_ms <= bound, F.lit(bound))
    return column.otherwise(F.lit(OPEN_BOUND))


def latency_histogram(log: DataFrame, latency: str = "latency_ms", keys: list[str] | None = None) -> DataFrame:
    """Count and summed latency per bucket; counts are not cumulative."""
    return (
        log.where(F.col(latency).isNotNull())
        .groupBy(*(keys or []), bucket_bound(F.col(latency)).alias("upper_bound"))
        .agg(F.count(F.lit(1)).alias("bucket_count"), F.sum(latency).alias("bucket_total_ms"))
    )


def latency_stats(log: DataFrame, latency: str = "latency_ms", keys: list[str] | None = None) -> DataFrame:
    """Average, count and total latency; the average of nothing is 0."""
    count, total = F.count(latency), F.coalesce(F.sum(latency), F.lit(0.0))
    return log.groupBy(*(keys or [])).agg(
        F.when(count > 0, total / count).otherwise(F.lit(0.0)).alias("avg_ms"),
        count.alias("observations"),
        total.alias("total_ms"),
    )


def last_gauge(values: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """Last value per key; equal times are settled by ``tie``."""
    return values.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def snapshot(log: DataFrame, polls: DataFrame, errors: DataFrame, gauges: DataFrame, as_of: Column) -> DataFrame:
    """All metrics as ``(kind, name, value, as_of)``.

    ``log(severity, latency_ms, escalation_likely)``, ``polls(source, item_count, polled_at)``,
    ``errors(source, error_type)`` and ``gauges(model, accuracy)`` are each reduced by one small aggregate.
    """

    def long(df: DataFrame, kind: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))

    per_class = log.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("escalation_likely").alias("esc"),
        F.count("latency_ms").alias("obs"),
        F.sum("latency_ms").alias("ms"),
    )
    whole = per_class.agg(
        F.sum("n").alias("predictions_total"),
        F.sum("esc").alias("escalations_predicted"),
        F.sum("obs").alias("obs"),
        F.sum("ms").alias("ms"),
    )
    stats = F.explode(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("double").alias("value"))
                for kind, name, value in (
                    ("counter", "predictions_total", F.col("predictions_total")),
                    ("counter", "escalations_predicted", F.col("escalations_predicted")),
                    ("histogram", "prediction_latency_avg_ms", F.try_divide("ms", "obs")),
                    ("histogram", "prediction_latency_count", F.col("obs")),
                    ("histogram", "prediction_latency_total_ms", F.col("ms")),
                )
            ]
        )
    )
    feeds = feed_counters(polls)
    parts = [
        whole.select(stats.alias("e")).select("e.*"),
        long(per_class, "severity", F.col("severity"), F.col("n")),
        long(feeds, "counter", F.concat(F.lit("feed_events_"), "source"), F.col("feed_events")),
        long(feeds, "counter", F.concat(F.lit("feed_polls_"), "source"), F.col("feed_polls")),
        long(
            feeds,
            "gauge",
            F.concat(F.lit("feed_last_poll_"), "source"),
            micros(F.col("feed_last_poll")) / F.lit(float(MICROS)),
        ),
        long(
            error_counters(errors),
            "counter",
            F.concat(F.lit("errors_"), "source", F.lit("_"), "error_type"),
            F.col("errors"),
        ),
        long(gauges, "gauge", F.concat(F.lit("model_accuracy_"), "model"), F.col("accuracy")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("as_of", as_of)


def bucket_counts(latency: str) -> list[Column]:
    """Observations and their cumulative counts per bucket bound."""
    bounds = [F.count_if(F.col(latency) <= b).alias(f"_le{i}") for i, b in enumerate(dims.LATENCY_BOUNDS)]
    return [F.count(F.lit(1)).alias("observations"), *bounds]


def bucket_quantile(q: float) -> Column:
    """A quantile of ``bucket_counts``, interpolated inside its bucket.

    The lowest bucket starts at 0 and mass in the open bucket gives the largest finite bound.
    """
    rank = F.lit(q) * F.col("observations")
    value = F.lit(dims.LATENCY_BOUNDS[-1])
    for i in reversed(range(len(dims.LATENCY_BOUNDS))):
        low = dims.LATENCY_BOUNDS[i - 1] if i else 0.0
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        width = F.lit(dims.LATENCY_BOUNDS[i] - low)
        inside = F.lit(low) + width * F.try_divide(rank - below, F.col(f"_le{i}") - below)
        value = F.when(F.col(f"_le{i}") >= rank, inside).otherwise(value)
    return value


def histogram_quantiles(
    log: DataFrame,
    ts: str = "ts",
    latency: str = "latency_ms",
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99),
    every: str = "5 minutes",
) -> DataFrame:
    """Quantiles per time window, interpolated inside histogram buckets.

    Windows without observations do not appear. Only the counts per window and bucket are ordered.
    """
    windowed = log.where(F.col(latency).isNotNull()).groupBy(F.window(ts, every).alias("w")).agg(*bucket_counts(latency))
    return windowed.select(
        F.col("w.start").alias("window_start"),
        "observations",
        *[bucket_quantile(q).alias(f"p{round(q * 100)}") for q in quantiles],
    )


def sliding_quantiles(
    log: DataFrame,
    ts: str = "ts",
    latency: str = "latency_ms",
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99),
    window: str = "5 minutes",
    slide: str = "1 minute",
) -> DataFrame:
    """Quantiles of windows that overlap: rows are counted once into panes as long as the slide, and panes are added up.

    So an event is one row of one pane, however many windows it lies in. Works on tables and, behind a watermark, on streams.
    """
    panes = log.where(F.col(latency).isNotNull()).groupBy(F.window(ts, slide).alias("w")).agg(*bucket_counts(latency))
    names = ["observations", *[f"_le{i}" for i in range(len(dims.LATENCY_BOUNDS))]]
    windows = panes.groupBy(F.window("w", window, slide).alias("v")).agg(*[F.sum(n).alias(n) for n in names])
    return windows.select(
        F.col("v.start").alias("window_start"),
        F.col("v.end").alias("window_end"),
        "observations",
        *[bucket_quantile(q).alias(f"p{round(q * 100)}") for q in quantiles],
    )


def approximate_quantiles(
    log: DataFrame,
    keys: list[str],
    latency: str = "latency_ms",
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99),
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantile sketch per key group; bounded memory at any size."""
    return log.groupBy(*keys).agg(
        *[F.percentile_approx(latency, q, accuracy).alias(f"p{round(q * 100)}") for q in quantiles]
    )


def rates(rows: DataFrame, ts: str, seconds: int, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Per-second rate in tumbling windows, of rows or of a summed weight."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        rows.groupBy(*(keys or []), F.window(ts, f"{seconds} seconds").alias("w"))
        .agg(amount.cast("bigint").alias("n"))
        .select(
            *(keys or []),
            F.col("w.start").alias("window_start"),
            "n",
            (F.col("n") / F.lit(float(seconds))).alias("per_second"),
        )
    )


def batch_statistics(
    requests: DataFrame, ts: str = "ts", slot_ms: int = dims.BATCH_SLOT_MS, limit: int = dims.BATCH_LIMIT
) -> DataFrame:
    """Batches, requests and the mean batch size when requests are batched per time slot, up to a limit each."""
    slots = requests.groupBy(F.floor(micros(F.col(ts)) / F.lit(slot_ms * 1000)).alias("_slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = slots.agg(
        F.coalesce(F.sum(F.ceil(F.col("n") / F.lit(limit))), F.lit(0)).cast("bigint").alias("total_batches"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_requests"),
    )
    mean = F.when(
        F.col("total_batches") > 0, round_half_up(F.col("total_requests") / F.col("total_batches"), 2)
    ).otherwise(F.lit(0.0))
    return totals.withColumn("avg_batch_size", mean)
