"""Model versions: registration, promotion, traffic split and outcome comparison.

The registry is a small dimension table; event tables meet its breakpoints as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardflow import dims
from hazardflow.functions.search import edges_below
from hazardflow.operators.ranks import interpolated, quantile_aggregates, running_totals

POINT_DIGITS = 13  # hexadecimal: as many bits as a double holds


def register(log: DataFrame) -> DataFrame:
    """Current registry from a log ``(version, model_type, description, traffic_weight, is_active, registered_at, seq)``.

    A later registration of a version replaces the earlier one but keeps its place. The very first
    registration gets weight 100 and makes its version the default; other weights are not rebalanced.
    """
    order = F.struct("registered_at", "seq")
    description = F.col("description") if "description" in log.columns else F.lit("")
    fields = F.struct("model_type", description.alias("description"), "traffic_weight", "is_active", "registered_at", "seq")
    latest = log.groupBy("version").agg(F.max_by(fields, order).alias("l"), F.min(order).alias("_first"))
    very_first = F.min("_first").over(Window.partitionBy())
    ranked = latest.withColumn("_start", very_first)
    own = F.struct(F.col("l.registered_at").alias("registered_at"), F.col("l.seq").alias("seq"))
    numbered = ranked.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first")))
    return numbered.select(
        "version",
        F.col("l.model_type").alias("model_type"),
        F.coalesce("l.description", F.lit("")).alias("description"),
        F.when(own == F.col("_start"), F.lit(100.0)).otherwise(F.col("l.traffic_weight")).alias("traffic_weight"),
        F.col("l.is_active").alias("is_active"),
        F.col("l.registered_at").alias("registered_at"),
        F.col("position").cast("bigint").alias("position"),
        (F.col("_first") == F.col("_start")).alias("is_default"),
    )


def promote(versions: DataFrame, version: str, traffic_weight: float = 100.0) -> DataFrame:
    """Give a version its weight, split the rest evenly over the other active ones and make it the default.

    An unknown version fails the job.
    """
    whole = Window.partitionBy()
    is_target = F.col("version") == F.lit(version)
    others = F.count_if(~is_target & F.col("is_active")).over(whole)
    known = F.count_if(is_target).over(whole) > 0
    share = F.lit(100.0 - traffic_weight) / others
    weight = (
        F.when(~known, F.raise_error(F.lit(f"version {version} not found")).cast("double"))
        .when(is_target, F.lit(float(traffic_weight)))
        .when(F.col("is_active"), share)
        .otherwise(F.col("traffic_weight"))
    )
    return versions.withColumn("traffic_weight", weight).withColumn("is_default", is_target)


def cumulative_weights(versions: DataFrame) -> DataFrame:
    """Active versions with the running weight in registration order."""
    order = Window.partitionBy(F.lit(0)).orderBy("position")
    return versions.where("is_active").withColumn("cumulative_weight", F.sum("traffic_weight").over(order))


def traffic_point(event_id: Column) -> Column:
    """A replayable point of an event on the 0-100 traffic line, from 52 bits of a digest of its id."""
    number = F.conv(F.substring(F.md5(event_id.cast("string")), 1, POINT_DIGITS), 16, 10).cast("double")
    return number / F.lit(float(16**POINT_DIGITS)) * F.lit(100.0)


def version_at(point: Column, versions: DataFrame) -> Column:
    """The first active version whose running weight reaches a point of the traffic line; null when none is active.

    Points past the end go to the last version, and a single active version takes them all. The breakpoints, one for each
    active version of the small registry, become a sorted literal, so that any weight gets its share.
    """
    active = cumulative_weights(versions).orderBy("position").select("version", "cumulative_weight").collect()
    if not active:
        return F.lit(None).cast("string")
    # The last version needs no breakpoint of its own.
    place = edges_below(point, [r["cumulative_weight"] for r in active[:-1]])
    return F.get(F.lit([r["version"] for r in active]), place)


def assign_versions(events: DataFrame, versions: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Add ``assigned_version`` by traffic weight; null when no version is active.

    The assignment is sticky: it is a function of the event id rather than a random draw. No join is needed.
    """
    return events.withColumn("assigned_version", version_at(traffic_point(F.col(event_id)), versions))


def serve_versions(
    events: DataFrame, versions: DataFrame, event_id: str = "event_id", force: str | None = "force_version"
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``served_version`` and quarantined rows whose forced version is unknown.

    A forced version bypasses the split and need not be active.
    """
    assigned = assign_versions(events, versions, event_id)
    chosen = F.col("assigned_version") if force is None else F.coalesce(force, "assigned_version")
    rows = assigned.withColumn("served_version", chosen).drop("assigned_version")
    names = [r["version"] for r in versions.select("version").collect()]
    listed = F.array_contains(F.lit(names), F.col("served_version")) if names else F.lit(False)
    known = F.coalesce(listed, F.lit(False))
    return rows.where(known), rows.where(~known)


def version_listing(versions: DataFrame, served: DataFrame) -> DataFrame:
    """Registry rows with the number of predictions each version served (0 when none)."""
    counts = served.groupBy(F.col("served_version").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    return (
        versions.join(counts, "version", "left")
        .withColumn("prediction_count", F.coalesce("n", F.lit(0)).cast("bigint"))
        .drop("n")
    )


def compare_outcomes(
    served: DataFrame, severity: str = "severity", confidence: str = "confidence", latency: str = "latency_ms"
) -> DataFrame:
    """Requests, severity mix, mean confidence and the exact 95th latency percentile per version.

    The rows are read once: everything is counted by version and latency first.
    """
    classes = [c.lower() for c in dims.SEVERITIES]
    counted = served.groupBy("served_version", latency).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(latency).alias("_timed"),
        *[F.count_if(F.col(severity) == c).alias(c.lower()) for c in dims.SEVERITIES],
        F.sum(confidence).alias("_confidence"),
        F.count(confidence).alias("_confident"),
    )
    ranked = running_totals(counted, ["served_version"], latency, ["_timed"])
    found = ranked.groupBy("served_version").agg(
        F.sum("_n").alias("requests"),
        *[F.sum(c).alias(c) for c in classes],
        (F.sum("_confidence") / F.sum("_confident")).alias("mean_confidence"),
        *quantile_aggregates(latency, "_timed", (0.95,)),
    )
    tail = interpolated((0.95,))[0].alias("p95_latency_ms")
    return found.select("served_version", "requests", *classes, "mean_confidence", tail)
