"""Landed feed files as batch or streaming tables, normalized to one event schema.

Every reader takes ``stream=True`` to watch a folder instead of reading it once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hazardflow import dims, schemas
from hazardflow.functions.geo import parse_polygon, polygon_ok, vertex_mean
from hazardflow.functions.times import micros


def _reader(spark: SparkSession, stream: bool, schema: StructType):
    return (spark.readStream if stream else spark.read).schema(schema)


def _iso(text: Column) -> Column:
    """ISO-8601 with ``Z`` or an offset as an instant; null when it does not parse."""
    return F.try_to_timestamp(text)


def _wall_clock(text: Column) -> Column:
    """The same text as local wall-clock time, with the offset dropped."""
    return F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def cap_alerts(entries: DataFrame, keep_xml: bool = False) -> DataFrame:
    """Typed alerts from raw Atom entries, with ``entry_ok`` = False where a time or polygon does not parse."""
    texts = {"event_type": "event", "severity": "severity", "urgency": "urgency", "certainty": "certainty"}
    texts |= {"area_desc": "areaDesc", "headline": "headline", "description": "description"}
    raw = [F.to_xml(F.struct(*[F.col(c) for c in schemas.CAP_ENTRY.names])).alias("raw_xml")] if keep_xml else []
    typed = entries.select(
        F.coalesce("id", F.lit("")).alias("alert_id"),
        *[F.coalesce(F.col(tag), F.lit("")).alias(name) for name, tag in texts.items()],
        parse_polygon(F.col("polygon")).alias("polygon"),
        _iso(F.col("sent")).alias("issued_at"),
        _wall_clock(F.col("sent")).alias("issued_local"),
        _iso(F.col("expires")).alias("expires_at"),
        *raw,
    )
    ok = F.col("issued_at").isNotNull() & F.col("expires_at").isNotNull() & polygon_ok(F.col("polygon"))
    return typed.withColumn("entry_ok", ok)


def read_cap_feed(
    spark: SparkSession, path: str, stream: bool = False, keep_xml: bool = False, quarantine: bool = False
) -> DataFrame:
    """Weather alerts from Atom files; entries that fail to parse are skipped, or returned by ``quarantine``."""
    reader = _reader(spark, stream, schemas.CAP_ENTRY).format("xml")
    entries = reader.option("rowTag", "entry").option("ignoreNamespace", "true").load(path)
    alerts = cap_alerts(entries, keep_xml)
    wanted = ~F.col("entry_ok") if quarantine else F.col("entry_ok")
    return alerts.where(wanted).drop("entry_ok")


def seismic_events(features: DataFrame, min_magnitude: float = dims.MIN_MAGNITUDE) -> DataFrame:
    """Typed seismic events at or above a magnitude, from ``(id, properties, geometry)`` rows.

    The magnitude filter comes first. Rows without a magnitude are dropped.
    """
    p = "properties."
    at = F.col("geometry.coordinates")
    return features.where(F.col(p + "mag") >= F.lit(min_magnitude)).select(
        F.col("id").alias("event_id"),
        F.col(p + "mag").alias("magnitude"),
        F.coalesce(p + "magType", F.lit("unknown")).alias("magnitude_type"),
        F.coalesce(p + "place", F.lit("")).alias("place"),
        F.get(at, F.lit(2)).alias("depth_km"),
        F.get(at, F.lit(1)).alias("latitude"),
        F.get(at, F.lit(0)).alias("longitude"),
        F.timestamp_millis(p + "time").alias("occurred_at"),
        F.col(p + "alert").alias("alert_level"),
        (F.coalesce(p + "tsunami", F.lit(0)) != 0).alias("tsunami_flag"),
        F.coalesce(p + "felt", F.lit(0)).alias("felt_count"),
        F.col(p + "cdi").alias("cdi"),
        F.col(p + "mmi").alias("mmi"),
        F.coalesce(p + "url", F.lit("")).alias("url"),
    )


def read_seismic(
    spark: SparkSession, path: str, min_magnitude: float = dims.MIN_MAGNITUDE, stream: bool = False
) -> DataFrame:
    """Seismic events from GeoJSON files."""
    feed = _reader(spark, stream, schemas.SEISMIC_FEED).option("multiLine", "true").json(path)
    return seismic_events(feed.select(F.explode("features").alias("f")).select("f.*"), min_magnitude)


def warning_rows(features: DataFrame, column: str = "feature") -> DataFrame:
    """Typed core fields of warning features kept as JSON text, and the whole feature as a variant."""

    def prop(name: str) -> Column:
        return F.get_json_object(column, f"$.properties.{name}")

    ring = F.from_json(F.get_json_object(column, "$.geometry.coordinates[0]"), "array<array<double>>")
    polygon = F.transform(ring, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")))
    is_polygon = F.get_json_object(column, "$.geometry.type") == "Polygon"
    return features.select(
        F.coalesce(F.get_json_object(column, "$.id"), prop("id")).alias("id"),
        F.coalesce(prop("event"), F.lit("")).alias("event"),
        F.coalesce(prop("severity"), F.lit("")).alias("severity"),
        F.coalesce(prop("headline"), F.lit("")).alias("headline"),
        _iso(prop("sent")).alias("sent"),
        _wall_clock(prop("sent")).alias("sent_local"),
        F.when(is_polygon, polygon).alias("polygon"),
        F.try_parse_json(column).alias("feature"),
    )


def read_warnings(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Warnings from GeoJSON files; a file that is not a feature collection gives no rows."""
    feed = _reader(spark, stream, schemas.WARNING_FEED).option("multiLine", "true").json(path)
    return warning_rows(feed.select(F.explode("features").alias("feature")))


def from_cap(alerts: DataFrame) -> DataFrame:
    """Alerts as events at the mean of the polygon's distinct vertices."""
    return alerts.select(
        F.col("alert_id").alias("event_id"),
        F.lit("noaa").alias("source"),
        "event_type",
        F.lit(None).cast("double").alias("magnitude"),
        vertex_mean(F.col("polygon"), "lat").alias("lat"),
        vertex_mean(F.col("polygon"), "lon").alias("lon"),
        F.col("issued_at").alias("ts"),
        F.col("issued_local").alias("_local_ts"),
        F.col("severity").alias("cap_severity"),
        "polygon",
    )


def from_seismic(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.lit("usgs").alias("source"),
        F.lit("earthquake").alias("event_type"),
        "magnitude",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("occurred_at").alias("ts"),
        F.col("occurred_at").cast("timestamp_ntz").alias("_local_ts"),
        F.lit(None).cast("string").alias("cap_severity"),
        F.lit(None).cast(schemas.POLYGON).alias("polygon"),
    )


def from_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.select(
        F.col("id").alias("event_id"),
        F.lit("nws").alias("source"),
        F.col("event").alias("event_type"),
        F.lit(None).cast("double").alias("magnitude"),
        vertex_mean(F.col("polygon"), "lat").alias("lat"),
        vertex_mean(F.col("polygon"), "lon").alias("lon"),
        F.col("sent").alias("ts"),
        F.col("sent_local").alias("_local_ts"),
        F.col("severity").alias("cap_severity"),
        "polygon",
    )


def normalize(
    alerts: DataFrame | None = None, seismic: DataFrame | None = None, warnings: DataFrame | None = None
) -> DataFrame:
    """One event table from any of the three feeds, batch or streaming."""
    parts = []
    if alerts is not None:
        parts.append(from_cap(alerts))
    if seismic is not None:
        parts.append(from_seismic(seismic))
    if warnings is not None:
        parts.append(from_warnings(warnings))
    return reduce(DataFrame.unionByName, parts)


def unexpired(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alerts that have not expired at a given time."""
    return alerts.where(micros(F.col("expires_at")) >= micros(as_of))
