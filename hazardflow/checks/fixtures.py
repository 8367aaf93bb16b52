"""Domain views over the test tables. Each text runs unchanged in Spark and in the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardflow import session

HAZARD_EVENTS = """
SELECT CAST(event_id AS VARCHAR(20)) AS event_id, event_id AS seq, ts, user_id AS sensor_id,
  CASE event_type WHEN 'click' THEN 'Wildfire Warning' WHEN 'view' THEN 'earthquake'
       WHEN 'purchase' THEN 'Hurricane' WHEN 'error' THEN 'Flash Flood' ELSE 'Unusual Event' END AS event_type,
  CASE event_id % 3 WHEN 0 THEN 'noaa' WHEN 1 THEN 'usgs' ELSE 'nws' END AS source,
  CASE user_id % 8 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(36 AS DOUBLE) WHEN 2 THEN CAST(28 AS DOUBLE)
       WHEN 3 THEN CAST(42 AS DOUBLE) WHEN 4 THEN CAST(31 AS DOUBLE) WHEN 5 THEN CAST(61 AS DOUBLE)
       WHEN 6 THEN CAST(-33 AS DOUBLE) ELSE CAST(45 AS DOUBLE) END
    + CAST((user_id * 7919) % 400 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(2 AS DOUBLE) AS latitude,
  CASE user_id % 8 WHEN 0 THEN CAST(-80 AS DOUBLE) WHEN 1 THEN CAST(-119 AS DOUBLE) WHEN 2 THEN CAST(-83 AS DOUBLE)
       WHEN 3 THEN CAST(-75 AS DOUBLE) WHEN 4 THEN CAST(-99 AS DOUBLE) WHEN 5 THEN CAST(-150 AS DOUBLE)
       WHEN 6 THEN CAST(151 AS DOUBLE) ELSE CAST(-100 AS DOUBLE) END
    + CAST((user_id * 104729) % 600 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(3 AS DOUBLE) AS longitude,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'view' THEN value / CAST(50 AS DOUBLE) ELSE value END
    AS magnitude,
  CASE event_id % 6 WHEN 0 THEN 'IA' WHEN 1 THEN 'DC' WHEN 2 THEN 'NJ' ELSE NULL END AS state_code,
  value * CAST(20 AS DOUBLE) AS affected_area_sq_km,
  CAST(event_id % 14 AS INT) AS prior_24h_event_count,
  value, value * CAST(4 AS DOUBLE) AS latency_ms, props,
  CASE WHEN value >= 150 THEN 'EXTREME' WHEN value >= 80 THEN 'SEVERE' WHEN value >= 35 THEN 'MODERATE'
       ELSE 'MINOR' END AS observed_severity,
  CASE WHEN value >= 150 THEN 4 WHEN value >= 80 THEN 3 WHEN value >= 35 THEN 2 ELSE 1 END AS severity_rank,
  CASE WHEN event_id % 10 = 0 THEN 'MODERATE' WHEN value >= 150 THEN 'EXTREME' WHEN value >= 80 THEN 'SEVERE'
       WHEN value >= 35 THEN 'MODERATE' ELSE 'MINOR' END AS predicted_severity
FROM events
"""

ALERT_POLYGONS = """
SELECT n_nationkey AS alert_id, n_nationkey % 2 AS is_triangle,
  CASE n_nationkey % 8 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(36 AS DOUBLE) WHEN 2 THEN CAST(28 AS DOUBLE)
       WHEN 3 THEN CAST(42 AS DOUBLE) WHEN 4 THEN CAST(31 AS DOUBLE) WHEN 5 THEN CAST(61 AS DOUBLE)
       WHEN 6 THEN CAST(-33 AS DOUBLE) ELSE CAST(45 AS DOUBLE) END - CAST(n_nationkey % 3 AS DOUBLE) AS lat0,
  CASE n_nationkey % 8 WHEN 0 THEN CAST(-80 AS DOUBLE) WHEN 1 THEN CAST(-119 AS DOUBLE) WHEN 2 THEN CAST(-83 AS DOUBLE)
       WHEN 3 THEN CAST(-75 AS DOUBLE) WHEN 4 THEN CAST(-99 AS DOUBLE) WHEN 5 THEN CAST(-150 AS DOUBLE)
       WHEN 6 THEN CAST(151 AS DOUBLE) ELSE CAST(-100 AS DOUBLE) END - CAST(n_nationkey % 4 AS DOUBLE) AS lon0,
  CAST(2.5 AS DOUBLE) AS dlat, CAST(3 AS DOUBLE) AS dlon
FROM nation
"""

# Raw quality inputs as text, with missing, non-numeric and NaN values.
RAW_INPUTS = """
SELECT event_id,
  CASE WHEN seq % 37 = 0 THEN 'NaN' ELSE CAST(magnitude AS VARCHAR(40)) END AS magnitude_or_wind_speed,
  CASE WHEN seq % 29 = 0 THEN NULL ELSE CAST(value * CAST(400 AS DOUBLE) AS VARCHAR(40)) END
    AS population_density_at_center,
  CASE WHEN seq % 43 = 0 THEN '1.75' ELSE '0.55' END AS infrastructure_vulnerability_score,
  CASE WHEN seq % 41 = 0 THEN 'abc' WHEN seq % 3 = 0 THEN '0.25' ELSE NULL END AS network_degradation_index,
  CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(prior_24h_event_count AS VARCHAR(40)) END AS prior_24h_event_count,
  CASE WHEN seq % 4 = 0 THEN '12.5' WHEN seq % 4 = 1 THEN '900' ELSE NULL END AS distance_to_nearest_hospital_km,
  CASE WHEN seq % 6 = 0 THEN '-250' WHEN seq % 6 = 1 THEN '1500' ELSE NULL END AS elevation_meters,
  CASE WHEN seq % 7 = 0 THEN '24' ELSE NULL END AS time_since_last_event_hours,
  CAST(affected_area_sq_km AS VARCHAR(40)) AS affected_area_sq_km,
  CASE WHEN seq % 9 = 0 THEN '3.5' ELSE NULL END AS historical_severity_avg
FROM hazard_events
"""

# One poll per source and hour of events.
FEED_POLLS = """
SELECT source, COUNT(*) AS item_count, MAX(ts) AS polled_at, MIN(seq) AS seq
FROM hazard_events GROUP BY source, date_trunc('hour', ts)
"""

# Registrations of model versions, re-registrations included.
REGISTRATIONS = """
SELECT CONCAT('v', CAST(o_custkey % 40 AS VARCHAR(10))) AS version,
  CASE WHEN o_orderstatus = 'F' THEN 'classifier' ELSE 'escalation' END AS model_type,
  CAST(o_orderkey % 50 AS DOUBLE) AS traffic_weight, o_custkey % 7 <> 0 AS is_active,
  CONCAT('release ', CAST(o_orderkey % 9 AS VARCHAR(10))) AS description,
  o_orderdate AS registered_at, CAST(o_orderkey AS BIGINT) AS seq
FROM orders
"""

TABLES = {
    "hazard_events": HAZARD_EVENTS,
    "alert_polygons": ALERT_POLYGONS,
    "raw_inputs": RAW_INPUTS,
    "feed_polls": FEED_POLLS,
    "registrations": REGISTRATIONS,
}
_BASE = {"hazard_events": "events", "alert_polygons": "nation", "registrations": "orders"}
_DERIVED = {"raw_inputs": "hazard_events", "feed_polls": "hazard_events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, stored: str | None = None) -> DataFrame:
    """A domain view as a DataFrame, of the base table's rows that meet ``stored``, a condition on its own columns."""
    source = _BASE.get(name) or _DERIVED[name]
    rows = table(spark, sf_dir, source) if name in _BASE else view(spark, sf_dir, source)
    rows = rows if stored is None else rows.where(stored)
    return spark.sql(TABLES[name].replace(f"FROM {source}", "FROM {src}"), src=rows)


def hazard_events(spark: SparkSession, sf_dir: str, stored: str | None = None) -> DataFrame:
    return view(spark, sf_dir, "hazard_events", stored)


def alert_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with their ring: the box's four corners, or its first three for triangles."""

    def corner(lat_side: int, lon_side: int):
        return F.struct(
            (F.col("lat0") + F.lit(float(lat_side)) * F.col("dlat")).alias("lat"),
            (F.col("lon0") + F.lit(float(lon_side)) * F.col("dlon")).alias("lon"),
        )

    corners = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0))
    size = F.when(F.col("is_triangle") == 1, 3).otherwise(4)
    return view(spark, sf_dir, "alert_polygons").withColumn("polygon", F.slice(corners, F.lit(1), size))


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """Oracle text led by the views it needs; ``body`` starts with more CTEs or with SELECT."""
    needed: list[str] = []
    for name in names:
        for part in (_DERIVED.get(name), name):
            if part and part not in needed:
                needed.append(part)
    views = ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed)
    body = body.strip()
    more = body if body.upper().startswith("SELECT") else ", " + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{more}"
