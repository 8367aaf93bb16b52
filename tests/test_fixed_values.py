"""Literal goldens of the fixed values, and rows that no value may stop."""

import math

import pytest
from pyspark.sql import functions as F

from hazardflow import dims
from hazardflow.functions import features, geo
from hazardflow.operators import registry
from hazardflow.plans.triage import enriched
from hazardflow.streaming import jobs


def test_words_limits_and_channels():
    assert dims.EVENT_TYPES.index("wildfire") == 0 and dims.EVENT_TYPES.index("volcanic eruption") == 9
    assert len(dims.EVENT_TYPES) == 15 and dims.EVENT_TYPES[-1] == "fog"
    assert len(dims.STATE_DENSITY) == 50
    assert [dims.STATE_DENSITY[s] for s in ("DC", "NJ", "AK", "WY", "CA")] == [4589.7, 470.4, 0.5, 2.3, 97.9]
    assert "IA" not in dims.STATE_DENSITY and dims.DEFAULT_STATE_DENSITY == 25.0
    assert [len(dims.CHANNELS[s]) for s in ("EXTREME", "SEVERE", "MODERATE", "MINOR")] == [5, 4, 3, 2]
    assert dims.CHANNELS["SEVERE"][1:] == ["push", "telegram", "sms"]
    limits = {n: (low, high, required, default) for n, low, high, required, default in dims.INPUT_LIMITS}
    assert limits["population_density_at_center"] == (0.0, 50000.0, True, 0.0)
    assert limits["time_since_last_event_hours"] == (0.0, 8760.0, False, 720.0)
    assert limits["historical_severity_avg"] == (0.0, 4.0, False, 2.0) and len(limits) == 10
    assert dims.LATENCY_BOUNDS == [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]
    assert dims.VULNERABILITY == {"coastal": 0.85, "urban_high_density": 0.72, "suburban": 0.55, "rural": 0.38, "remote": 0.2}
    assert (dims.DRIFT_WINDOW, dims.DRIFT_WARNING, dims.DRIFT_CRITICAL, dims.ESCALATION_THRESHOLD) == (1000, 0.15, 0.3, 0.65)


BAD = [math.nan, math.inf, -math.inf, 1e300, -1e300, 1e12, None]


def test_no_count_or_coordinate_stops_a_row(spark):
    frame = spark.createDataFrame([(v,) for v in BAD], "v double")
    value = F.col("v")
    rows = frame.select(
        features.prior_count_score(value).alias("prior"), geo.hospital_count(value).alias("hospitals"),
        geo.affected_population(geo.pseudo_density(value, value)).alias("people"),
    ).collect()
    assert [r.prior for r in rows] == [1.0, 1.0, pytest.approx(rows[2].prior), 1.0, rows[4].prior, 1.0, 0.0]
    assert all(r.hospitals >= 1 for r in rows)
    whole = spark.createDataFrame([(3.9,), (-3.9,), (10.0,), (12.0,)], "v double").select(features.prior_count_score(value).alias("p"))
    assert [r.p for r in whole.collect()] == [0.3, -0.3, 1.0, 1.0]


def test_bad_points_and_large_counts_go_through_triage(spark):
    rows = [(str(i), "flood", 1.0, lat, 10.0, {"prior_24h_event_count": 1e12}) for i, lat in enumerate([40.0, math.nan, math.inf, -math.inf])]
    events = spark.createDataFrame(rows, "event_id string, event_type string, magnitude double, latitude double, longitude double, extra map<string,double>")
    events = events.withColumn("ts", F.lit("2024-01-01 12:00:00").cast("timestamp")).withColumn("prior", F.col("extra")["prior_24h_event_count"])
    good, bad = enriched(events, prior="prior", extra="extra")
    assert [r.event_id for r in good.collect()] == ["0"]
    kept = bad.collect()
    assert sorted(r.event_id for r in kept) == ["1", "2", "3"]


def test_feed_events_off_the_globe_are_set_aside(spark):
    points = [(1.0, 2.0), (math.nan, 2.0), (math.inf, 2.0), (91.0, 2.0), (1.0, 181.0), (None, 2.0), (-90.0, -180.0)]
    events = spark.createDataFrame(
        [(str(i), "noaa", "flood", 1.0, lat, lon) for i, (lat, lon) in enumerate(points)],
        "event_id string, source string, event_type string, magnitude double, lat double, lon double",
    ).withColumns({"ts": F.current_timestamp(), "_local_ts": F.localtimestamp()})
    assert [r.event_id for r in jobs.as_requests(events).collect()] == ["0", "6"]
    assert {r.event_id: r.problems[0] for r in jobs.unplaced(events).collect()} == {
        "1": "point out of range", "2": "point out of range", "3": "point out of range", "4": "point out of range", "5": "point missing"
    }


def test_any_weight_gets_its_share(spark):
    """A weight of a thousandth of a percent is served, versions without weight are not."""
    rows = [("a", "m", 50.0, True, 1), ("none", "m", 0.0, True, 2), ("b", "m", 0.001, True, 3), ("c", "m", 49.999, True, 4)]
    versions = spark.createDataFrame(rows, "version string, model_type string, traffic_weight double, is_active boolean, position long")
    events = spark.range(1_000_000).withColumnRenamed("id", "event_id")
    found = {r.assigned_version: r["count"] for r in registry.assign_versions(events, versions).groupBy("assigned_version").count().collect()}
    assert set(found) == {"a", "b", "c"} and 1 <= found["b"] <= 40 and abs(found["a"] - 500_000) < 5_000
