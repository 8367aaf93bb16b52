"""Lookup tables, limits and thresholds that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Hazard words in match order; the position is the code.
EVENT_TYPES = [
    "wildfire", "earthquake", "hurricane", "tornado", "flood", "tsunami", "blizzard", "drought",
    "landslide", "volcanic eruption", "heat wave", "winter storm", "thunderstorm", "hail", "fog",
]

# Severity classes from most to least severe, and their ranks.
SEVERITIES = ["EXTREME", "SEVERE", "MODERATE", "MINOR"]
SEVERITY_RANK = {"MINOR": 1, "MODERATE": 2, "SEVERE": 3, "EXTREME": 4}

# Alert-protocol severity words and the class they stand for.
CAP_SEVERITY = {
    "Extreme": "EXTREME",
    "Severe": "SEVERE",
    "Moderate": "MODERATE",
    "Minor": "MINOR",
    "Unknown": "MINOR",
}

# Infrastructure vulnerability per region type.
VULNERABILITY = {
    "coastal": 0.85,
    "urban_high_density": 0.72,
    "suburban": 0.55,
    "rural": 0.38,
    "remote": 0.20,
}
DEFAULT_VULNERABILITY = 0.5

# People per square kilometre by state code.
STATE_DENSITY = {
    "AK": 0.5, "AL": 37.5, "AR": 22.3, "AZ": 22.9, "CA": 97.9, "CO": 21.5, "CT": 285.3, "DC": 4589.7,
    "DE": 187.4, "FL": 154.3, "GA": 69.1, "HI": 82.6, "ID": 7.9, "IL": 89.4, "IN": 72.0, "KS": 14.2,
    "KY": 43.9, "LA": 42.1, "MA": 334.7, "MD": 238.6, "ME": 17.0, "MI": 67.2, "MN": 27.3, "MO": 34.6,
    "MS": 24.0, "MT": 2.8, "NC": 80.6, "ND": 3.9, "NE": 9.6, "NH": 57.5, "NJ": 470.4, "NM": 7.0,
    "NV": 10.3, "NY": 159.4, "OH": 109.7, "OK": 22.2, "OR": 16.0, "PA": 110.3, "RI": 394.4, "SC": 63.2,
    "SD": 4.5, "TN": 63.0, "TX": 42.9, "UT": 14.7, "VA": 82.4, "VT": 26.2, "WA": 42.1, "WI": 41.4,
    "WV": 29.5, "WY": 2.3,
}
DEFAULT_STATE_DENSITY = 25.0

# Notification channels per severity, in order of use.
CHANNELS = {
    "EXTREME": ["alert_platform", "mesh_gateway", "sms", "push", "telegram"],
    "SEVERE": ["alert_platform", "push", "telegram", "sms"],
    "MODERATE": ["alert_platform", "push", "telegram"],
    "MINOR": ["alert_platform", "push"],
}

# Model input columns in vector order.
MODEL_FEATURES = [
    "event_type_encoded",
    "magnitude_or_wind_speed",
    "population_density_at_center",
    "infrastructure_vulnerability_score",
    "prior_24h_event_count",
    "network_degradation_index",
    "time_of_day_risk_factor",
    "evacuation_route_availability",
    "hospital_proximity_score",
    "weather_compounding_factor",
]

# Raw input limits as (name, minimum, maximum, required, default).
INPUT_LIMITS = [
    ("magnitude_or_wind_speed", 0.0, 200.0, True, 0.0),
    ("population_density_at_center", 0.0, 50000.0, True, 0.0),
    ("infrastructure_vulnerability_score", 0.0, 1.0, True, 0.0),
    ("network_degradation_index", 0.0, 1.0, False, 0.0),
    ("prior_24h_event_count", 0.0, 100.0, False, 0.0),
    ("distance_to_nearest_hospital_km", 0.0, 500.0, False, 50.0),
    ("elevation_meters", -100.0, 9000.0, False, 0.0),
    ("time_since_last_event_hours", 0.0, 8760.0, False, 720.0),
    ("affected_area_sq_km", 0.0, 100000.0, True, 0.0),
    ("historical_severity_avg", 0.0, 4.0, False, 2.0),
]
INPUT_NAMES = [name for name, *_ in INPUT_LIMITS]
DEFAULT_AREA_SQ_KM = 1963.5

# Latency bucket upper bounds in milliseconds; the last bucket is open.
LATENCY_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]

# Feeds that always appear in the status report.
FEEDS = ["noaa", "usgs", "nws"]

# Thresholds and sizes.
REUSE_TTL_SECONDS = 300
DRIFT_WINDOW = 1000
DRIFT_WARNING = 0.15
DRIFT_CRITICAL = 0.30
STALE_SECONDS = 300
ESCALATION_THRESHOLD = 0.65
MIN_MAGNITUDE = 2.5
SEQUENCE_STEPS = 24
SEQUENCE_WIDTH = 15
BATCH_SLOT_MS = 50
BATCH_LIMIT = 64


def _values(spark: SparkSession, rows: list[str], columns: str) -> DataFrame:
    """A literal table, known to the optimizer with its size."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def state_density(spark: SparkSession) -> DataFrame:
    """The state density table as a DataFrame; its size is fixed."""
    return _values(spark, [f"('{s}', {d}D)" for s, d in STATE_DENSITY.items()], "state_code, base_density")


def severity_dim(spark: SparkSession) -> DataFrame:
    """One row per severity with rank and channels; its size is fixed."""
    rows = []
    for name in SEVERITIES:
        listed = ", ".join(f"'{channel}'" for channel in CHANNELS[name])
        rows.append(f"('{name}', {SEVERITY_RANK[name]}, array({listed}))")
    return _values(spark, rows, "severity, severity_rank, channels")


def feed_dim(spark: SparkSession) -> DataFrame:
    """The feeds that always appear in the status report."""
    return _values(spark, [f"('{feed}')" for feed in FEEDS], "source")
