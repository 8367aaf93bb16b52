"""Values worked out by hand from the formulas, and the traps around nulls, NaN, signs and rounding."""

import math

import pytest
from pyspark.sql import functions as F

from hazardflow import dims
from hazardflow.functions import decisions, features, geo, quality, text, times
from hazardflow.operators import enrich, metrics

GEO = [
    (34.05, -118.24, "urban_high_density", 1013.626687, 0.72, 597075, 0.3806, 11.3, 4),
    (40.71, -74.00, "urban_high_density", 500.0, 0.72, 294524, 0.4905, 3.0, 2),
    (29.76, -95.36, "suburban", 2205.34267, 0.55, 1299054, 0.4045, 13.1, 7),
    (21.30, -157.85, "suburban", 2287.2473, 0.55, 1347299, 0.3228, 4.5, 7),
    (61.21, -149.86, "suburban", 2959.404783, 0.55, 1743233, 0.3463, 4.2, 7),
    (25.77, -80.19, "suburban", 500.0, 0.55, 294524, 0.5294, 3.1, 3),
    (0.0, -80.0, "coastal", 500.0, 0.85, 294524, 0.655, 1.2, 2),
    (-33.0, 151.0, "suburban", 4896.341381, 0.55, 2884183, 0.3793, 6.2, 3),
]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_geo_risk(spark):
    points = spark.createDataFrame([(i, *g[:2]) for i, g in enumerate(GEO)], "i int, latitude double, longitude double")
    for row in enrich.geo_risk(points).collect():
        _, _, region, density, vulnerability, affected, composite, shelter, hospitals = GEO[row.i]
        assert row.region_type == region
        assert row.population_density == pytest.approx(density, abs=1e-6)
        assert row.vulnerability_score == vulnerability
        assert row.estimated_affected_population == affected
        assert row.composite_risk_score == pytest.approx(composite, abs=1e-9)
        assert row.nearest_shelter_km == pytest.approx(shelter, abs=0.1001)
        assert row.hospital_count_25km == hospitals


def test_region_edges_are_exclusive(spark):
    points = [(5.0, -80.0), (0.0, -60.0), (30.0, -100.0), (50.0, -100.0), (40.0, -120.0), (40.0, -70.0)]
    rows = spark.createDataFrame(points, "a double, b double")
    assert {r[0] for r in rows.select(geo.region_type(F.col("a"), F.col("b"))).collect()} == {"suburban"}


@pytest.mark.parametrize(
    ("name", "code"),
    [
        ("Wildfire Warning", 0),
        ("earthquake", 1),
        ("Hurricane", 2),
        ("Flash Flood", 4),
        ("Severe Thunderstorm Warning", 12),
        ("  FOG \t\n", 14),
        ("unusual_unknown_event", 0),
        ("Excessive Heat Warning", 11),
        ("", 6),
    ],
)
def test_event_type_code(spark, name, code):
    assert one(spark, features.event_type_code(F.lit(name)))[0] == pytest.approx(code / 15)


def test_digest_mod_matches_big_integers(spark):
    import hashlib

    words = [f"word {i}" for i in range(50)]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    found = rows.select(
        "w",
        text.digest_mod(F.md5("w"), 32, 15).alias("m"),
        text.digest_mod(F.sha2("w", 256), 64, 20).alias("s"),
        text.digest_mod(F.sha2("w", 256), 64, 97).alias("p"),
    ).collect()
    for r in found:
        sha = int(hashlib.sha256(r.w.encode()).hexdigest(), 16)
        assert r.m == int(hashlib.md5(r.w.encode()).hexdigest(), 16) % 15
        assert (r.s, r.p) == (sha % 20, sha % 97)


VECTORS = [
    (("wildfire", 7.2, 34.05, -118.24, 2, 0, 1013.626687, 0.72), [0, 0.036, 0.050681, 0.72, 0, 0.63, 0.9, 0.65, 0.19, 0.78]),
    (("earthquake", 6.2, 37.77, -122.41, 14, 3, 1000.0, 0.5), [0.066667, 0.62, 0.05, 0.5, 0.3, 1, 0.4, 0.41, 0.446, 0.2]),
    (("hurricane", 150.0, 25.77, -80.19, 18, 12, 1000.0, 0.5), [0.133333, 0.75, 0.05, 0.5, 1, 1, 0.7, 0.41, 0.846, 1]),
    (("flood", -4.0, -1.0, 10.0, 8, 0, 1000.0, 0.5), [0.266667, -0.02, 0.05, 0.5, 0, -0.35, 0.7, 0.333333, 0.8, 0.2]),
]


@pytest.mark.parametrize(("given", "expected"), VECTORS)
def test_feature_vector(spark, given, expected):
    kind, magnitude, lat, lon, hour, prior, density, vulnerability = given
    columns = features.model_features(
        F.lit(kind),
        F.lit(magnitude),
        F.lit(lat),
        F.lit(lon),
        F.make_timestamp_ntz(*[F.lit(x) for x in (2024, 1, 1, hour, 30, 0)]),
        F.lit(prior),
        F.lit(density),
        F.lit(vulnerability),
    )
    assert list(columns) == dims.MODEL_FEATURES
    assert one(spark, *columns.values()) == pytest.approx(expected, abs=1e-6)


def test_missing_magnitude_is_zero_and_not_the_maximum(spark):
    nothing = F.lit(None).cast("double")
    assert one(
        spark,
        features.magnitude_score(nothing, F.lit("flood")),
        features.network_degradation(nothing, F.lit("tsunami")),
        features.weather_compounding(nothing, F.lit("wildfire")),
        features.density_score(nothing),
        features.prior_count_score(F.lit(None)),
    ) == (0.0, 0.0, 0.3, 0.05, 0.0)


def test_hour_is_the_local_one(spark):
    from hazardflow import schemas
    from hazardflow.sources import requests

    body = '{"event_id":"a","event_type":"fog","latitude":1,"longitude":2,"timestamp":"2024-05-01T23:30:00-07:00"}'
    rows = spark.createDataFrame([(body,)], "value string")
    checked = requests.checked_requests(requests.parse_requests(rows))
    found = checked.select(
        features.time_of_day_risk(F.col("_local_ts")).alias("risk"), F.col("ts").cast("string").alias("ts")
    ).first()
    assert tuple(found) == (0.9, "2024-05-02 06:30:00")
    assert schemas.REQUEST.names[-1] == "_corrupt_record"


@pytest.mark.parametrize(
    ("state", "area", "expected"),
    [
        ("CA", 500.0, (0.5, 195.8, 97900, "HIGH")),
        ("TX", 1500.0, (0.3, 68.64, 102960, "MEDIUM")),
        ("DC", 100.0, (0.9, 12851.16, 1285115, "HIGH")),
        ("IA", 300.0, (0.3, 40.0, 12000, "LOW")),
        ("AK", 10.0, (0.1, 0.6, 6, "HIGH")),
    ],
)
def test_population(spark, state, area, expected):
    rows = spark.createDataFrame(
        [(0.0, 0.0, area, state)], "latitude double, longitude double, affected_area_sq_km double, state_code string"
    )
    r = enrich.population(rows).first()
    found = (r.urban_fraction, r.density_per_sq_km, r.estimated_population, r.population_confidence)
    assert found[2:] == expected[2:]
    assert found[:2] == pytest.approx(expected[:2])


def test_scaled_defaults(spark):
    columns = quality.preprocess({})
    values = dict(zip(columns, one(spark, *columns.values()), strict=True))
    assert values["distance_to_nearest_hospital_km"] == pytest.approx(0.1)
    assert values["elevation_meters"] == pytest.approx(0.010989, abs=1e-6)
    assert values["time_since_last_event_hours"] == pytest.approx(0.082192, abs=1e-6)
    assert values["historical_severity_avg"] == 0.5
    assert values["network_degradation_index"] == values["prior_24h_event_count"] == 0.0
    assert list(values) == dims.INPUT_NAMES


def test_quality_rules(spark):
    rows = spark.createDataFrame(
        [(0, 999.0), (1, float("nan")), (2, None), (3, float("inf")), (4, -5.0)], "i int, m double"
    )
    base = {n: F.lit(0.0) for n in dims.INPUT_NAMES}
    good, bad = enrich.quality_checked(rows, base | {"magnitude_or_wind_speed": F.col("m")})
    assert {r.i: r.in_magnitude_or_wind_speed for r in good.collect()} == {0: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}
    assert {r.i: r.quality_errors for r in bad.collect()} == {1: ["magnitude_or_wind_speed: NaN"]}
    strict_good, strict_bad = enrich.quality_checked(rows, base | {"magnitude_or_wind_speed": F.col("m")}, strict=True)
    assert strict_good.count() == 3
    reasons = {r.i: r.quality_errors for r in strict_bad.collect()}
    assert reasons[2] == ["magnitude_or_wind_speed: missing"]


def test_given_inputs_reject_what_values_reject(spark):
    schema = "i int, magnitude double, latitude double, longitude double, extra map<string,double>"
    nan = float("nan")
    rows = spark.createDataFrame(
        [(0, 1.0, 10.0, 10.0, {}), (1, nan, 10.0, 10.0, {}), (2, 1.0, nan, 1.0, {}), (3, nan, 1.0, 1.0, {"magnitude_or_wind_speed": 2.0}),
         (4, 1.0, 1.0, 1.0, {"elevation_meters": nan}), (5, None, 1.0, 1.0, {}), (6, 1.0, 1.0, 1.0, {"unknown": nan})],
        schema,
    )
    located = enrich.geo_risk(rows)
    values = enrich.raw_inputs(extra="extra")
    short, _ = enrich.quality_checked(located, values, enrich.given_inputs(extra="extra"))
    full, _ = enrich.quality_checked(located, values)
    assert {r.i for r in short.collect()} == {r.i for r in full.collect()} == {0, 3, 5, 6}


def test_unfitted_strategies_leave_values(spark):
    values = {n: F.lit(1.0) for n in dims.INPUT_NAMES}
    for strategy in (quality.Scaling.NONE, quality.Scaling.Z_SCORE, quality.Scaling.ROBUST):
        assert one(spark, quality.preprocess(values, strategy)["elevation_meters"])[0] == 1.0


def test_feature_key_ignores_order_and_negative_zero(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (-0.0, 1.0), (1.0, 0.0)], "b double, a double")
    keys = [r[0] for r in rows.select(decisions.feature_key(["b", "a"])).collect()]
    swapped = [r[0] for r in rows.select(decisions.feature_key(["a", "b"])).collect()]
    assert keys == swapped and keys[0] == keys[1] != keys[2]


@pytest.mark.parametrize(
    ("value", "bound"), [(0.0, 1.0), (1.0, 1.0), (1.01, 5.0), (5.0, 5.0), (1000.0, 1000.0), (1000.1, math.inf)]
)
def test_latency_buckets(spark, value, bound):
    assert one(spark, metrics.bucket_bound(F.lit(value)))[0] == bound


def test_quantile_edges(spark):
    rows = spark.createDataFrame([(5000.0,), (6000.0,)], "latency_ms double").withColumn(
        "ts", F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")
    )
    found = metrics.histogram_quantiles(rows).first()
    assert (found.p50, found.p99) == (1000.0, 1000.0)
    low = rows.withColumn("latency_ms", F.lit(0.5))
    assert metrics.histogram_quantiles(low).first().p50 == 0.5
    assert metrics.histogram_quantiles(rows.limit(0)).count() == 0


SQUARE = "0,0 0,2 2,2 2,0"


@pytest.mark.parametrize(
    ("ring", "point", "inside"),
    [
        (SQUARE, (1, 1), True),
        (SQUARE, (5, 1), False),
        (SQUARE, (0, 1), False),
        (SQUARE, (2, 1), False),
        (SQUARE, (0, 0), False),
        (SQUARE, (1, 0), False),
        (SQUARE + " 0,0", (1, 1), True),
        (SQUARE + " 0,0", (1, 0), False),
        ("0,0 1,1", (0.5, 0.5), False),
        ("0,0 4,0 4,4 2,1 0,4", (3.5, 1), True),
        ("0,0 4,0 4,4 2,1 0,4", (2, 3), False),
    ],
)
def test_point_in_polygon(spark, ring, point, inside):
    edges = geo.ring_edges(geo.parse_polygon(F.lit(ring)))
    lat, lon = (F.lit(float(v)) for v in point)
    assert one(spark, geo.inside_ring(lat, lon, edges))[0] is inside


def test_polygon_parsing(spark):
    texts = [" 1,2  3,4\n5,6 ", "   ", None, "1,2 x,4", "1,2,3 4,5", "1 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = geo.parse_polygon(F.col("t"))
    found = {r.i: (r.n, r.ok) for r in rows.select("i", F.size(parsed).alias("n"), geo.polygon_ok(parsed).alias("ok")).collect()}
    assert found[0] == (3, True)
    assert found[1][1] and found[2][1]
    assert not any(found[i][1] for i in (3, 4, 5))


def test_drift_text(spark):
    message = decisions.drift_text(F.lit("MINOR"), F.lit(0.4), F.lit("CRITICAL"))
    assert one(spark, message)[0] == "Critical drift in MINOR: 40.0% from baseline"
    message = decisions.drift_text(F.lit("MINOR"), F.lit(0.2), F.lit("WARNING"))
    assert one(spark, message)[0] == "Drift detected in MINOR: 20.0% from baseline"


def test_wall_clock_micros(spark):
    ts = F.lit("2024-03-10 02:30:00.000001").cast("timestamp_ntz")
    assert one(spark, times.micros(ts))[0] == 1710037800000001


def test_unknown_classes(spark):
    assert one(spark, decisions.cap_severity(F.lit("extreme")), decisions.channels(F.lit("x"))) == (None, None)
    assert one(spark, decisions.cap_severity(F.lit(None).cast("string")))[0] is None
    assert one(spark, decisions.escalation_likely(F.lit(None).cast("double")))[0] is False
    assert one(spark, decisions.escalation_likely(F.lit(0.65)))[0] is True
