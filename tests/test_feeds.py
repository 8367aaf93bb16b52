"""Feed, request and table readers over small files."""

import json

import pytest
from pyspark.sql import functions as F

from hazardflow import schemas
from hazardflow.operators import feeds as bookkeeping
from hazardflow.sources import feeds, requests, sinks, tables
from hazardflow.streaming import jobs

ENTRY = """<entry><id>{id}</id><cap:event>Red Flag Warning</cap:event><cap:severity>Severe</cap:severity>
<cap:urgency>Expected</cap:urgency><cap:areaDesc>Somewhere</cap:areaDesc><cap:polygon>{polygon}</cap:polygon>
<cap:sent>{sent}</cap:sent><cap:expires>2024-05-02T01:00:00Z</cap:expires>
<cap:headline>Dry &amp; windy</cap:headline></entry>"""
FEED = (
    '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" '
    'xmlns:cap="urn:oasis:names:tc:emergency:cap:1.2"><title>t</title>{}</feed>'
)
BOX = "34.0,-118.0 34.0,-117.0 35.0,-117.0 35.0,-118.0 34.0,-118.0"


def cap_file(folder, name="feed.xml", entries=None):
    entries = entries or [
        ENTRY.format(id="good", polygon=BOX, sent="2024-05-01T23:30:00-07:00"),
        ENTRY.format(id="blank", polygon="", sent="2024-05-01T10:00:00Z"),
        ENTRY.format(id="bad-time", polygon=BOX, sent="yesterday"),
        ENTRY.format(id="bad-pair", polygon="34.0,-118.0 35.0", sent="2024-05-01T10:00:00Z"),
    ]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(FEED.format("".join(entries)))
    return str(folder)


def test_cap_feed(spark, tmp_path):
    path = cap_file(tmp_path / "cap")
    alerts = {r.alert_id: r for r in feeds.read_cap_feed(spark, path, keep_xml=True).collect()}
    assert set(alerts) == {"good", "blank"}
    good = alerts["good"]
    assert len(good.polygon) == 5 and (good.polygon[0].lat, good.polygon[0].lon) == (34.0, -118.0)
    assert (good.headline, good.certainty, good.description) == ("Dry & windy", "", "")
    assert "Red Flag Warning" in good.raw_xml
    assert alerts["blank"].polygon is None
    times = feeds.read_cap_feed(spark, path).select(
        "alert_id", F.col("issued_at").cast("string").alias("at"), F.col("issued_local").cast("string").alias("local")
    )
    found = {r.alert_id: (r.at, r.local) for r in times.collect()}
    assert found["good"] == ("2024-05-02 06:30:00", "2024-05-01 23:30:00")
    rejected = feeds.read_cap_feed(spark, path, quarantine=True)
    assert {r.alert_id for r in rejected.collect()} == {"bad-time", "bad-pair"}


def seismic_file(folder, name="quakes.geojson", count=3):
    def feature(i, mag, **extra):
        properties = {"mag": mag, "time": 1714500000000 + i, "tsunami": i % 2, **extra}
        return {"id": f"q{i}", "properties": properties, "geometry": {"coordinates": [-122.5, 37.75, 8.1]}}

    body = {"type": "FeatureCollection", "features": [feature(0, 6.2, magType="mw", felt=12), feature(1, 2.5), feature(2, 2.4), feature(3, None)][: count + 1]}
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(body, indent=1))
    return str(folder)


def test_seismic_feed(spark, tmp_path):
    path = seismic_file(tmp_path / "quakes")
    rows = {r.event_id: r for r in feeds.read_seismic(spark, path).collect()}
    assert set(rows) == {"q0", "q1"}
    first, second = rows["q0"], rows["q1"]
    assert (first.latitude, first.longitude, first.depth_km) == (37.75, -122.5, 8.1)
    assert (first.magnitude_type, first.felt_count, first.tsunami_flag) == ("mw", 12, False)
    assert (second.magnitude_type, second.felt_count, second.tsunami_flag, second.place) == ("unknown", 0, True, "")
    assert feeds.read_seismic(spark, path, min_magnitude=7.0).count() == 0
    at = feeds.read_seismic(spark, path).select(F.unix_millis("occurred_at")).collect()
    assert {r[0] for r in at} == {1714500000000, 1714500000001}


def warning_file(folder):
    body = {
        "features": [
            {
                "id": "w1",
                "type": "Feature",
                "properties": {"event": "Flood Warning", "severity": "Moderate", "sent": "2024-05-01T08:00:00+02:00", "odd": [1, 2]},
                "geometry": {"type": "Polygon", "coordinates": [[[10.0, 50.0], [11.0, 50.0], [11.0, 51.0], [10.0, 50.0]]]},
            },
            {"properties": {"id": "w2", "event": "Fog Advisory"}, "geometry": None},
        ]
    }
    folder.mkdir(exist_ok=True)
    (folder / "warnings.json").write_text(json.dumps(body))
    return str(folder)


def test_warnings(spark, tmp_path):
    path = warning_file(tmp_path / "warnings")
    rows = {r.id: r for r in feeds.read_warnings(spark, path).drop("feature").collect()}
    assert set(rows) == {"w1", "w2"}
    assert rows["w1"].event == "Flood Warning" and rows["w1"].polygon[0].lat == 50.0
    assert rows["w2"].polygon is None and rows["w2"].severity == ""
    tail = feeds.read_warnings(spark, path).select("id", F.try_variant_get("feature", "$.properties.odd[1]", "int").alias("v"))
    assert {r.id: r.v for r in tail.collect()} == {"w1": 2, "w2": None}


@pytest.mark.parametrize("text", ["not json", "{}", '{"features": 3}', "[]"])
def test_unusable_warning_file_gives_no_rows(spark, tmp_path, text):
    (tmp_path / "w.json").write_text(text)
    assert feeds.read_warnings(spark, str(tmp_path)).count() == 0


def test_normalization(spark, tmp_path):
    cap, quakes, warnings = (cap_file(tmp_path / "c"), seismic_file(tmp_path / "q"), warning_file(tmp_path / "w"))
    events = feeds.normalize(
        feeds.read_cap_feed(spark, cap), feeds.read_seismic(spark, quakes), feeds.read_warnings(spark, warnings)
    )
    assert events.drop("_local_ts").columns == schemas.EVENT.names
    rows = {r.event_id: r for r in events.collect()}
    assert (rows["good"].lat, rows["good"].lon, rows["good"].magnitude) == (34.5, -117.5, None)
    assert (rows["q0"].event_type, rows["q0"].source, rows["q0"].cap_severity) == ("earthquake", "usgs", None)
    assert rows["blank"].lat is None and rows["w2"].lat is None
    counts = {r.source: r.item_count for r in bookkeeping.item_counts(events).collect()}
    assert counts == {"noaa": 2, "usgs": 2, "nws": 2}


def test_unexpired(spark, tmp_path):
    alerts = feeds.read_cap_feed(spark, cap_file(tmp_path / "c"))
    assert feeds.unexpired(alerts, F.lit("2024-05-02 01:00:00").cast("timestamp")).count() == 2
    assert feeds.unexpired(alerts, F.lit("2024-05-02 01:00:01").cast("timestamp")).count() == 0


def test_requests(spark, tmp_path):
    lines = [
        {"event_id": "ok", "event_type": "fog", "latitude": 90, "longitude": -180, "additional_features": {"x": 1}},
        {"event_id": "far", "event_type": "fog", "latitude": 90.1, "longitude": 0},
        {"event_type": "fog", "latitude": 0, "longitude": 0},
        {"event_id": "seq", "event_type": "fog", "latitude": 0, "longitude": 0, "sensor_sequence": [[1.0] * 15] * 24},
        {"event_id": "when", "event_type": "fog", "latitude": 0, "longitude": 0, "timestamp": "soon"},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n{oops\n")
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    good, bad = requests.split_requests(requests.checked_requests(requests.read_requests(spark, str(tmp_path)), as_of))
    rows = {r.event_id: r for r in good.collect()}
    assert set(rows) == {"ok", "seq"}
    assert rows["ok"].magnitude == 0.0 and rows["ok"].additional_features == {"x": 1.0}
    reasons = sorted("|".join(r.problems) for r in bad.collect())
    assert reasons[:3] == ["event_id missing", "latitude out of range", "malformed record|event_id missing|event_type missing|latitude missing|longitude missing"]
    assert reasons[3] == "timestamp unreadable"
    answers = jobs.triage_rows(good, None)[0].collect()
    assert {r.event_id for r in answers} == {"ok", "seq"} and {r.severity for r in answers} == {"MODERATE"}


def test_training_events_by_name(spark, tmp_path):
    names = [f"feature_{i}" for i in range(10)] + ["severity", "event_id"]
    (tmp_path / "t.csv").write_text(",".join(names) + "\n" + ",".join(["0.5"] * 10 + ["MINOR", "e1"]) + "\n")
    row = tables.read_training_events(spark, str(tmp_path)).first()
    assert (row.feature_9, row.severity, row.event_id) == (0.5, "MINOR", "e1")
    tables.read_training_events(spark, str(tmp_path)).write.parquet(str(tmp_path / "p"))
    assert tables.read_training_events(spark, str(tmp_path / "p"), "parquet").first() == row


def test_sequence_table(spark, tmp_path):
    rows = [([[0.5] * 15] * 24, 1.0), ([[0.5] * 15] * 23, 0.0)]
    spark.createDataFrame(rows, schemas.SEQUENCE).write.parquet(str(tmp_path / "s"))
    assert sorted(r.valid for r in tables.read_sequences(spark, str(tmp_path / "s")).collect()) == [False, True]


def test_messages_keep_null_fields(spark):
    rows = spark.createDataFrame([("e1", None, ["a"])], "event_id string, p double, channels array<string>")
    message = sinks.keyed_messages(rows).first()
    assert message.key == "e1"
    assert json.loads(message.value) == {"event_id": "e1", "p": None, "channels": ["a"]}


def test_status_without_polls(spark):
    empty = spark.createDataFrame([], "source string, item_count long, polled_at timestamp, seq long")
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = bookkeeping.status_report(bookkeeping.latest_status(empty), as_of).collect()
    assert sorted((r.source, r.status, r.item_count) for r in rows) == [
        ("noaa", "initializing", 0), ("nws", "initializing", 0), ("usgs", "initializing", 0)
    ]


@pytest.mark.parametrize(("age", "status"), [(300.0, "HEALTHY"), (300.1, "STALE")])
def test_staleness_limit(spark, age, status):
    polls = spark.createDataFrame([("noaa",)], "source string").withColumn("polled_at", F.timestamp_micros(F.lit(0)))
    as_of = F.timestamp_micros(F.lit(int(age * 1_000_000)))
    row = bookkeeping.staleness(polls, as_of).first()
    assert (row.status, row.last_poll_seconds_ago) == (status, age)
