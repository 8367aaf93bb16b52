"""The grid join against a plain loop, over polygons from a tenth of a degree to the whole globe."""

import random

import pytest
from pyspark.sql import functions as F

from hazardflow.operators import spatial


def inside(lat, lon, ring):
    if len(ring) < 3:
        return False
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y2 - y1) * (lon - x1) == (x2 - x1) * (lat - y1) and min(y1, y2) <= lat <= max(y1, y2) and min(x1, x2) <= lon <= max(x1, x2):
            return False
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(5)
    rings = []
    for i in range(80):
        size = 10 ** rng.uniform(-1, 2.4)
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        sides = rng.choice([2, 3, 4, 6, 9])
        rings.append((i, [(lat + rng.uniform(0, size), lon + rng.uniform(0, size)) for _ in range(sides)]))
    rings.append((80, [(0.0, 0.0), (0.0, 8.0), (8.0, 8.0), (8.0, 0.0)]))
    rings.append((81, [(-90.0, -180.0), (-90.0, 180.0), (90.0, 180.0), (90.0, -180.0)]))
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)]
    # Points on edges, corners and cell borders.
    points += [(200 + i, float(y), float(x)) for i, (y, x) in enumerate([(0, 4), (8, 8), (4, 4), (2, 2), (4, 8), (16, 16), (-2, -2)])]
    polygons = spark.createDataFrame(
        [(i, [{"lat": y, "lon": x} for y, x in ring]) for i, ring in rings],
        "alert_id int, polygon array<struct<lat:double,lon:double>>",
    )
    events = spark.createDataFrame(points, "event_id int, latitude double, longitude double")
    expected = {(p, i) for p, y, x in points for i, ring in rings if inside(y, x, ring)}
    return events, polygons, expected


@pytest.mark.parametrize("cell", [0.5, 2.0, 100.0])
def test_containment(shapes, cell):
    events, polygons, expected = shapes
    found = [tuple(r) for r in spatial.containment_pairs(events, polygons, cell=cell).select("event_id", "alert_id").collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_under_and_outside(shapes):
    events, polygons, expected = shapes
    covered = {p for p, _ in expected}
    under = {r.event_id for r in spatial.events_under_alert(events, polygons).collect()}
    outside = {r.event_id for r in spatial.events_outside_alerts(events, polygons).collect()}
    assert under == covered
    assert outside == {r.event_id for r in events.collect()} - covered


def test_few_cells_per_polygon(shapes):
    _, polygons, _ = shapes
    counts = spatial.polygon_cells(polygons, "polygon", 0.5).groupBy("alert_id").count()
    assert counts.agg(F.max("count")).first()[0] <= 25


def test_shuffle_join_gives_the_same(spark, shapes):
    events, polygons, expected = shapes
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spatial.containment_pairs(events, polygons).select("event_id", "alert_id")
        assert {tuple(r) for r in pairs.collect()} == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [0, 3, 40])
def test_heavy_cells_are_split(shapes, most):
    """Split cells give the same pairs, each once, and leave no heavy cell above the finest level."""
    events, polygons, expected = shapes
    found = [tuple(r) for r in spatial.containment_pairs(events, polygons, most_pairs=most).select("event_id", "alert_id").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    before = spatial.polygon_cells(polygons, "polygon", 2.0)
    after = spatial.split_cells(before, events, "latitude", "longitude", 2.0, most)
    sizes = spatial._sizes(2.0)
    at = {}
    for r in after.collect():
        at.setdefault((r._level, r._cy, r._cx), set()).add(r.alert_id)
    points = [(r.latitude, r.longitude) for r in events.collect()]
    for (level, cy, cx), held in at.items():
        n = sum(y // sizes[level] == cy and x // sizes[level] == cx for y, x in points)
        assert level == 0 or len(held) == 1 or n * len(held) <= most
    assert most == 40 or after.count() > before.count()


def test_events_look_up_used_levels_only(shapes):
    """One polygon lies on one level, so no event is multiplied."""
    events, polygons, _ = shapes
    plan = spatial.containment_pairs(events, polygons.where("alert_id = 80"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("named_struct(level") <= 1


def test_mark_alerts(shapes):
    events, polygons, expected = shapes
    found = {r.event_id: r.under_alert for r in spatial.mark_alerts(events, polygons).collect()}
    assert found == {r.event_id: r.event_id in {p for p, _ in expected} for r in events.collect()}
    assert not any(r.under_alert for r in spatial.mark_alerts(events, polygons.limit(0)).collect())
