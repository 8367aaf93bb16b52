"""Geographic risk columns and point-in-polygon tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from hazardflow import dims
from hazardflow.functions.text import strip
from hazardflow.functions.times import round_half_up

RADIUS_KM = 25.0
AFFECTED_SHARE = 0.3


def _num(value: float) -> Column:
    return F.lit(float(value))


def region_type(lat: Column, lon: Column) -> Column:
    """Coarse region class; all box edges are exclusive and the coastal box wins."""
    coastal = (F.abs(lat) < _num(5)) & (F.abs(lon + _num(80)) < _num(20))
    urban = (lat > _num(30)) & (lat < _num(50)) & (lon > _num(-120)) & (lon < _num(-70))
    return F.when(coastal, "coastal").when(urban, "urban_high_density").otherwise("suburban")


def pseudo_density(lat: Column, lon: Column) -> Column:
    """People per square kilometre. Degrees enter the sine and cosine unconverted by definition."""
    return F.greatest(_num(500), _num(5000) * F.abs(F.sin(lat)) * F.abs(F.cos(lon)))


def vulnerability(region: Column) -> Column:
    """Vulnerability of a region class, with a neutral default."""
    entries = [part for name, score in dims.VULNERABILITY.items() for part in (F.lit(name), _num(score))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), region), _num(dims.DEFAULT_VULNERABILITY))


def coastal_proximity(lon: Column) -> Column:
    return F.least(_num(1), _num(1) / (_num(1) + _num(0.1) * F.abs(lon + _num(80))))


def shelter_km(lat: Column) -> Column:
    """Distance to the nearest shelter; the modulo is floored, so southern latitudes stay positive."""
    return round_half_up(F.abs(F.pmod(lat, _num(5))) * _num(2.5) + _num(1.2), 1)


def hospital_count(lat: Column) -> Column:
    """At least one; a latitude that is no number counts as none, so that a rejected row can still be looked at."""
    return F.greatest(F.lit(1), (F.abs(lat) % _num(8)).try_cast("int") + F.lit(2))


def affected_population(density: Column) -> Column:
    """People within the radius who are affected, truncated; null if the density is no number."""
    return (density * _num(math.pi) * _num(RADIUS_KM**2) * _num(AFFECTED_SHARE)).try_cast("bigint")


def composite_risk(vulnerability_score: Column, density: Column, lon: Column) -> Column:
    exposure = F.least(density / _num(10000), _num(1))
    risk = _num(0.4) * vulnerability_score + _num(0.3) * exposure + _num(0.3) * coastal_proximity(lon)
    return round_half_up(risk, 4)


def infer_state(lat: Column, lon: Column) -> Column:
    """First matching state box; edges are exclusive."""
    boxes = [
        # State, latitude range, longitude range.
        ("CA", 32.5, 42.0, -124.5, -114.0),
        ("FL", 25.0, 31.0, -88.0, -80.0),
        ("NY", 40.0, 45.0, -80.0, -72.0),
        ("TX", 25.8, 36.5, -106.6, -93.5),
    ]
    inside = [
        F.when(
            (lat > _num(south)) & (lat < _num(north)) & (lon > _num(west)) & (lon < _num(east)), F.lit(state)
        )
        for state, south, north, west, east in boxes
    ]
    return F.coalesce(*inside, F.lit("US"))


def urban_fraction(density: Column) -> Column:
    return (
        F.when(density > _num(200), _num(0.9))
        .when(density > _num(100), _num(0.7))
        .when(density > _num(50), _num(0.5))
        .when(density > _num(20), _num(0.3))
        .otherwise(_num(0.1))
    )


def parse_polygon(text: Column) -> Column:
    """``"lat,lon lat,lon …"`` as an array of points.

    Blank text gives null. A pair that is not two numbers gives an array with a null field; test the
    result with :func:`polygon_ok`.
    """
    clean = strip(text)
    points = F.transform(
        F.split(clean, r"\s+"),
        lambda pair: F.struct(
            F.when(F.size(F.split(pair, ",")) == 2, F.split(pair, ",")[0].try_cast("double")).alias("lat"),
            F.when(F.size(F.split(pair, ",")) == 2, F.split(pair, ",")[1].try_cast("double")).alias("lon"),
        ),
    )
    return F.when(clean != "", points)


def polygon_ok(polygon: Column) -> Column:
    """False when any point failed to parse; a missing polygon is fine."""
    return F.coalesce(
        F.forall(polygon, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), F.lit(True)
    )


def ring_edges(ring: Column) -> Column:
    """The closed ring as an array of edges ``(lat1, lon1, lat2, lon2)``."""
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p["lat"].alias("lat1"),
            p["lon"].alias("lon1"),
            F.element_at(ring, ((i + 1) % F.size(ring) + 1).cast("int"))["lat"].alias("lat2"),
            F.element_at(ring, ((i + 1) % F.size(ring) + 1).cast("int"))["lon"].alias("lon2"),
        ),
    )


def inside_ring(lat: Column, lon: Column, edges: Column) -> Column:
    """Strictly inside by the even-odd rule; points on an edge and rings of fewer than 3 points are outside."""
    crossings = F.filter(
        edges,
        lambda e: ((e["lat1"] > lat) != (e["lat2"] > lat))
        & (lon < (e["lon2"] - e["lon1"]) * (lat - e["lat1"]) / (e["lat2"] - e["lat1"]) + e["lon1"]),
    )
    on_edge = F.exists(
        edges,
        lambda e: (
            (e["lat2"] - e["lat1"]) * (lon - e["lon1"]) == (e["lon2"] - e["lon1"]) * (lat - e["lat1"])
        )
        & lat.between(F.least(e["lat1"], e["lat2"]), F.greatest(e["lat1"], e["lat2"]))
        & lon.between(F.least(e["lon1"], e["lon2"]), F.greatest(e["lon1"], e["lon2"])),
    )
    return F.coalesce((F.size(edges) >= 3) & (F.size(crossings) % 2 == 1) & ~on_edge, F.lit(False))


def vertex_mean(polygon: Column, field: str) -> Column:
    """Mean of one coordinate over the distinct vertices of a ring."""
    points = F.array_distinct(polygon)
    total = F.aggregate(points, _num(0), lambda acc, p: acc + p[field])
    return F.when(F.size(points) > 0, total / F.size(points))
