"""Events inside alert polygons, by an equi-join on grid cells.

Polygons differ in size by orders of magnitude, so each is registered on the one grid level where its box
covers only a few cells, and an event looks itself up once for each level that holds polygons. A polygon of any size thus
yields at most 25 cells, and an event meets a polygon at most once, so no duplicates need removing.

Where many events meet many polygons in one cell, the cell is split: its polygons move to those of its 64 parts that their
boxes touch, level by level, as a quadtree over the density of the events does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardflow.functions.geo import inside_ring, ring_edges
from hazardflow.operators.ranges import stored

LEVEL_FACTOR = 8.0
CELLS_PER_SIDE = 4.0
# Levels below the given cell size; only split cells use them.
FINER = 2
# Candidate pairs of one cell above which it is split.
MOST_PAIRS = 2_000_000


def _sizes(cell: float) -> list[float]:
    """Cell sizes per level; the last one holds boxes as large as the globe."""
    sizes = [cell / LEVEL_FACTOR**i for i in range(FINER, -1, -1)]
    while sizes[-1] * CELLS_PER_SIDE < 360.0:
        sizes.append(sizes[-1] * LEVEL_FACTOR)
    return sizes


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("bigint")


def polygon_cells(polygons: DataFrame, ring: str, cell: float) -> DataFrame:
    """One row per polygon and grid cell its box touches, with box and edges."""
    boxed = polygons.where(F.size(ring) >= 3).withColumns(
        {
            "_lat0": F.array_min(F.transform(ring, lambda p: p["lat"])),
            "_lat1": F.array_max(F.transform(ring, lambda p: p["lat"])),
            "_lon0": F.array_min(F.transform(ring, lambda p: p["lon"])),
            "_lon1": F.array_max(F.transform(ring, lambda p: p["lon"])),
            "_edges": ring_edges(F.col(ring)),
        }
    )
    extent = F.greatest(F.col("_lat1") - F.col("_lat0"), F.col("_lon1") - F.col("_lon0"))
    sizes = _sizes(cell)
    level, size = F.lit(len(sizes) - 1), F.lit(sizes[-1])
    for i, width in reversed(list(enumerate(sizes))[FINER:-1]):
        fits = extent <= F.lit(width * CELLS_PER_SIDE)
        level, size = F.when(fits, F.lit(i)).otherwise(level), F.when(fits, F.lit(width)).otherwise(size)
    leveled = boxed.withColumns({"_level": level, "_size": size})

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(_cell(F.col(low), F.col("_size")), _cell(F.col(high), F.col("_size"))))

    return (
        leveled.withColumn("_cy", span("_lat0", "_lat1")).withColumn("_cx", span("_lon0", "_lon1")).drop("_size", ring)
    )


def split_cells(cells: DataFrame, events: DataFrame, lat: str, lon: str, cell: float, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The polygons' cells with heavy ones split: no cell of more than ``most_pairs`` candidate pairs is left above the finest level.

    Events are counted once, by cells of the second-finest level, of which the globe has a fixed number.
    """
    sizes = _sizes(cell)
    at = ["_level", "_cy", "_cx"]
    fine = [_cell(F.col(c), F.lit(sizes[1])).alias(n) for c, n in ((lat, "_cy"), (lon, "_cx"))]
    density = stored(events.groupBy(*fine).agg(F.count(F.lit(1)).alias("_n")), "density")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("_level"), F.lit(LEVEL_FACTOR ** (i - 1)).alias("by")) for i in range(1, len(sizes))]))
    coarse = density.select("_n", "_cy", "_cx", steps.alias("s")).groupBy(
        F.col("s._level").alias("_level"), _cell(F.col("_cy"), F.col("s.by")).alias("_cy"), _cell(F.col("_cx"), F.col("s.by")).alias("_cx")
    )
    events_in = stored(coarse.agg(F.sum("_n").alias("_n")), "density")

    def heavy(held: DataFrame) -> DataFrame:
        polygons_in = held.groupBy(*at).agg(F.count(F.lit(1)).alias("_p")).where("_p > 1")
        return polygons_in.join(events_in, at).where(F.col("_n") * F.col("_p") > most_pairs).select(*at)

    sides = len(sizes) - 1
    cells = stored(cells, "cells")
    for _ in range(sides):
        split = stored(heavy(cells).where("_level > 0"), "heavy")
        if split.isEmpty():
            break
        parts = cells.join(split, at)
        below = F.element_at(F.lit(sizes), F.col("_level"))  # positions count from one: the next finer level

        def span(index: str, low: str, high: str) -> Column:
            first = F.greatest(F.col(index) * int(LEVEL_FACTOR), _cell(F.col(low), below))
            last = F.least(F.col(index) * int(LEVEL_FACTOR) + int(LEVEL_FACTOR) - 1, _cell(F.col(high), below))
            return F.explode(F.when(first <= last, F.sequence(first, last)))

        parts = parts.withColumn("_y", span("_cy", "_lat0", "_lat1")).withColumn("_x", span("_cx", "_lon0", "_lon1"))
        parts = parts.withColumns({"_level": F.col("_level") - 1, "_cy": F.col("_y"), "_cx": F.col("_x")}).drop("_y", "_x")
        cells = stored(cells.join(split, at, "left_anti").unionByName(parts), "cells")
    return cells


def containment_pairs(
    events: DataFrame,
    polygons: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    ring: str = "polygon",
    cell: float = 2.0,
    most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """Each event with each polygon it lies strictly inside of (columns of both, without the ring).

    On a stream of events no cell is split, since that needs their counts.
    """
    cells = polygon_cells(polygons, ring, cell)
    if not events.isStreaming:
        cells = split_cells(cells, events, lat, lon, cell, most_pairs)
    used = {r["_level"] for r in cells.select("_level").distinct().collect()} or {0}
    levels = F.array(
        *[
            F.struct(
                F.lit(i).alias("level"),
                _cell(F.col(lat), F.lit(size)).alias("cy"),
                _cell(F.col(lon), F.lit(size)).alias("cx"),
            )
            for i, size in enumerate(_sizes(cell))
            if i in used
        ]
    )
    located = events.withColumn("_at", F.explode(levels)).select(
        "*", F.col("_at.level").alias("_level"), F.col("_at.cy").alias("_cy"), F.col("_at.cx").alias("_cx")
    )
    candidates = located.drop("_at").join(cells, ["_level", "_cy", "_cx"])
    la, lo = F.col(lat), F.col(lon)
    in_box = la.between(F.col("_lat0"), F.col("_lat1")) & lo.between(F.col("_lon0"), F.col("_lon1"))
    inside = candidates.where(in_box).where(inside_ring(la, lo, F.col("_edges")))
    return inside.drop("_level", "_cy", "_cx", "_lat0", "_lat1", "_lon0", "_lon1", "_edges")


def _covered_ids(events: DataFrame, polygons: DataFrame, event_id: str, lat: str, lon: str, ring: str, cell: float):
    narrow = events.select(F.col(event_id), F.col(lat), F.col(lon))
    return containment_pairs(narrow, polygons.select(ring), lat, lon, ring, cell).select(event_id).distinct()


def events_under_alert(
    events: DataFrame,
    polygons: DataFrame,
    event_id: str = "event_id",
    lat: str = "latitude",
    lon: str = "longitude",
    ring: str = "polygon",
    cell: float = 2.0,
) -> DataFrame:
    """Events inside at least one polygon, each once."""
    return events.join(_covered_ids(events, polygons, event_id, lat, lon, ring, cell), event_id, "left_semi")


def events_outside_alerts(
    events: DataFrame,
    polygons: DataFrame,
    event_id: str = "event_id",
    lat: str = "latitude",
    lon: str = "longitude",
    ring: str = "polygon",
    cell: float = 2.0,
) -> DataFrame:
    """Events inside no polygon."""
    return events.join(_covered_ids(events, polygons, event_id, lat, lon, ring, cell), event_id, "left_anti")


def mark_alerts(
    events: DataFrame,
    polygons: DataFrame,
    event_id: str = "event_id",
    lat: str = "latitude",
    lon: str = "longitude",
    ring: str = "polygon",
    cell: float = 2.0,
) -> DataFrame:
    """Every event with ``under_alert``: those under and those outside of alerts from one pass."""
    covered = _covered_ids(events, polygons, event_id, lat, lon, ring, cell).withColumn("under_alert", F.lit(True))
    return events.join(covered, event_id, "left").fillna(False, ["under_alert"])
