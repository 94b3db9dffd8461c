"""Zones and geometries: which polygons hold a point, and how far geometries are from it.

The plane is cut into cells. A geometry's segments are written once for each cell that they pass, so points and geometries meet in equi-joins on
cells and rows of cells, never all with all. Coordinates are degrees, x the longitude; what crosses the line of 180 degrees must be cut there.

Whether a polygon holds a point is told in whole ten-millionths of a degree (a centimetre): products of their differences fit in 64 bits, so points on a
border go the same way in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wkb as wkb_functions
from ..functions.geo import valid_point

#: Metres of a degree of longitude at the equator, and of a degree of latitude.
X_M, Y_M = 111_320.0, 110_574.0
#: Fixed value: units of a degree in which polygons and points are compared.
UNITS = 10_000_000


def _row(y: Column, size: float) -> Column:
    return F.floor(y / F.lit(size)).cast("long")


def by_rows(segments: DataFrame, size: float) -> DataFrame:
    """segments with cy, once for each row of cells that a segment reaches."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    return segments.withColumn("cy", F.explode(F.sequence(_row(lo, size), _row(hi, size))))


def by_cells(segments: DataFrame, size: float) -> DataFrame:
    """segments with cy and cx, once for each cell that a segment passes: in each row, from where it comes in to where it goes out."""
    rows = by_rows(segments, size)
    steep = F.col("y2") != F.col("y1")
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(steep, F.col("y2") - F.col("y1"))
    low, high = F.greatest(F.least("y1", "y2"), F.col("cy") * size), F.least(F.greatest("y1", "y2"), (F.col("cy") + 1) * size)
    a, b = F.coalesce(at(low), F.col("x1")), F.coalesce(at(high), F.col("x2"))
    # A little more on both sides, for what rounding takes away.
    slack = size * 1e-9
    return rows.withColumn("cx", F.explode(F.sequence(_row(F.least(a, b) - slack, size), _row(F.greatest(a, b) + slack, size))))


def cover(areas: DataFrame, key: str, size: float) -> DataFrame:
    """key, cy, from_cx, to_cx, inside: runs of cells. inside is true where whole cells lie in the polygon, and false for a cell that its border passes.

    Between two border cells of a row no border passes, so the middle of the run's first cell tells for all: it is inside if an odd number of
    segments lies to the left at its height.
    """
    border = by_cells(areas, size).select(key, "cy", "cx").distinct()
    row = Window.partitionBy(key, "cy").orderBy("cx")
    gaps = border.withColumn("next", F.lead("cx").over(row)).where("next > cx + 1").select(key, "cy", (F.col("cx") + 1).alias("from_cx"), (F.col("next") - 1).alias("to_cx"))
    middle = gaps.withColumns({"px": (F.col("from_cx") + 0.5) * size, "py": (F.col("cy") + 0.5) * size})
    lines = by_rows(areas, size).select(F.col(key).alias("_k"), F.col("cy").alias("_cy"), "x1", "y1", "x2", "y2")
    met = middle.join(lines, (F.col(key) == F.col("_k")) & (F.col("cy") == F.col("_cy")))
    inside = met.groupBy(key, "cy", "from_cx", "to_cx").agg((F.count_if(_left_of()) % 2 == 1).alias("inside")).where("inside")
    return inside.unionByName(border.select(key, "cy", F.col("cx").alias("from_cx"), F.col("cx").alias("to_cx"), F.lit(False).alias("inside")))


def _left_of() -> Column:
    """Whether the segment lies to the left of (px, py) at its height; the lower end counts, the upper does not. Exact in whole units."""
    crosses = (F.col("y1") <= F.col("py")) != (F.col("y2") <= F.col("py"))
    along, across = (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")), (F.col("px") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return crosses & F.when(F.col("y2") > F.col("y1"), along < across).otherwise(along > across)


def _units(degrees: str) -> Column:
    return F.round(F.col(degrees) * UNITS).cast("long").alias(degrees)


def containing(points: DataFrame, geometries: DataFrame, size: float, key: str = "zone_id") -> DataFrame:
    """id, key for every point (id, lat, lon) and polygon (key, wkb) that holds it. Holes are outside; overlapping polygons each count.

    Points in cells that lie whole in a polygon need the cell alone; the others count the polygon's segments to their left, in their row of
    cells. A point on the border goes to the polygon above or left of it. Points without valid coordinates are in no zone; ids are those of the points.
    """
    areas = wkb_functions.segments(geometries, key, "wkb").where("kind = 'area'")
    return _held(_valid(points), areas, size, key)


def _valid(points: DataFrame) -> DataFrame:
    return points.where(valid_point(F.col("lat"), F.col("lon"))).select("id", F.col("lon").alias("px"), F.col("lat").alias("py"))


def _held(ok: DataFrame, areas: DataFrame, size: float, key: str) -> DataFrame:
    """id, key of the points (px, py) within polygons, of which the segments are given."""
    size = size * UNITS
    flat = areas.select(key, *[_units(c) for c in ("x1", "y1", "x2", "y2")])
    ok = ok.select("id", _units("px"), _units("py"))
    runs = cover(flat, key, size).select(key, F.col("cy").alias("pcy"), F.explode(F.sequence("from_cx", "to_cx")).alias("pcx"), "inside")
    # A repeated point would count its crossings twice.
    hit = ok.select("id", "px", "py").distinct().select("id", "px", "py", _row(F.col("py"), size).alias("pcy"), _row(F.col("px"), size).alias("pcx")).join(runs, ["pcy", "pcx"])
    lines = by_rows(flat, size).select(F.col(key).alias("_k"), F.col("cy").alias("_cy"), "x1", "y1", "x2", "y2")
    near = hit.where(~F.col("inside")).join(lines, (F.col(key) == F.col("_k")) & (F.col("pcy") == F.col("_cy")))
    exact = near.groupBy("id", "px", "py", key).agg((F.count_if(_left_of()) % 2 == 1).alias("holds")).where("holds").select("id", key)
    return hit.where("inside").select("id", key).unionByName(exact).distinct()


def resolve_zones(rows: DataFrame, zones: DataFrame, size: float, ids: str = "id") -> DataFrame:
    """rows (ids, lat, lon) with timezone_id of the zone (timezone_id, wkb) that holds them, the least name of several, and zone_reason where there is none."""
    found = containing(rows.select(F.col(ids).alias("id"), "lat", "lon"), zones, size, "timezone_id").groupBy("id").agg(F.min("timezone_id").alias("timezone_id")).withColumnRenamed("id", "_zone_of")
    out = rows.join(found, F.col(ids) == F.col("_zone_of"), "left").drop("_zone_of")
    reason = F.when(~valid_point(F.col("lat"), F.col("lon")), "invalid_coordinate").when(F.col("timezone_id").isNull(), "outside_of_zones")
    return out.withColumn("zone_reason", reason)


def distances(anchors: DataFrame, geometries: DataFrame, within_m: float, size: float, key: str = "geometry_id") -> DataFrame:
    """id, key, distance_m, method for every anchor (id, lat, lon) and geometry (key, wkb, and west, south, east, north) at most within_m apart.

    The distance is that to the nearest point of the geometry in a plane around the anchor, 0 within a polygon. Geometries that cannot be read take
    their bounds instead (bbox_fallback); without bounds they have no distance.
    """
    readable = wkb_functions.segments(geometries, key, "wkb").withColumn("method", F.lit("geometry"))
    read = readable.select(F.col(key).alias("_read")).distinct()
    left = geometries.join(read, F.col(key) == F.col("_read"), "left_anti").where("west is not null and south is not null and east is not null and north is not null")
    ring = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    side = lambda p, q: F.struct(*[F.col(c).cast("double").alias(n) for c, n in zip((*p, *q), ("x1", "y1", "x2", "y2"), strict=True)])
    boxes = left.select(key, F.lit("area").alias("kind"), F.lit(0).alias("ring"), F.inline(F.array(*[side(p, q) for p, q in zip(ring, ring[1:], strict=False)]))).withColumn("method", F.lit("bbox_fallback"))
    lines = readable.unionByName(boxes)
    return _within(anchors, lines, within_m, size, key)


def _within(anchors: DataFrame, lines: DataFrame, within_m: float, size: float, key: str) -> DataFrame:
    ok = _valid(anchors).withColumn("wide", X_M * F.greatest(F.cos(F.radians("py")), F.lit(1e-8)))
    span = lambda c, reach: F.sequence(_row(F.col(c) - reach, size), _row(F.col(c) + reach, size))
    spread = ok.withColumn("cy", F.explode(span("py", F.lit(within_m / Y_M)))).withColumn("cx", F.explode(span("px", within_m / F.col("wide"))))
    placed = by_cells(lines.select(key, "method", "x1", "y1", "x2", "y2"), size)
    x = lambda c: (F.col(c) - F.col("px")) * F.col("wide")
    y = lambda c: (F.col(c) - F.col("py")) * Y_M
    pairs = spread.join(placed, ["cy", "cx"]).select("id", key, "method", x("x1").alias("ax"), y("y1").alias("ay"), (x("x2") - x("x1")).alias("dx"), (y("y2") - y("y1")).alias("dy"))
    square = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    t = F.when(square > 0, F.least(F.greatest(-(F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / F.when(square > 0, square), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    near = pairs.withColumn("t", t).withColumn("d", F.hypot(F.col("ax") + F.col("t") * F.col("dx"), F.col("ay") + F.col("t") * F.col("dy")))
    outside = near.groupBy("id", key, "method").agg(F.min("d").alias("distance_m")).where(F.col("distance_m") <= within_m)
    areas = lines.where("kind = 'area'")
    how = areas.select(F.col(key).alias("_of"), "method").distinct()
    held = _held(ok, areas, size, key).join(how, F.col(key) == F.col("_of")).select("id", key, "method", F.lit(0.0).alias("distance_m"))
    return outside.unionByName(held).groupBy("id", key, "method").agg(F.min("distance_m").alias("distance_m")).select("id", key, "distance_m", "method")
