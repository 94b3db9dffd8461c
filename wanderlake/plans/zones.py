"""Registered queries of polygons and geometries, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wkb
from ..operators import zones
from ..sources.trajectories import table
from .queries import query

#: A concave ring and a hole, in degrees around a nation's centre; every third nation has a line instead.
RING = ((0.5, 0.0), (0.15, 0.2), (0.0, 0.45), (-0.3, 0.3), (-0.1, 0.05), (-0.45, -0.1), (-0.2, -0.25), (0.05, -0.5), (0.1, -0.2))
HOLE = ((0.05, 0.02), (0.05, 0.12), (-0.05, 0.1), (-0.04, 0.01))
LINE = ((-0.4, -0.3), (0.1, 0.0), (0.1, 0.2), (0.4, 0.4))
CELL_DEG, WITHIN_M = 0.05, 9000.0


def nation_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geometry_id, wkb, west, south, east, north: of nations, a polygon or a line; nations divisible by seven have bounds alone."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("geometry_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b.column("geometry_id").to_pylist():
                x, y = 116.2 + i % 5 * 0.4, 39.2 + i // 5 * 0.4
                moved = lambda ring: [(x + a, y + c) for a, c in ring]  # noqa: B023, E731
                shape = b"\x01\x03" if i % 7 == 0 else wkb.line(moved(LINE)) if i % 3 == 2 else wkb.polygon([moved(RING), moved(HOLE)])
                rows.append((i, shape, x - 0.1, y - 0.1, x + 0.1, y + 0.1))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.binary(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["geometry_id", "wkb", "west", "south", "east", "north"])

    return n.mapInArrow(run, "geometry_id long, wkb binary, west double, south double, east double, north double")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.cast("long").alias("id"), (39.0 + c % 997 / 500.0).alias("lat"), (116.0 + c % 613 / 320.0).alias("lon"))


def _values(rows) -> str:
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


def _edges(ring, k: int, closed: bool = True) -> list[tuple]:
    q = [*ring[1:], ring[0]] if closed else ring[1:]
    return [(k, *a, *b) for a, b in zip(ring, q, strict=False)]


_BOX = ((-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1))
_GEOMETRIES = f"""
with pt as (select c_custkey as id, 39.0 + c_custkey % 997 / 500.0 as py, 116.0 + c_custkey % 613 / 320.0 as px from customer),
pu as (select id, round(py * {zones.UNITS})::bigint as py, round(px * {zones.UNITS})::bigint as px from pt),
ct as (select n_nationkey as g, 116.2 + n_nationkey % 5 * 0.4 as x, 39.2 + n_nationkey // 5 * 0.4 as y, case when n_nationkey % 7 = 0 then 3 when n_nationkey % 3 = 2 then 2 else 1 end as kind from nation),
ed(kind, a, b, c, d) as (values {_values([*_edges(RING, 1), *_edges(HOLE, 1), *_edges(LINE, 2, False), *_edges(_BOX, 3)])}),
sg as (select g, kind, x + a as x1, y + b as y1, x + c as x2, y + d as y2 from ct join ed using (kind)),
su as (select g, round(x1 * {zones.UNITS})::bigint as x1, round(y1 * {zones.UNITS})::bigint as y1, round(x2 * {zones.UNITS})::bigint as x2, round(y2 * {zones.UNITS})::bigint as y2 from sg where kind <> 2),
hd as (select id, g, sum(case when (y1 <= py) <> (y2 <= py) and case when y2 > y1 then (py - y1) * (x2 - x1) < (px - x1) * (y2 - y1) else (py - y1) * (x2 - x1) > (px - x1) * (y2 - y1) end then 1 else 0 end) % 2 = 1 as holds from pu cross join su group by id, g)
"""


@query(_GEOMETRIES + "select id, hd.g as zone_id from hd join ct on ct.g = hd.g where holds and kind = 1")
def points_in_polygons(spark, sf_dir):
    z = nation_geometries(spark, sf_dir).withColumnRenamed("geometry_id", "zone_id")
    return zones.containing(_points(spark, sf_dir), z, CELL_DEG)


@query(_GEOMETRIES + """, best as (select id, min('zone-' || lpad(cast(hd.g as varchar), 2, '0')) as timezone_id from hd join ct on ct.g = hd.g where holds and kind = 1 group by id)
select pt.id as id, timezone_id, case when timezone_id is null then 'outside_of_zones' end as zone_reason from pt left join best on best.id = pt.id""")
def resolved_zones(spark, sf_dir):
    z = nation_geometries(spark, sf_dir).select(F.format_string("zone-%02d", "geometry_id").alias("timezone_id"), "wkb")
    return zones.resolve_zones(_points(spark, sf_dir), z, CELL_DEG).select("id", "timezone_id", "zone_reason")


@query(_GEOMETRIES + f""", w as (select *, 111320.0 * greatest(cos(radians(py)), 1e-8) as wide from pt),
pr as (select id, g, kind, (x1 - px) * wide as ax, (y1 - py) * 110574.0 as ay, (x2 - x1) * wide as dx, (y2 - y1) * 110574.0 as dy from w cross join sg),
tt as (select *, least(greatest(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0.0), 1.0) as t from pr),
md as (select id, g, kind, min(sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))) as d from tt group by id, g, kind),
al as (select md.id as id, md.g as g, kind, case when coalesce(holds, false) then 0.0 else d end as d from md left join hd on hd.id = md.id and hd.g = md.g)
select id, g as geometry_id, round(d, 6) as distance_m, case when kind = 3 then 'bbox_fallback' else 'geometry' end as method from al where d <= {WITHIN_M}""")
def geometry_distances(spark, sf_dir):
    return zones.distances(_points(spark, sf_dir), nation_geometries(spark, sf_dir), WITHIN_M, CELL_DEG)
