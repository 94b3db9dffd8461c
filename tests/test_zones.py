"""Zones and geometries against plain even-odd tests and distances, and the geometry format."""

import math
import random
import struct

import pytest

from wanderlake.functions import wkb
from wanderlake.operators import zones


def star(r, x, y, n, size):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + math.cos(t) * s, y + math.sin(t) * s) for t in turns for s in [size * r.uniform(0.3, 1)]]


def sides(ring):
    return list(zip(ring, ring[1:] + ring[:1], strict=True))


def holds(rings, x, y):
    return sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) < x for ring in rings for a, b in sides(ring)) % 2 == 1


def to_segment(ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = min(max(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
    return math.hypot(ax + t * dx, ay + t * dy)


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(4)
    out = {}
    for i in range(12):
        x, y = r.uniform(-1, 1), r.uniform(39, 41)
        out[i] = [star(r, x, y, 12, 0.8), star(r, x, y, 5, 0.2)]
    # A square whose sides lie on the borders of cells.
    out[12] = [[(0.0, 40.0), (0.5, 40.0), (0.5, 40.5), (0.0, 40.5)]]
    return out


@pytest.fixture(scope="module")
def spots():
    r = random.Random(5)
    out = [(i, r.uniform(38, 42), r.uniform(-2, 2)) for i in range(400)]
    out += [(400, 40.0, 0.0), (401, 40.5, 0.5), (402, 40.25, 0.25), (403, None, 0.0), (404, 95.0, 0.0), (405, float("nan"), 0.0), (402, 40.25, 0.25)]
    return out


@pytest.mark.parametrize("size", [0.03, 0.25, 3.0])
def test_polygons_hold_points(spark, shapes, spots, size):
    g = spark.createDataFrame([(i, bytearray(wkb.polygon(s))) for i, s in shapes.items()] + [(90, None), (91, bytearray(b"\x01"))], "zone_id int, wkb binary")
    got = sorted(map(tuple, zones.containing(spark.createDataFrame(spots, "id int, lat double, lon double"), g, size).collect()))
    want = sorted({(p, k) for p, y, x in spots if y is not None and abs(y) <= 90 for k, s in shapes.items() if holds(s, x, y)})
    assert got == want and len(want) > 200


def test_distances_to_shapes(spark, shapes, spots):
    r = random.Random(6)
    lines = {100 + i: [(r.uniform(-2, 2), r.uniform(38, 42)) for _ in range(4)] for i in range(5)}
    rows = [(i, bytearray(wkb.polygon(s)), None, None, None, None) for i, s in shapes.items()] + [(i, bytearray(wkb.line(s)), None, None, None, None) for i, s in lines.items()]
    rows += [(200, bytearray(struct.pack("<BIdd", 1, 1, 0.3, 39.7)), 0.0, 0.0, 1.0, 1.0), (201, None, -0.2, 39.9, 0.1, 40.1), (202, bytearray(b"\x01\x07"), None, 39.9, 0.1, 40.1)]
    box = [(-0.2, 39.9), (0.1, 39.9), (0.1, 40.1), (-0.2, 40.1)]
    g = spark.createDataFrame(rows, "geometry_id int, wkb binary, west double, south double, east double, north double")
    got = {(x.id, x.geometry_id): (x.distance_m, x.method) for x in zones.distances(spark.createDataFrame(spots, "id int, lat double, lon double"), g, 20_000.0, 0.1).collect()}
    want = {}
    for p, y, x in spots:
        if y is None or not abs(y) <= 90:
            continue
        wide = 111_320.0 * math.cos(math.radians(y))
        plane = lambda q: ((q[0] - x) * wide, (q[1] - y) * 110_574.0)  # noqa: B023, E731
        all_shapes = [(k, [e for ring in s for e in sides(ring)], s) for k, s in shapes.items()] + [(k, list(zip(s, s[1:], strict=False)), []) for k, s in lines.items()]
        all_shapes += [(200, [((0.3, 39.7), (0.3, 39.7))], []), (201, sides(box), [box])]
        for k, edges, rings in all_shapes:
            d = 0.0 if rings and holds(rings, x, y) else min(to_segment(*plane(a), *plane(b)) for a, b in edges)
            if d <= 20_000:
                want[p, k] = d
    assert got.keys() == want.keys() and len(want) > 500
    assert all(abs(got[k][0] - d) < 1e-6 * max(d, 1) for k, d in want.items())
    assert {m for (_, k), (_, m) in got.items() if k == 201} == {"bbox_fallback"} and {m for (_, k), (_, m) in got.items() if k != 201} == {"geometry"}


def test_formats_of_geometries():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    flat = wkb.polygon([ring])
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">dd", *p) for p in [*ring, ring[0]])
    high = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<ddd", *p, 7.0) for p in [*ring, ring[0]])
    marked = struct.pack("<BII", 1, 3 | wkb.HAS_SRID | wkb.HAS_Z, 4326) + struct.pack("<II", 1, 4) + b"".join(struct.pack("<ddd", *p, 7.0) for p in [*ring, ring[0]])
    for raw in (flat, big, high, marked):
        ((kind, p),) = wkb.parse(raw)
        assert kind == "area" and p.tolist() == [list(x) for x in [*ring, ring[0]]]
    both = struct.pack("<BII", 1, 6, 2) + flat + big
    assert [k for k, _ in wkb.parse(struct.pack("<BII", 1, 7, 2) + both + wkb.line(ring))] == ["area", "area", "line"]
    nan = struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))
    for bad in (None, b"", b"\x01", flat[:-1], struct.pack("<BI", 1, 99), nan):
        assert wkb.parse(bad) == []


def test_zones_of_rows_and_of_stays(spark):
    from wanderlake.operators import locate

    square = lambda x, y: bytearray(wkb.polygon([[(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2)]]))
    z = spark.createDataFrame([("Asia/Tokyo", square(139, 35)), ("Asia/Seoul", square(140, 35))], "timezone_id string, wkb binary")
    rows = spark.createDataFrame([(1, 36.0, 139.5), (2, 36.0, 140.5), (3, 10.0, 10.0), (4, None, 1.0), (1, 36.0, 139.5)], "id int, lat double, lon double")
    got = sorted((r.id, r.timezone_id, r.zone_reason) for r in zones.resolve_zones(rows, z, 0.5).collect())
    assert got == [(1, "Asia/Tokyo", None), (1, "Asia/Tokyo", None), (2, "Asia/Seoul", None), (3, None, "outside_of_zones"), (4, None, "invalid_coordinate")]
    stays = rows.selectExpr("id as user_id", "lat", "lon", "timestamp_ntz'2024-01-01 15:00:00' as arrival", "timestamp_ntz'2024-01-01 16:00:00' as departure")
    local = locate.with_local_time(stays, z, 0.5).collect()
    assert len(local) == 3 and {str(r.local_arrival) for r in local} == {"2024-01-02 00:00:00"}


def test_points_on_slanted_borders_go_left(spark):
    """Triangles with a slanted left or right side; points of two decimals on it, as doubles that lie a little beside it."""
    left, right = [(117.4, 39.6), (118.1, 39.6), (117.7, 40.2)], [(116.6, 39.2), (117.3, 39.2), (116.9, 39.8)]
    g = spark.createDataFrame([(0, bytearray(wkb.polygon([left]))), (1, bytearray(wkb.polygon([right])))], "zone_id int, wkb binary")
    on_left = [(i, 39.6 + 0.02 * i, 117.4 + 0.01 * i) for i in range(1, 30)]
    on_right = [(100 + i, 39.2 + 0.03 * i, 117.3 - 0.02 * i) for i in range(1, 20)]
    got = set(map(tuple, zones.containing(spark.createDataFrame(on_left + on_right, "id int, lat double, lon double"), g, 0.05).collect()))
    assert {p for p, k in got if k == 1} >= {p for p, _, _ in on_right} and not {p for p, k in got if k == 0 and p < 100}
