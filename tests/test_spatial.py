"""Geohash cells, diameters and raster windows against plain versions."""

import collections
import datetime as dt
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from wanderlake.functions import geo
from wanderlake.operators import spatial
from wanderlake.operators.stays import distances_m
from wanderlake.plans import queries as plans


def test_geohash_there_and_back(spark):
    r = random.Random(1)
    rows = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("g", geo.geohash(F.col("lat"), F.col("lon"), 7))
    lat, lon = geo.geohash_center(F.col("g"), 7)
    for x in df.withColumns({"y": lat, "x": lon, "again": geo.geohash(lat, lon, 7), "near": geo.geohash_neighbours(F.col("g"), 7)}).collect():
        assert abs(x.y - x.lat) <= 180 / 2**17 / 2 + 1e-9 and abs(x.x - x.lon) <= 360 / 2**18 / 2 + 1e-9 and x.again == x.g
        assert x.g in x.near and len(set(x.near)) == (6 if abs(x.lat) > 89.999 else 9)
    bad = spark.createDataFrame([("ezs42",), ("ezs4a",), ("ezs4",), (None,)], "g string").select(*geo.geohash_center(F.col("g"), 5)).collect()
    assert [x[0] is None for x in bad] == [False, True, True, True] and abs(bad[0][0] - 42.605) < 0.03 and abs(bad[0][1] + 5.603) < 0.03


def test_diameters_equal_all_pairs(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(60):
        n = int(r.integers(1, 300))
        lat = np.clip(r.uniform(-85, 85) + r.normal(0, 10 ** r.uniform(-4, 1.5), n), -89, 89)
        lon = r.uniform(-180, 180) + r.normal(0, 10 ** r.uniform(-4, 1.8), n)
        lat[: n // 3] = lat[0]
        want[k] = float(distances_m(lat[:, None], lon[:, None], lat, lon).max())
        rows += [(k, float(a), float(b)) for a, b in zip(lat, lon, strict=True)]
    rows += [(99, None, None), (99, 1.0, 2.0), (98, 1.0, 2.0), (98, 1.0, 2.0)]
    got = {x.k: x for x in spatial.group_diameters(spark.createDataFrame(rows, "k int, lat double, lon double"), ["k"]).collect()}
    assert all(abs(got[k].diameter_m - d) <= 1e-6 * d + 1e-6 for k, d in want.items())
    assert got[99].diameter_m == got[98].diameter_m == 0.0 and got[98].points == 2


def test_windows_over_tiles(spark):
    r = np.random.default_rng(3)
    grid = r.integers(0, 4, (40, 40))
    tiles = [(i, j, grid[8 * i : 8 * i + 8, 8 * j : 8 * j + 8].reshape(-1).tolist()) for i in range(5) for j in range(5) if (i, j) != (2, 2)]
    grid[16:24, 16:24] = 0
    anchors = [(k, int(r.integers(-3, 43)), int(r.integers(-3, 43))) for k in range(200)]
    got = {x.id: x for x in spatial.raster_modes(spark.createDataFrame(anchors, "id int, row int, col int"), spark.createDataFrame(tiles, "tile_row int, tile_col int, codes array<int>"), 8, (3, 9, 19), 2).collect()}
    for k, i, j in anchors:
        for name, h in (("point_code", 0), ("mode_3", 1), ("mode_9", 4), ("mode_19", 9)):
            part = grid[max(i - h, 0) : max(i + h + 1, 0), max(j - h, 0) : max(j + h + 1, 0)]
            n = collections.Counter(x for x in part.reshape(-1).tolist() if x > 0 and x != 2)
            assert got[k][name] == (min(n, key=lambda c: (-n[c], c)) if n else None)


def test_even_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(17)] + [("b", i) for i in range(3)], "g string, i int")
    got = collections.defaultdict(list)
    for x in spatial.evenly_spaced(df, "g", "i", 5).collect():
        got[x.g].append(x.i)
    assert sorted(got["a"]) == np.linspace(0, 16, 5, dtype=int).tolist() and sorted(got["b"]) == [0, 1, 2]
    assert spatial.evenly_spaced(df, "g", "i", 1).count() == 2


def test_homes_of_even_medians_match_the_sql(spark, tmp_path):
    """The middle of 39.96 and 39.96005 is 39.960025, which has more places than either; 39.96002 is in another cell."""
    rows = [(4 * (k + 1 + k // 2), dt.datetime(2024, 1, 2 + k, 14, 45), 6, "view") for k in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [r.geohash7 for r in plans.QUERIES["monthly_geohash_homes"](spark, str(tmp_path)).collect()]
    assert got == [r[0] for r in c.sql(f"select geohash7 from ({plans.SQL['monthly_geohash_homes']})").fetchall()] and len(got) == 1
