"""Raster windows, exact diameters of groups of points, and samples of evenly spaced members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stays import distances_m
from .sweeps import whole_groups


def raster_modes(anchors: DataFrame, tiles: DataFrame, size: int, windows: tuple[int, ...], nodata: int) -> DataFrame:
    """id, point_code and mode_k for each anchor (id, row, col: a pixel) and odd window k: the most frequent positive code around it, ties to the least, null if there is none.

    tiles: tile_row, tile_col and codes, an array of size x size codes by rows; missing tiles hold nothing. An anchor goes to each tile that its widest window touches
    (four at most where windows are no wider than tiles), each tile counts its own part of the window, and only counts by code are put together.
    """
    if any(k <= 0 or k % 2 == 0 for k in windows):
        raise ValueError("windows must be positive and odd")
    half = max(windows) // 2
    tile = lambda c: F.floor(c / F.lit(size)).cast("long")
    span = lambda c: F.explode(F.sequence(tile(F.col(c) - half), tile(F.col(c) + half)))
    at = anchors.select("id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).withColumn("tile_row", span("row")).withColumn("tile_col", span("col"))
    met = at.join(tiles.select(F.col("tile_row").cast("long").alias("tile_row"), F.col("tile_col").cast("long").alias("tile_col"), "codes"), ["tile_row", "tile_col"])
    inside = lambda c, t: F.sequence(F.greatest(F.col(c) - half, F.col(t) * size), F.least(F.col(c) + half, F.col(t) * size + size - 1))
    pixels = met.withColumn("r", F.explode(inside("row", "tile_row"))).withColumn("c", F.explode(inside("col", "tile_col")))
    code = F.get("codes", ((F.col("r") - F.col("tile_row") * size) * size + F.col("c") - F.col("tile_col") * size).cast("int"))
    far = F.greatest(F.abs(F.col("r") - F.col("row")), F.abs(F.col("c") - F.col("col")))
    counted = pixels.select("id", code.alias("code"), far.alias("far")).where((F.col("code") > 0) & (F.col("code") != nodata))
    reach = {"point_code": 0, **{f"mode_{k}": k // 2 for k in windows}}
    n = counted.groupBy("id", "code").agg(*[F.count_if(F.col("far") <= h).alias(c) for c, h in reach.items()])
    mode = lambda c: F.max(F.when(F.col(c) > 0, F.struct(F.col(c).alias("n"), (-F.col("code")).alias("less"))))["less"]
    modes = n.groupBy("id").agg(*[(-mode(c)).alias(c) for c in reach])
    return anchors.select("id").join(modes, "id", "left")


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points are corners of the convex hull, in order around it."""
    order = np.lexsort((y, x))

    def chain(ids: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in ids.tolist():
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1] if len(order) > 1 else lower, np.int64)


def diameter_m(lat: np.ndarray, lon: np.ndarray) -> float:
    """The greatest distance of two of the points.

    Seen from the Earth's centre on a plane at the points' middle, great circles are lines, so the two lie on the hull there; only its corners are measured with
    each other. Points that spread over near a half of the Earth are all measured.
    """
    ok = np.isfinite(lat) & np.isfinite(lon)
    p = np.unique(np.stack([lat[ok], lon[ok]]), axis=1)
    if p.shape[1] < 2:
        return 0.0
    a, b = np.radians(p)
    v = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
    middle = v.mean(axis=1)
    own = np.arange(p.shape[1])
    if np.linalg.norm(middle) > 0.5:
        middle /= np.linalg.norm(middle)
        depth = middle @ v
        if depth.min() > 0.1 and len(own) > 32:
            e = np.cross(middle, np.eye(3)[np.argmin(np.abs(middle))])
            e /= np.linalg.norm(e)
            own = hull((e @ v) / depth, (np.cross(middle, e) @ v) / depth)
    best = 0.0
    for i in range(0, len(own), 256):
        part = own[i : i + 256]
        best = max(best, float(distances_m(p[0, part, None], p[1, part, None], p[0, own], p[1, own]).max()))
    return best


def group_diameters(points: DataFrame, by: list[str]) -> DataFrame:
    """by, points, diameter_m of each group of points (lat, lon). Equal points of a group are one; a group's different points meet in one task, sorted out in n log n."""
    spots = points.groupBy(*by, "lat", "lon").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, by):
            lat, lon, n = np.asarray(t["lat"], float), np.asarray(t["lon"], float), np.asarray(t["n"])
            cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            heads = [t[c].take(pa.array(at[:-1])).combine_chunks() for c in by]
            yield pa.RecordBatch.from_arrays([*heads, pa.array([int(n[a:b].sum()) for a, b in cuts], pa.int64()), pa.array([diameter_m(lat[a:b], lon[a:b]) for a, b in cuts], pa.float64())], names=[*by, "points", "diameter_m"])

    kinds = dict(points.dtypes)
    dealt = spots.repartition(*by).sortWithinPartitions(*by, "lat", "lon")
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", points long, diameter_m double")


def evenly_spaced(rows: DataFrame, stratum: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each stratum, evenly spaced in order from the first to the last; all of a stratum that has no more."""
    w = Window.partitionBy(stratum)
    numbered = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # The k-th of them stands at floor(k * (n - 1) / (most - 1)).
    spots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(max(most - 1, 1))).cast("int"))
    return numbered.where((F.col("_n") <= most) | F.array_contains(spots, F.col("_i"))).drop("_i", "_n")
