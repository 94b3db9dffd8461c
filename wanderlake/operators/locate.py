"""Time zones and recurring places: stays of a user become locations by complete-link clustering or by distance chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import cell, valid_point
from .stays import ROWS, distances_m

#: Boxes (south, north, west, east) of time zones, in order of precedence. Coordinates in no box have no zone.
ZONES = (
    ("Asia/Tokyo", 30.0, 46.0, 129.5, 146.0),
    ("Asia/Seoul", 33.0, 38.7, 126.0, 129.5),
    ("Asia/Shanghai", 18.0, 54.0, 73.5, 135.0),
    ("America/New_York", 25.0, 47.5, -85.0, -67.0),
    ("America/Los_Angeles", 32.5, 49.0, -124.8, -114.0),
    ("Europe/London", 49.9, 59.0, -8.0, 1.8),
)

#: Points so few that all their distances are measured at once.
FEW = 64


def with_local_time(stays: DataFrame, zones: DataFrame | None = None, size_deg: float = 0.25) -> DataFrame:
    """Adds timezone_id, local arrival and departure (wall clock). Stays without a zone are dropped.

    zones: polygons (timezone_id, wkb) of any detail, met in cells of size_deg; each different spot is looked up once. Without them the boxes of ZONES are taken.
    """
    if zones is not None:
        from .zones import containing

        spots = stays.select("lat", "lon").distinct().select(F.struct("lat", "lon").alias("id"), "lat", "lon")
        found = containing(spots, zones, size_deg, "timezone_id").groupBy("id").agg(F.min("timezone_id").alias("timezone_id"))
        return localized(stays.join(found.select("id.lat", "id.lon", "timezone_id"), ["lat", "lon"]).select(*stays.columns, "timezone_id"))
    zone = F.lit(None).cast("string")
    for name, south, north, west, east in reversed(ZONES):
        zone = F.when(F.col("lat").between(south, north) & F.col("lon").between(west, east), name).otherwise(zone)
    return localized(stays.withColumn("timezone_id", zone))


def resolve_zones(rows: DataFrame, cells: DataFrame, size_deg: float) -> DataFrame:
    """rows (lat, lon) with timezone_id from a table of grid cells (cy, cx, timezone_id; each cell once), and why there is none.

    The table may be as fine as a zone map is; it meets the rows in an equi-join on cells. Unresolved rows are kept.
    """
    ok = valid_point(F.col("lat"), F.col("lon"))
    keyed = rows.withColumns({"_cy": F.when(ok, cell(F.col("lat"), size_deg)), "_cx": F.when(ok, cell(F.col("lon"), size_deg))})
    zone = cells.select(F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), "timezone_id")
    out = keyed.join(zone, ["_cy", "_cx"], "left")
    reason = F.when(F.col("_cy").isNull(), "invalid_coordinate").when(F.col("timezone_id").isNull(), "outside_of_zones")
    return out.withColumn("zone_reason", reason).drop("_cy", "_cx")


def localized(rows: DataFrame) -> DataFrame:
    """Rows that have a zone, with their arrival and departure on the local clock."""
    s = rows.where("timezone_id is not null")
    return s.withColumns({f"local_{c}": F.convert_timezone(F.lit("UTC"), F.col("timezone_id"), F.col(c)) for c in ("arrival", "departure")})


def near_pairs(lat: np.ndarray, lon: np.ndarray, most_m: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of points at most most_m apart, each once: only points of the same or touching cells are compared, a cell at a time."""
    n = len(lat)
    if n < FEW:
        i, j = np.triu_indices(n, 1)
        near = distances_m(lat[i], lon[i], lat[j], lon[j]) <= most_m
        return i[near], j[near]
    # Rows of cells are as high as most_m; in each row cells are as wide as most_m at the row's far side from the equator.
    step = most_m / 111_194.0 * 1.001 + 1e-12
    y = np.floor(lat / step).astype(np.int64)
    width = step / np.maximum(np.cos(np.radians(np.minimum((np.abs(y) + 2) * step, 89.9))), 1e-3)
    found_i, found_j = [], []
    order = np.lexsort((lon, y))
    rows, at = np.unique(y[order], return_index=True)
    at = np.append(at, n)
    for k, row in enumerate(rows.tolist()):
        own = order[at[k] : at[k + 1]]
        for other in [own] + ([order[at[k + 1] : at[k + 2]]] if k + 1 < len(rows) and rows[k + 1] == row + 1 else []):
            reach = np.maximum(width[own], width[other[0]])
            lo = np.searchsorted(lon[other], lon[own] - reach) if other is not own else np.arange(len(own)) + 1
            size = np.maximum(np.searchsorted(lon[other], lon[own] + reach, "right") - lo, 0)
            for part in np.array_split(np.arange(len(own)), max(1, int(size.sum()) >> 20)):
                i = np.repeat(own[part], size[part])
                j = other[np.arange(len(i)) + np.repeat(lo[part] - np.cumsum(size[part]) + size[part], size[part])]
                near = distances_m(lat[i], lon[i], lat[j], lon[j]) <= most_m
                found_i.append(i[near])
                found_j.append(j[near])
    return np.concatenate(found_i), np.concatenate(found_j)


def chained(lat: np.ndarray, lon: np.ndarray, step_m: float) -> np.ndarray:
    """Groups of points that steps of at most step_m connect: every point takes the least number it can reach."""
    label = np.arange(len(lat))
    i, j = near_pairs(lat, lon, step_m)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def complete_link(lat: np.ndarray, lon: np.ndarray, most_m: float) -> np.ndarray:
    """Clusters in which no two members are over most_m apart: the nearest two are merged while that holds.

    No cluster leaves a group that steps of most_m connect, so groups of many points are clustered apart; a group's distances are held at once.
    """
    if 0 < len(lat) < FEW:
        return _merged(lat, lon, most_m)
    group = chained(lat, lon, most_m)
    label = group.copy()
    names, size = np.unique(group, return_counts=True)
    for name in names[size > 1].tolist():
        own = np.flatnonzero(group == name)
        label[own] = own[_merged(lat[own], lon[own], most_m)]
    return label


def _merged(lat: np.ndarray, lon: np.ndarray, most_m: float) -> np.ndarray:
    """Complete link of one group."""
    label = np.arange(len(lat))
    for i, j, _ in merges(lat, lon, most_m):
        label[label == j] = i
    return label


def merges(lat: np.ndarray, lon: np.ndarray, most_m: float) -> Iterator[tuple[int, int, float]]:
    """The merges of complete link up to most_m, nearest first: the cluster of j goes to that of i. The nearest other of every row is kept, and worked out again where a merge changed it."""
    n = len(lat)
    d = distances_m(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    np.fill_diagonal(d, np.inf)
    best = d.argmin(axis=1)
    least = d[np.arange(n), best]
    while True:
        i = int(least.argmin())
        if not least[i] <= most_m:
            return
        height = float(least[i])
        i, j = sorted((i, int(best[i])))
        yield i, j, height
        d[i, :] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j, :] = d[:, j] = np.inf
        least[j] = np.inf
        changed = np.flatnonzero((best == i) | (best == j) | (np.arange(n) == i))
        changed = changed[changed != j]
        best[changed] = d[changed].argmin(axis=1)
        least[changed] = d[changed, best[changed]]


METHODS = {"complete_link": complete_link, "dbscan": chained}


def spots(user: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different spot of a user, in the order of rows, and for each row the number of its spot. A user's rows stand together."""
    number = np.cumsum(np.append(False, user[1:] != user[:-1]))
    # By bits, with one NaN and one zero.
    y, x = (np.where(np.isnan(v), np.nan, v + 0.0).view(np.int64) for v in (lat, lon))
    order = np.lexsort((x, y, number))
    new = np.append(True, (np.diff(number[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(x[order]) != 0))
    first = order[new]
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    spot = np.empty(len(user), np.int64)
    spot[order] = place[np.cumsum(new) - 1]
    return np.sort(first), spot


def numbered_places(stays: DataFrame, column: T.StructField, clusters: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """stays with column: the numbers of their places, by first arrival within a user; a long, or an array of longs for several clusterings (a row of clusters each).

    Only a user's different spots go through the kernel, many users in one call; the stays pass by and take the numbers of their spots, so nothing is joined.
    """

    def located(t: pa.Table) -> Iterator[pa.RecordBatch]:
        user, lat, lon = (np.asarray(t[c]) for c in ("user_id", "lat", "lon"))
        first, spot = spots(user, lat, lon)
        owner, lat, lon = user[first], lat[first], lon[first]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        numbers = []
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(first)).tolist(), strict=True):
            own = []
            for label in np.atleast_2d(clusters(lat[lo:hi], lon[lo:hi])):
                _, at, back = np.unique(label, return_index=True, return_inverse=True)
                own.append(np.argsort(np.argsort(at))[back])
            numbers.append(own)
        number = np.concatenate(numbers, axis=1)[:, spot]
        flat = pa.array(number.T.ravel())
        several = isinstance(column.dataType, T.ArrayType)
        yield from t.append_column(column.name, pa.ListArray.from_arrays(np.arange(len(user) + 1, dtype=np.int32) * len(number), flat) if several else flat).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            t = pa.Table.from_batches(held)
            user = np.asarray(t["user_id"])
            cut = int(np.flatnonzero(np.append(True, user[1:] != user[:-1]))[-1])
            if cut:
                yield from located(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if any(b.num_rows for b in held):
            yield from located(pa.Table.from_batches(held))

    known = stays.where("user_id is not null and lat is not null and lon is not null")
    return known.repartition("user_id").sortWithinPartitions("user_id", "arrival", "departure", "lat", "lon").mapInArrow(run, T.StructType([*stays.schema, column]))


def cluster_stays(stays: DataFrame, method: str = "complete_link", threshold_m: float = 200.0) -> DataFrame:
    """stays with location_id, numbered by first arrival within a user."""
    kernel = METHODS[method]
    return numbered_places(stays, T.StructField("location_id", T.LongType()), lambda lat, lon: kernel(lat, lon, threshold_m))


def summarize_locations(semantic: DataFrame) -> DataFrame:
    """A row a location: centre, stays, different local dates, hours of dwell."""
    return semantic.groupBy("user_id", "location_id").agg(
        F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("stay_count"),
        F.countDistinct(F.to_date("local_arrival")).alias("distinct_dates"), (F.sum("duration_s") / 3600).alias("dwell_h"),
    )


def timezone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "timezone_id string, south double, north double, west double, east double")
