"""Stay points. The jump past a stay depends on the data, so sequences go through a NumPy kernel, many in one call; sequences are independent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M
from .clean import require

STAYS = "user_id long, sequence_id long, arrival timestamp_ntz, departure timestamp_ntz, duration_s double, lat double, lon double, n_points long"
#: Points that are worked on at once, beside the rest of a sequence that goes on in the next batch.
ROWS = 200_000


def distances_m(lat: np.ndarray | float, lon: np.ndarray | float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lats)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def first_far(anchor: np.ndarray, upto: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius_m: float) -> np.ndarray:
    """For each anchor, the first later row before ``upto`` that is further than the radius; else ``upto``. All anchors look ahead at once, in growing blocks."""
    out, seen, width = upto.copy(), anchor + 1, 8
    live = np.flatnonzero(seen < upto)
    while len(live):
        # Of very many anchors a part at a time, so that a block stays small.
        for part in np.array_split(live, max(1, len(live) * width >> 20)):
            row = seen[part, None] + np.arange(width)
            inside = row < upto[part, None]
            row = np.minimum(row, len(lat) - 1)
            far = inside & (distances_m(lat[anchor[part], None], lon[anchor[part], None], lat[row], lon[row]) > radius_m)
            hit = far.any(axis=1)
            out[part[hit]] = seen[part[hit]] + far[hit].argmax(axis=1)
            seen[part] = np.where(hit, upto[part], seen[part] + width)
        live = live[seen[live] < upto[live]]
        width = min(2 * width, 4096)
    return out


def stays_of(sequence: np.ndarray, micros: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius_m: float, dwell_s: float) -> tuple[np.ndarray, np.ndarray]:
    """First row and the row after the last of each stay. sequence: a number for each row, rising from one sequence to the next.

    A row may begin a stay if no row up to the first one ``dwell_s`` later is further than the radius. Of each sequence the first such
    row is taken; its stay ends before the first row further than the radius, and the search goes on there.
    """
    n, dwell = len(micros), round(dwell_s * 1e6)
    heads = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1])) if n else np.zeros(0, np.int64)
    tails = np.append(heads[1:], n) if n else heads
    number = np.repeat(np.arange(len(heads)), tails - heads)
    end = tails[number] if n else number
    # Within a sequence times rise, so rows and times of all sequences are sorted together.
    shift = np.cumsum(np.append(0, micros[tails[:-1] - 1] - micros[heads[1:]] + 2 * dwell + 1)) if n else np.zeros(0, np.int64)
    flat = micros + shift[number]
    due = np.searchsorted(flat, flat + dwell)
    able = np.flatnonzero((due < end) & (end - np.arange(n) > 1))
    due = np.maximum(due, np.arange(n) + 1)
    begins = able[first_far(able, due[able] + 1, lat, lon, radius_m) > due[able]]
    firsts, lasts = [], []
    at = np.searchsorted(begins, heads)
    live = np.arange(len(heads))
    while len(live):
        live = live[at[live] < len(begins)]
        live = live[begins[at[live]] < tails[live]]
        anchor = begins[at[live]]
        stop = first_far(anchor, tails[live], lat, lon, radius_m)
        firsts.append(anchor)
        lasts.append(stop)
        at[live] = np.searchsorted(begins, stop)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    order = np.argsort(first)
    return first[order], last[order]


def medians(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The median of each run of rows; runs don't overlap."""
    size = last - first
    run = np.repeat(np.arange(len(first)), size)
    row = np.arange(len(run)) + np.repeat(first - np.cumsum(size) + size, size)
    v = values[row][np.lexsort((values[row], run))]
    begin = np.cumsum(size) - size
    return (v[begin + (size - 1) // 2] + v[begin + size // 2]) / 2 if len(v) else np.zeros(0)


def detect_staypoints(cleaned: DataFrame, distance_threshold_m: float = 200.0, min_dwell_s: float = 1200.0) -> DataFrame:
    """One row a stay. Points further than the radius end a stay; the dwell is inclusive."""
    require(cleaned, "user_id", "sequence_id", "ts", "lat", "lon")
    if distance_threshold_m < 0 or min_dwell_s < 0:
        raise ValueError("thresholds must not be negative")

    def rows(t: pa.Table) -> pa.RecordBatch:
        user, sequence = (np.asarray(t[c]) for c in ("user_id", "sequence_id"))
        ts = np.asarray(t["ts"]).astype("datetime64[us]")
        lat, lon, micros = np.asarray(t["lat"]), np.asarray(t["lon"]), ts.astype(np.int64)
        number = np.cumsum(np.append(False, (user[1:] != user[:-1]) | (sequence[1:] != sequence[:-1])))
        first, stop = stays_of(number, micros, lat, lon, distance_threshold_m, min_dwell_s)
        columns = [user[first], sequence[first], ts[first], ts[stop - 1], (micros[stop - 1] - micros[first]) / 1e6, medians(lat, first, stop), medians(lon, first, stop), stop - first]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["user_id", "sequence_id", "arrival", "departure", "duration_s", "lat", "lon", "n_points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            t = pa.Table.from_batches(held)
            user, sequence = (np.asarray(t[c]) for c in ("user_id", "sequence_id"))
            # The last sequence may go on in the next batch.
            cut = int(np.flatnonzero(np.append(True, (user[1:] != user[:-1]) | (sequence[1:] != sequence[:-1])))[-1])
            if cut:
                yield rows(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if any(b.num_rows for b in held):
            yield rows(pa.Table.from_batches(held))

    lone = cleaned.select(F.col("user_id").cast("long").alias("user_id"), F.col("sequence_id").cast("long").alias("sequence_id"), "ts", "lat", "lon")
    # Cleaned points lie by user, and so do their sequences: they are dealt out by sequence only if they lie otherwise. Sequences shorter than the dwell never reach Python.
    w = Window.partitionBy("user_id", "sequence_id").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    span = F.timestamp_diff("MICROSECOND", F.first("ts").over(whole), F.last("ts").over(whole)) / 1e6
    dealt = lone.withColumn("span", span).where(F.col("span") >= min_dwell_s).drop("span")
    return dealt.sortWithinPartitions("user_id", "sequence_id", "ts").mapInArrow(run, STAYS)


def walk(seconds: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius_m: float, dwell_s: float) -> list[tuple[int, int]]:
    """First and last row of each stay of one sequence."""
    micros = np.round(np.asarray(seconds, float) * 1e6).astype(np.int64)
    first, stop = stays_of(np.zeros(len(micros), np.int64), micros, np.asarray(lat, float), np.asarray(lon, float), radius_m, dwell_s)
    return list(zip(first.tolist(), (stop - 1).tolist(), strict=True))
