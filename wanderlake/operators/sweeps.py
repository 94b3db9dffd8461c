"""Sensitivity sweeps in one pass: stays under a grid of gaps, radii and dwells, and locations at several thresholds.

Cleaned points are sorted and read once. The look-ahead from each point measures its distances once for all radii; a gap only cuts a sequence
further, and a dwell only says how far the look-ahead must reach. Locations come from one complete-link dendrogram a user, made up to
the largest threshold: its merges never get closer, so the clusters at a threshold are what the merges up to it have made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import days
from .clean import require
from .locate import chained, merges, near_pairs, numbered_places
from .stays import ROWS, STAYS, distances_m, first_far, medians


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, about ``rows`` rows each or one group, and where each group begins, with the end."""
    held: list[pa.RecordBatch] = []

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = np.asarray(t[k])
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        at = begins(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
            held = t.slice(at[-1]).to_batches()
    if any(b.num_rows for b in held):
        t = pa.Table.from_batches(held)
        yield t, np.append(begins(t), t.num_rows)


def first_far_each(upto: np.ndarray, lat: np.ndarray, lon: np.ndarray, radii: list[float]) -> np.ndarray:
    """For each radius and row, the first later row before ``upto`` that is further than the radius, else ``upto``. Distances are measured once for all radii."""
    n = len(lat)
    out = np.tile(upto, (len(radii), 1))
    seen, width = np.arange(n) + 1, 8
    live = np.flatnonzero(seen < upto)
    most = int(np.argmax(radii)) if radii else 0
    while len(live):
        for part in np.array_split(live, max(1, len(live) * width >> 20)):
            row = seen[part, None] + np.arange(width)
            inside = row < upto[part, None]
            row = np.minimum(row, n - 1)
            d = distances_m(lat[part, None], lon[part, None], lat[row], lon[row])
            for k, radius in enumerate(radii):
                far = inside & (d > radius)
                hit = far.any(axis=1) & (out[k, part] == upto[part])
                out[k, part[hit]] = seen[part[hit]] + far[hit].argmax(axis=1)
            seen[part] = np.where(out[most, part] < upto[part], upto[part], seen[part] + width)
        live = live[seen[live] < upto[live]]
        width = min(2 * width, 4096)
    return out


def stays_each(sequence: np.ndarray, micros: np.ndarray, lat: np.ndarray, lon: np.ndarray, gaps: list[float], radii: list[float], dwells: list[float]) -> Iterator[tuple[float, float, float, np.ndarray, np.ndarray]]:
    """gap, radius, dwell, and first row and row after the last of each stay, for every combination. sequence rises from one to the next."""
    n = len(micros)
    if not n:
        return
    edge = np.append(True, sequence[1:] != sequence[:-1])

    def ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.flatnonzero(new)
        return heads, np.append(heads[1:], n)

    heads, tails = ends(edge)
    number = np.cumsum(edge) - 1
    longest = round(max(dwells) * 1e6)
    # Times rise from one sequence to the next, so all are searched at once.
    shift = np.cumsum(np.append(0, micros[tails[:-1] - 1] - micros[heads[1:]] + 2 * longest + 1))
    flat = micros + shift[number]
    due = {d: np.searchsorted(flat, flat + round(d * 1e6)) for d in dwells}
    far = first_far_each(np.minimum(due[max(dwells)] + 1, tails[number]), lat, lon, radii)
    step = np.append(0, np.diff(micros))
    for gap in gaps:
        heads, tails = ends(edge | (step > gap * 1e6))
        end = np.repeat(tails, tails - heads)
        for k, radius in enumerate(radii):
            for dwell in dwells:
                reach = due[dwell]
                begins = np.flatnonzero((reach < end) & (end - np.arange(n) > 1) & (far[k] > np.maximum(reach, np.arange(n) + 1)))
                first, last = [], []
                at, live = np.searchsorted(begins, heads), np.arange(len(heads))
                while len(live):
                    live = live[at[live] < len(begins)]
                    live = live[begins[at[live]] < tails[live]]
                    anchor = begins[at[live]]
                    stop = first_far(anchor, tails[live], lat, lon, radius)
                    first.append(anchor)
                    last.append(stop)
                    at[live] = np.searchsorted(begins, stop)
                first, last = (np.concatenate(x) for x in (first, last))
                order = np.argsort(first)
                yield gap, radius, dwell, first[order], last[order]


def sweep_staypoints(cleaned: DataFrame, gaps_s: list[float], radii_m: list[float], dwells_s: list[float]) -> DataFrame:
    """gap_s, radius_m, dwell_s and the stays of detect_staypoints() for each combination. cleaned: points cleaned with the largest gap."""
    require(cleaned, "user_id", "sequence_id", "ts", "lat", "lon")
    if min([*radii_m, *dwells_s, *gaps_s]) < 0:
        raise ValueError("thresholds must not be negative")
    names = ["user_id", "sequence_id", "arrival", "departure", "duration_s", "lat", "lon", "n_points"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["user_id", "sequence_id"]):
            user, sequence, lat, lon = (np.asarray(t[c]) for c in ("user_id", "sequence_id", "lat", "lon"))
            ts = np.asarray(t["ts"]).astype("datetime64[us]")
            micros = ts.astype(np.int64)
            number = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for gap, radius, dwell, first, stop in stays_each(number, micros, lat, lon, gaps_s, radii_m, dwells_s):
                own = [user[first], sequence[first], ts[first], ts[stop - 1], (micros[stop - 1] - micros[first]) / 1e6, medians(lat, first, stop), medians(lon, first, stop), stop - first]
                config = [np.full(len(first), x, float) for x in (gap, radius, dwell)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*config, *own]], names=["gap_s", "radius_m", "dwell_s", *names])

    lone = cleaned.select(F.col("user_id").cast("long").alias("user_id"), F.col("sequence_id").cast("long").alias("sequence_id"), "ts", "lat", "lon")
    w = Window.partitionBy("user_id", "sequence_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    span = F.timestamp_diff("MICROSECOND", F.first("ts").over(w), F.last("ts").over(w)) / 1e6
    dealt = lone.repartition("user_id", "sequence_id").withColumn("span", span).where(F.col("span") >= min(dwells_s)).drop("span")
    return dealt.sortWithinPartitions("user_id", "sequence_id", "ts").mapInArrow(run, "gap_s double, radius_m double, dwell_s double, " + STAYS)


def any_near(lat: np.ndarray, lon: np.ndarray, most_m: float) -> bool:
    """Whether any two points are at most most_m apart. Two points of one cell of that diagonal are; else no cell has two, so few pairs are left to measure."""
    step = most_m / 111_200.0 / 2**0.5
    row = np.floor(lat / step)
    column = np.floor(lon * np.cos(np.radians(np.minimum(np.abs(row), np.abs(row + 1)) * step)) / step)
    if len(np.unique(np.stack([row, column]), axis=1).T) < len(lat):
        return True
    return len(near_pairs(lat, lon, most_m)[0]) > 0


CONFIG = ["gap_s", "radius_m", "dwell_s"]


def grid_summary(swept: DataFrame, users: DataFrame, grid: DataFrame, repeat_m: float) -> DataFrame:
    """A row a combination of grid: stays, users with stays, stays a user over all users and their median over those with any, users with two stays or more, how many of these
    have two stays within repeat_m of each other, and the median and 90th percentile of durations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [*CONFIG, "user_id"]
        for t, at in whole_groups(batches, keys):
            lat, lon = np.asarray(t["lat"]), np.asarray(t["lon"])
            near = [any_near(lat[a:b], lon[a:b], repeat_m) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[t[k].take(pa.array(at[:-1])).combine_chunks() for k in keys], pa.array(near)], names=[*keys, "near"])

    by_user = swept.groupBy(*CONFIG, "user_id").agg(F.count("*").alias("n"))
    sorted_stays = swept.select(*CONFIG, "user_id", "lat", "lon").repartition(*CONFIG, "user_id").sortWithinPartitions(*CONFIG, "user_id")
    near = sorted_stays.mapInArrow(run, "gap_s double, radius_m double, dwell_s double, user_id long, near boolean")
    counted = by_user.join(near, [*CONFIG, "user_id"]).groupBy(*CONFIG).agg(
        F.count("*").alias("users_with_stays"), F.median("n").alias("median_stays_per_active_user"), F.count_if(F.col("n") > 1).alias("users_with_2plus_stays"), F.count_if((F.col("n") > 1) & F.col("near")).alias("repeat_location_users"))
    long = swept.groupBy(*CONFIG).agg(F.count("*").alias("n_stays"), F.median("duration_s").alias("median_duration_s"), F.percentile("duration_s", 0.9).alias("p90_duration_s"))
    all_users = users.select("user_id").distinct().agg(F.count("*").alias("all_users"))
    # One row of counts.
    out = grid.join(long, CONFIG, "left").join(counted, CONFIG, "left").join(F.broadcast(all_users)).fillna(0, ["n_stays", "users_with_stays", "users_with_2plus_stays", "repeat_location_users"])
    return out.withColumns({
        "mean_stays_per_user": F.try_divide("n_stays", "all_users"), "repeat_location_user_rate": F.try_divide("repeat_location_users", "users_with_2plus_stays"),
    }).drop("all_users")


def cut_at(lat: np.ndarray, lon: np.ndarray, thresholds: list[float]) -> np.ndarray:
    """The complete-link clusters at each threshold (a row each; a cluster is told by its least member), from the merges of one run."""
    out = np.tile(np.arange(len(lat)), (len(thresholds), 1))
    group = chained(lat, lon, max(thresholds))
    names, size = np.unique(group, return_counts=True)
    for name in names[size > 1].tolist():
        own = np.flatnonzero(group == name)
        label = np.tile(np.arange(len(own)), (len(thresholds), 1))
        for i, j, height in merges(lat[own], lon[own], max(thresholds)):
            for k, t in enumerate(thresholds):
                if height <= t:
                    label[k][label[k] == j] = i
        out[:, own] = own[label]
    return out


def numbered_at(stays: DataFrame, thresholds_m: list[float]) -> DataFrame:
    """stays with location_ids: the numbers of their places, by first arrival within a user, at each threshold."""
    return numbered_places(stays, T.StructField("location_ids", T.ArrayType(T.LongType())), lambda lat, lon: cut_at(lat, lon, thresholds_m))


def at_thresholds(numbered: DataFrame, thresholds_m: list[float]) -> DataFrame:
    """threshold_m and the stays with location_id, a row for each of numbered_at()'s thresholds."""
    each = F.inline(F.arrays_zip(F.array(*[F.lit(float(t)) for t in thresholds_m]).alias("threshold_m"), F.col("location_ids").alias("location_id"))).alias("threshold_m", "location_id")
    stays = [c for c in numbered.columns if c != "location_ids"]
    return numbered.select(*stays, each).select("threshold_m", *stays, "location_id")


def sweep_locations(stays: DataFrame, thresholds_m: list[float]) -> DataFrame:
    """threshold_m and the stays with location_id, numbered by first arrival within a user, at each threshold."""
    return at_thresholds(numbered_at(stays, thresholds_m), thresholds_m)


ANCHORS = ("no_stable_anchor", "dominant_anchor", "two_anchor", "multiple_anchor")


def location_sensitivity(swept: DataFrame, baseline_m: float) -> DataFrame:
    """A row a threshold of sweep_locations() with local times: users by how many places recur, recurring places, and how many users' first place and
    user-days' motif are the same as at the baseline, of those that the baseline has."""
    per_place = swept.groupBy("threshold_m", "user_id", "location_id").agg(F.count("*").alias("n"))
    per_user = per_place.groupBy("threshold_m", "user_id").agg(F.count_if(F.col("n") >= 2).alias("recurring"))
    kinds = per_user.groupBy("threshold_m").agg(F.sum("recurring").alias("recurring_locations"), *[F.count_if(F.col("recurring") == k if k < 3 else F.col("recurring") >= 3).alias(name) for k, name in enumerate(ANCHORS)])
    # A user's rows at all thresholds stand beside each other, so the baseline is seen there and nothing is worked out again for a join.
    baseline = lambda c, *by: F.max(F.when(F.col("threshold_m") == baseline_m, F.col(c))).over(Window.partitionBy(*by))
    # The members of a user's first place, whatever their order, as one number each and their count.
    member = F.xxhash64("arrival", "departure").cast("decimal(38,0)")
    first = swept.where("location_id = 0").select("threshold_m", "user_id", "arrival", "departure", member.alias("m")).distinct()
    top = first.groupBy("threshold_m", "user_id").agg(F.struct(F.sum("m").alias("members"), F.count("*").alias("n")).alias("top")).withColumn("base", baseline("top", "user_id"))
    same_top = top.groupBy("threshold_m").agg(F.count_if(F.col("top") == F.col("base")).alias("same_top"), F.count("*").alias("tops"))
    motifs = days.daily_motifs(swept, "threshold_m").withColumn("base", baseline("motif", "user_id", "local_date"))
    same_motif = motifs.groupBy("threshold_m").agg(F.count_if(F.col("motif") == F.col("base")).alias("same_motif"), F.count("*").alias("motifs"))
    # A row a threshold; the baseline's counts go to all of them.
    joined = kinds.join(same_top, "threshold_m", "left").join(same_motif, "threshold_m", "left")
    joined = joined.withColumns({c: baseline(c, F.lit(0)) for c in ("tops", "motifs")})
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(1.0))
    return joined.select("threshold_m", *ANCHORS, "recurring_locations", share("same_top", "tops").alias("top_anchor_stability"), share("same_motif", "motifs").alias("motif_stability"))
