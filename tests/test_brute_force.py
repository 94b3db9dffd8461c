"""Kernels and relational pieces against plain versions."""

import datetime as dt
import itertools

import numpy as np
import pytest

from wanderlake.operators import clean, joins, locate, relational, routines, stays, userdays

T0 = dt.datetime(2024, 1, 1)


def plain_stays(sequence, micros, lat, lon, radius, dwell):
    out = []
    for s in np.unique(sequence):
        row, a = np.flatnonzero(sequence == s), 0
        while a < len(row):
            b = a + 1
            while b < len(row) and stays.distances_m(lat[row[a]], lon[row[a]], lat[row[b : b + 1]], lon[row[b : b + 1]])[0] <= radius:
                b += 1
            if b - 1 > a and micros[row[b - 1]] - micros[row[a]] >= dwell * 1e6:
                out.append((row[a], row[b - 1] + 1))
                a = b
            else:
                a += 1
    return out


def test_stays_of_long_walks():
    r = np.random.default_rng(0)
    for _ in range(60):
        n = int(r.integers(0, 150))
        sequence = np.sort(r.integers(0, 5, n))
        micros = np.concatenate([np.cumsum(r.integers(1, 300, (sequence == s).sum())) for s in range(5)]).astype(np.int64) * 1_000_000
        step = r.choice([0.0003, 0.001])
        lat, lon = (c + np.cumsum(r.normal(0, step, n) * (r.random(n) < 0.5)) for c in (40, 116))
        first, stop = stays.stays_of(sequence, micros, lat, lon, 200.0, 1200.0)
        assert list(zip(first.tolist(), stop.tolist(), strict=True)) == plain_stays(sequence, micros, lat, lon, 200.0, 1200.0)
        assert np.allclose(stays.medians(lat, first, stop), [np.median(lat[a:b]) for a, b in zip(first, stop, strict=True)])


def test_dwell_and_radius_at_their_limits(spark):
    at = lambda s, lat: (1, 0, T0 + dt.timedelta(seconds=s), lat, 116.4)
    edge = 39.9 + 199.9 / 111_194.93
    rows = [at(0, 39.9), at(600, edge), at(1200, 39.9), at(1800, 39.9 + 201 / 111_194.93)]
    df = spark.createDataFrame(rows, "user_id long, sequence_id long, ts timestamp_ntz, lat double, lon double")
    got = [(r.duration_s, r.n_points) for r in stays.detect_staypoints(df).collect()]
    assert got == [(1200.0, 3)] and stays.detect_staypoints(df, min_dwell_s=1201).count() == 0


def test_near_pairs_and_complete_link():
    r = np.random.default_rng(1)
    canon = lambda x: [list(x).index(v) for v in x]
    for n, scale, centre in itertools.product((0, 1, 50, 120), (0.002, 0.02), (0, -60, 80)):
        lat, lon = centre + r.normal(0, scale, n), 116 + r.normal(0, scale, n)
        d = stays.distances_m(lat[:, None], lon[:, None], lat[None], lon[None])
        i, j = locate.near_pairs(lat, lon, 200.0)
        assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(n) for b in range(a + 1, n) if d[a, b] <= 200}
        np.fill_diagonal(d, np.inf)
        label = np.arange(n)
        while n > 1:
            a, b = sorted(divmod(int(d.argmin()), n))
            if d[a, b] > 200:
                break
            label[label == b] = a
            d[a, :] = d[:, a] = np.maximum(d[a], d[b])
            d[a, a] = np.inf
            d[b, :] = d[:, b] = np.inf
        assert canon(locate.complete_link(lat, lon, 200.0).tolist()) == canon(label.tolist())


def test_chain_and_complete_link_differ(spark):
    rows = [(1, T0 + dt.timedelta(days=k), T0 + dt.timedelta(days=k, hours=1), 3600.0, 39.9 + k * 150 / 111_195, 116.4) for k in range(3)]
    df = spark.createDataFrame(rows, "user_id long, arrival timestamp_ntz, departure timestamp_ntz, duration_s double, lat double, lon double")
    ids = lambda m: [r.location_id for r in locate.cluster_stays(df, m, 200.0).orderBy("arrival").collect()]
    assert ids("dbscan") == [0, 0, 0] and ids("complete_link") == [0, 0, 1]
    assert locate.cluster_stays(df.limit(0)).count() == 0


def test_mode_windows(spark):
    t = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, t(0), t(30), "walk"), (1, t(30), t(60), "walk"), (1, t(50), t(80), "bus"), (1, t(80), t(80), "bike"), (1, t(10), t(20), "walk"), (2, t(0), t(5), "bus")]
    df = spark.createDataFrame(rows, "user_id long, start_time timestamp_ntz, end_time timestamp_ntz, mode string")
    got = sorted((r.user_id, r.start_time, r.end_time, r.mode) for r in joins.canonical_windows(df).collect())
    assert got == [(1, t(0), t(50), "walk"), (1, t(60), t(80), "bus"), (2, t(0), t(5), "bus")]


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert relational.unique_on(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        relational.unique_on(df.unionByName(df.limit(1)), ["k"]).collect()


def test_greedy_match(spark):
    a = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 1.1), ("t", 3, 5.0)], "stratum string, user_id long, x double")
    b = spark.createDataFrame([("s", 11, 1.05), ("s", 12, 4.0), ("u", 13, 5.0)], "stratum string, user_id long, x double")
    got = {(r.candidate, r.control) for r in relational.greedy_match(a, b, ["stratum"], "user_id", ["x"]).collect()}
    assert got == {(1, 11), (2, 12)}


def test_day_gates(spark):
    rows = [(1, 3, 2.0, 6.0, 1, 2.0), (2, 2, 2.0, 6.0, 1, 1.9), (3, None, None, None, 1, 2.5), (4, 3, 2.0, 6.1, 0, 0.0)]
    df = spark.createDataFrame(rows, "user_id long, point_count long, observed_span_h double, largest_gap_h double, stay_count long, stay_span_h double")
    got = {r.user_id: (r.usable_for_profile, r.usable_for_motif) for r in userdays.day_quality(df).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, True), 4: (False, False)}


def test_edges_of_one_row(spark):
    df = spark.createDataFrame([(1, T0, 39.9, 116.4)], "user_id long, ts timestamp_ntz, lat double, lon double")
    assert clean.consecutive_edges(clean.clean_trajectory(df)).count() == 0


def test_zones_by_cells(spark):
    rows = spark.createDataFrame([(1, 39.9, 116.4), (2, 200.0, 0.0), (3, 10.0, 10.0), (4, None, 1.0)], "user_id long, lat double, lon double")
    cells = spark.createDataFrame([(39, 116, "Asia/Shanghai")], "cy long, cx long, timezone_id string")
    got = {r.user_id: (r.timezone_id, r.zone_reason) for r in locate.resolve_zones(rows, cells, 1.0).collect()}
    assert got == {1: ("Asia/Shanghai", None), 2: (None, "invalid_coordinate"), 3: (None, "outside_of_zones"), 4: (None, "invalid_coordinate")}


def test_trajectories_are_cleaned_apart(spark):
    rows = [(1, t, T0 + dt.timedelta(seconds=60 * k), 39.9 + t, 116.4) for t in (0, 1) for k in range(3)]
    df = spark.createDataFrame(rows, "user_id long, trajectory_id long, ts timestamp_ntz, lat double, lon double")
    got = clean.clean_trajectory(df, key=["user_id", "trajectory_id"]).collect()
    assert len(got) == 6 and {r.sequence_id for r in got} == {0}
    assert clean.clean_trajectory(df).count() == 0  # one file: all seconds have two places


def test_departure_modes(spark):
    r = np.random.default_rng(2)
    one, two = (r.normal(23.9, 0.4, 40) % 24).tolist(), (np.concatenate([r.normal(8, 0.3, 25), r.normal(17.5, 0.3, 25)]) % 24).tolist()
    rows = [(1, 0, 1, h) for h in one] + [(1, 1, 0, h) for h in two] + [(1, 2, 0, 5.0)] * 3 + [(1, 3, 0, 5.0)] * 9
    df = spark.createDataFrame(rows, "user_id long, origin long, destination long, departure_hour double")
    got = {x.origin: x for x in routines.departure_modes(df).collect()}
    assert set(got) == {0, 1, 3} and got[0].modes == 1 and got[1].modes == 2 and got[3].modes == 1
    assert abs((got[0].hours[0] - 23.9 + 12) % 24 - 12) < 0.3 and np.allclose(got[1].hours, [8, 17.5], atol=0.3)
    assert got[1].bic_gain > 10 and {x.origin: x.modes for x in routines.departure_modes(df, least_hours=12.0).collect()}[1] == 1
