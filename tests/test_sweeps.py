"""Sweeps against separate runs."""

import itertools
import random
import time

import numpy as np
import pytest

from wanderlake.operators import clean, locate, stays, sweeps


@pytest.fixture(scope="module")
def walks(spark):
    r = random.Random(3)
    rows = []
    for user in range(12):
        t, lat, lon = 0, 39.9, 116.4
        for _ in range(600):
            t += r.choice([5, 30, 60, 60, 120, 200, 290, 450, 900])
            if r.random() < 0.15:
                lat, lon = lat + r.uniform(-0.004, 0.004), lon + r.uniform(-0.004, 0.004)
            rows.append((user, t, lat + r.gauss(0, 0.0003), lon + r.gauss(0, 0.0003)))
    df = spark.createDataFrame(rows, "user_id long, t long, lat double, lon double")
    return df.selectExpr("user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) as ts", "lat", "lon")


GAPS, RADII, DWELLS = [240.0, 300.0, 600.0], [60.0, 100.0, 300.0], [300.0, 1200.0, 1800.0]


def test_grid_equals_separate_runs(spark, walks):
    swept = sweeps.sweep_staypoints(clean.clean_trajectory(walks, clean.CleaningConfig(max_gap_s=600)), GAPS, RADII, DWELLS).collect()
    got = {}
    for r in swept:
        got.setdefault((r.gap_s, r.radius_m, r.dwell_s), []).append((r.user_id, r.arrival, r.departure, r.lat, r.lon, r.n_points))
    for gap in GAPS:
        cleaned = clean.clean_trajectory(walks, clean.CleaningConfig(max_gap_s=gap)).cache()
        for radius, dwell in itertools.product(RADII, DWELLS):
            want = sorted((r.user_id, r.arrival, r.departure, r.lat, r.lon, r.n_points) for r in stays.detect_staypoints(cleaned, radius, dwell).collect())
            assert sorted(got.get((gap, radius, dwell), [])) == want
        cleaned.unpersist()
    assert len(swept) > 500


def test_thresholds_equal_separate_runs(spark, walks):
    found = stays.detect_staypoints(clean.clean_trajectory(walks), 100.0, 300.0).cache()
    thresholds = [50.0, 200.0, 500.0, 2000.0]
    swept = {}
    for r in sweeps.sweep_locations(found, thresholds).collect():
        swept.setdefault(r.threshold_m, []).append((r.user_id, r.arrival, r.location_id))
    for t in thresholds:
        assert sorted(swept[t]) == sorted((r.user_id, r.arrival, r.location_id) for r in locate.cluster_stays(found, threshold_m=t).collect())
    assert len({x[::2] for x in swept[50.0]}) > len({x[::2] for x in swept[2000.0]})


def test_a_grid_costs_far_less_than_its_runs():
    """The kernel alone, on a long walk with long stays."""
    r = np.random.default_rng(1)
    n = 150_000
    micros = np.cumsum(r.integers(5, 60, n)) * 1_000_000
    base = np.repeat(np.cumsum(r.normal(0, 0.01, n // 500)), 500)
    lat, lon = 39.9 + base + r.normal(0, 2e-4, n), 116.4 + r.normal(0, 2e-4, n)
    sequence = np.arange(n) // 5000

    def timed(f):
        began = time.perf_counter()
        out = f()
        return time.perf_counter() - began, out

    alone = [timed(lambda: stays.stays_of(sequence, micros, lat, lon, 300.0, 1800.0))[0] for _ in range(3)]
    grid = [timed(lambda: list(sweeps.stays_each(sequence, micros, lat, lon, [300.0], [100.0, 200.0, 300.0], [600.0, 1200.0, 1800.0])))[0] for _ in range(3)]
    # Nine runs in one. The bound is wide, as the machine may be busy.
    assert min(grid) < 5 * min(alone)


def test_points_near_each_other():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 90))
        lat, lon = r.uniform(-70, 70) + r.uniform(0, 0.03, n), r.uniform(-170, 170) + r.uniform(0, 0.03, n)
        i, j = np.triu_indices(n, 1)
        d = stays.distances_m(lat[i], lon[i], lat[j], lon[j])
        for m in (5.0, 40.0, 200.0):
            assert sweeps.any_near(lat, lon, m) == bool((d <= m).any())


def test_sensitivity_of_locations(spark):
    """At a small threshold a user's one place falls apart; the other user is not changed."""
    rows = [(1, f"2024-01-0{d} 10:00:00", 39.9 + 0.001 * (d % 2), 116.4) for d in range(1, 6)] + [(2, "2024-01-01 10:00:00", 30.0, 100.0)]
    s = spark.createDataFrame(rows, "user_id long, t string, lat double, lon double").selectExpr("user_id", "to_timestamp_ntz(t) as arrival", "to_timestamp_ntz(t) + interval 1 hour as departure", "lat", "lon", "to_timestamp_ntz(t) as local_arrival")
    got = {r.threshold_m: r for r in sweeps.location_sensitivity(sweeps.sweep_locations(s, [50.0, 200.0]), 200.0).collect()}
    assert (got[200.0].dominant_anchor, got[200.0].no_stable_anchor, got[200.0].recurring_locations, got[200.0].top_anchor_stability) == (1, 1, 1, 1.0)
    assert (got[50.0].two_anchor, got[50.0].recurring_locations, got[50.0].top_anchor_stability) == (1, 2, 0.5) and got[50.0].motif_stability == pytest.approx(4 / 6)


def test_stays_and_places_of_a_sweep_are_worked_out_once(spark):
    from wanderlake.plans.sweeps import location_sensitivity

    plan = location_sensitivity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Kernels have run by then; no branch runs them again, and no branch meets another one's stays.
    assert "MapInArrow" not in plan and "SortMergeJoin" not in plan.replace("SortMergeJoin [threshold_m", "")


def test_places_at_several_thresholds_are_those_of_separate_runs(spark, walks):
    s = stays.detect_staypoints(clean.clean_trajectory(walks, clean.CleaningConfig(max_gap_s=600)), 200.0, 600.0)
    swept = sweeps.sweep_locations(s, [100.0, 400.0]).collect()
    for t in (100.0, 400.0):
        own = {(r.user_id, r.arrival, r.location_id) for r in locate.cluster_stays(s, "complete_link", t).collect()}
        assert own and own == {(r.user_id, r.arrival, r.location_id) for r in swept if r.threshold_m == t}
