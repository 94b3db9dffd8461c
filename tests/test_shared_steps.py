"""The steps that nearly all queries share: how often rows are dealt out, and that stays are made once."""

import datetime as dt

import numpy as np

from pyspark.sql import functions as F

from wanderlake.operators import clean, locate, reliability, stays
from wanderlake.plans import home_office
from wanderlake.sources import shared
from wanderlake.sources.trajectories import points, table

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_dealt_out_once_and_stays_are_not_joined(spark):
    found = stays.detect_staypoints(clean.clean_trajectory(points(table(spark, SMALL, "events"))))
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert plan(locate.cluster_stays(found)).count("Exchange hashpartitioning") == 2 and "Join" not in plan(locate.cluster_stays(found))


def test_located_stays_are_a_table_and_not_cached(spark):
    s = home_office.from_events(spark, SMALL).semantic
    assert "InMemoryTableScan" not in plan(s) and "MapInArrow" not in plan(s) and s.count() > 0


def test_spots_of_users(spark):
    user = np.array([1, 1, 1, 2, 2, 2, 2])
    lat, lon = np.array([5.0, 0.0, 5.0, 5.0, -0.0, np.nan, 0.0]), np.array([1.0, 0.0, 1.0, 1.0, 0.0, 1.0, -0.0])
    first, spot = locate.spots(user, lat, lon)
    assert first.tolist() == [0, 1, 3, 4, 5] and spot.tolist() == [0, 1, 0, 2, 3, 4, 3]


def test_medians_of_a_timestamp_with_several_rows(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, 40.0, 116.0), (1, at, 40.00002, 116.00004), (1, at, 40.00006, 116.0), (1, at, 200.0, 116.0), (2, at, None, 1.0)]
    got = {r.user_id: r for r in clean.timestamp_summary(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, lat double, lon double")).collect()}
    assert (got[1].all_count, got[1].valid_count, got[1].lat, got[1].lon) == (4, 3, 40.00002, 116.0) and 3 < got[1].max_radius_m < 6
    assert (got[2].all_count, got[2].valid_count, got[2].lat, got[2].max_radius_m) == (1, 0, None, None)


def test_timestamps_are_summed_up_in_one_window_as_medians_say(spark):
    r = np.random.default_rng(4)
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), float(r.choice([40 + r.normal(0, 1e-4), -0.0, 95.0])), float(116 + r.normal(0, 1e-4))) for u in range(3) for k in range(60) for _ in range(1 + (u + k) % 7)]
    p = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, lat double, lon double")
    s = clean.timestamp_summary(p)
    assert "Aggregate" not in plan(s) and plan(s).count("Window [") == 1 and plan(s).count("Sort [") == 1
    got = {(x.user_id, x.ts): x for x in s.collect()}
    assert len(got) == 180 == s.count()
    for (user, ts), x in got.items():
        own = [(la, lo) for u, t, la, lo in rows if (u, t) == (user, ts)]
        ok = np.array([v for v in own if abs(v[0]) <= 90])
        assert (x.all_count, x.valid_count) == (len(own), len(ok))
        if len(ok):
            lat, lon = np.median(ok, axis=0)
            assert (x.lat, x.lon) == (lat, lon) and abs(x.max_radius_m - stays.distances_m(lat, lon, ok[:, 0], ok[:, 1]).max()) <= 1e-6 * (1 + x.max_radius_m)
        else:
            assert (x.lat, x.lon, x.max_radius_m) == (None, None, None)


def test_points_and_stays_are_dealt_out_in_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    x = home_office.from_events(spark, SMALL)
    events, n = table(spark, SMALL, "events").count(), x.semantic.count()
    # Adaptive execution may not join the parts again, as it knows packed bytes only.
    assert home_office.observations(spark, SMALL).rdd.getNumPartitions() == -(-events // 100) > 4
    assert x.semantic.rdd.getNumPartitions() == max(4, -(-n // 100))


def test_assignments_deal_out_no_stays_again(spark):
    s = home_office.from_events(spark, SMALL).semantic
    assert plan(reliability._chosen(reliability.place_evidence(s), reliability.USER, [(F.lit(True), F.struct("location_id"))])).count("Exchange hashpartitioning") == 1
    assert plan(reliability.dominant_hours(s)).count("Exchange hashpartitioning") == 1
    details = plan(reliability.dropout(s))
    # Stays once for each of three passes; then places, and candidates by method and label.
    assert details.count("REPARTITION_BY_NUM") == 3 and details.count("Exchange hashpartitioning") <= 6


def test_replicates_of_days_are_not_dealt_out_again(spark):
    from wanderlake.operators import routines
    from wanderlake.plans import queries  # noqa: F401 (the registry loads the plans in their order)
    from wanderlake.plans.habits import _routine

    sequences, moves, _ = _routine(spark, SMALL)
    days = shared.dealt(shared.kept(routines.days_with_moves(moves, sequences), "days"), "user_id")
    null = routines.partition_null(days, 5, 42)
    assert plan(null).count("Exchange ") == 1 and "Join" not in plan(null)
    assert days.count() == sequences.count() > 0 and days.selectExpr("sum(size(pairs)) as n").first().n == moves.count() > 0
