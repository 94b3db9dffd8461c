"""Edge cases of the trajectory operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderlake.functions import geo
from wanderlake.operators import clean, evidence, locate, recommend, stays
from wanderlake.sources.trajectories import read_mode_labels, read_points

T0 = dt.datetime(2024, 1, 1, 12)


def points(spark, rows):
    return spark.createDataFrame([(1, T0 + dt.timedelta(seconds=s), lat, lon) for s, lat, lon in rows], "user_id long, ts timestamp_ntz, lat double, lon double")


def test_cleaning_boundaries(spark):
    p = points(spark, [(0, 39.9, 116.4), (60, 200.0, 116.4), (120, 39.9, 116.4), (121, 39.9, 116.4), (121, 39.95, 116.4), (180, 39.9, 116.4), (480, 39.9, 116.4), (781, 39.9, 116.4), (841, 40.9, 116.4)])
    got = [(r.sequence_id, r.boundary_before_reason) for r in clean.clean_trajectory(p).orderBy("ts").collect()]
    assert got == [(0, None), (1, "invalid_coordinate"), (2, "same_second_spatial_ambiguity"), (2, None), (3, "temporal_gap"), (4, "hard_speed_guard")]
    reasons = sorted(r.reason for r in clean.audit_events(p).collect())
    assert reasons == ["hard_speed_guard", "invalid_coordinate", "same_second_spatial_ambiguity", "temporal_gap"]


def test_first_boundary_keeps_its_reason_without_a_new_sequence(spark):
    got = clean.clean_trajectory(points(spark, [(0, 99.0, 0.0), (60, 39.9, 116.4)])).collect()
    assert [(r.sequence_id, r.boundary_before_reason) for r in got] == [(0, "invalid_coordinate")]


def test_cleaning_empty_and_missing(spark):
    assert clean.clean_trajectory(points(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="missing"):
        clean.clean_trajectory(points(spark, [(0, 1.0, 1.0)]).drop("lat"))


def test_stay_walk():
    t = np.arange(0, 3000, 300.0)
    lat, lon = np.full(10, 39.9), np.full(10, 116.4)
    assert stays.walk(t, lat, lon, 200, 1200) == [(0, 9)]
    lat[5:] += 0.01
    assert stays.walk(t, lat, lon, 200, 1200) == [(0, 4), (5, 9)]
    assert stays.walk(t[:4], lat[:4], lon[:4], 200, 1200) == []


def test_complete_link_stops_at_the_diameter():
    lat = np.array([39.9, 39.9 + 150 / 111_195, 39.9 + 300 / 111_195])
    lon = np.full(3, 116.4)
    assert len(set(locate.complete_link(lat, lon, 200))) == 2
    assert len(set(locate.chained(lat, lon, 200))) == 1


def test_window_over_a_shifted_clock(spark):
    s = spark.createDataFrame([(1, 0, dt.datetime(2026, 3, 8, 2), dt.datetime(2026, 3, 8, 11), "America/New_York")], "user_id long, location_id long, arrival timestamp_ntz, departure timestamp_ntz, timezone_id string")
    s = s.withColumns({f"local_{c}": F.convert_timezone(F.lit("UTC"), F.col("timezone_id"), F.col(c)) for c in ("arrival", "departure")})
    got = evidence.contributions(s, evidence.HOME).collect()
    assert [(str(r.behavior_date), r.overlap_s) for r in got] == [("2026-03-07", 8 * 3600.0)]


def test_geohash(spark):
    r = spark.range(1).select(geo.geohash(F.lit(57.64911), F.lit(10.40744), 7).alias("g")).first()
    assert r.g == "u4pruyd"


def test_suggestions_ignore_the_future_and_the_origin(spark):
    v = [("a", "home", T0 + dt.timedelta(days=d), "work") for d in range(3)] + [("a", "work", T0 + dt.timedelta(days=d, hours=1), "home") for d in range(3)] + [("a", "gym", T0 + dt.timedelta(days=9), None)] * 3
    visits = spark.createDataFrame(v, "owner_id string, place_id string, observed_at timestamp_ntz, origin_place_id string")
    q = spark.createDataFrame([("a", T0 + dt.timedelta(days=4), "work")], "owner_id string, query_at timestamp_ntz, origin string")
    assert [r.place_id for r in recommend.suggest_destinations(visits, q).collect()] == ["home"]


def test_readers(spark, tmp_path):
    d = tmp_path / "007" / "Trajectory"
    d.mkdir(parents=True)
    (d / "1.plt").write_text("a\nb\nc\nd\ne\nf\n39.9,116.4,0,492,39744.1,2008-10-23,02:53:04\n")
    (tmp_path / "007" / "labels.txt").write_text("Start Time\tEnd Time\tMode\n2008/10/23 02:00:00\t2008/10/23 03:00:00\twalk\n")
    r = read_points(spark, str(d / "*.plt")).first()
    assert (r.user_id, r.lat, str(r.ts)) == ("007", 39.9, "2008-10-23 02:53:04")
    m = read_mode_labels(spark, str(tmp_path / "007" / "labels.txt")).first()
    assert (m.user_id, m["mode"]) == ("007", "walk")


def test_streaming_sessions_match_the_table(spark, tmp_path):
    from wanderlake.streaming.sessions import sessions

    rows = [(1, T0 + dt.timedelta(seconds=s)) for s in (0, 100, 350, 1000, 1100)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream, "300 seconds").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("sess").collect()) == sorted(r.n for r in sessions(df, "300 seconds").collect()) == [2, 3]


def test_first_heldout_takes_whole_seventieths(spark):
    v = spark.range(90).selectExpr("1L as owner_id", "cast(id % 3 as string) as place_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) as observed_at", "cast(null as string) as origin_place_id")
    train, target = recommend.first_heldout(v)
    assert train.count() == 63 and target.first().query_at == dt.datetime(2024, 3, 4)
