"""Edges whose departures are a third of a day apart have a concentration of exactly one half."""

from wanderlake.operators import routines


def test_concentration_at_a_threshold(spark):
    moves = spark.sql("select id as user_id, date_add(date'2024-01-01', d) as local_date, 0L as origin, 1L as destination, id / 7 + 8 * d as departure_hour from range(100) lateral view explode(array(0, 1)) t as d")
    days = moves.select("user_id", "local_date").distinct()
    edge = routines.edges(moves, days)
    grid = {(r.least_days, r.least_concentration): (r.edges, r.users) for r in routines.recurrence_grid(edge).collect()}
    assert grid[2, 0.5] == (100, 100) and grid[2, 0.7] == (0, 0)


def test_mean_hours_that_cancel_out_or_meet_at_midnight(spark):
    moves = spark.sql("select id as user_id, date_add(date'2024-01-01', d) as local_date, 0L as origin, 1L as destination, if(id < 50, id / 7 + 12 * d, if(d = 0, 24 - id / 70, id / 70)) as departure_hour from range(100) lateral view explode(array(0, 1)) t as d")
    got = routines.edges(moves, moves.select("user_id", "local_date").distinct()).collect()
    assert {r.hour for r in got if r.user_id < 50} == {None} and {r.hour for r in got if r.user_id >= 50} == {0.0}
