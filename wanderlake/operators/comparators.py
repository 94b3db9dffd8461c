"""Comparators: other published rules for HOME and OFFICE over the same stays, and how near their places are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .evidence import WindowRule, contributions


def stay_hours(semantic: DataFrame, locations: DataFrame) -> DataFrame:
    """One row for each local hour that a stay touches, that of its end included, at the location's centre."""
    hour = lambda c: F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")
    h = semantic.select("user_id", "location_id", F.explode(F.sequence(hour("local_arrival"), hour("local_departure"), F.expr("interval 1 hour"))).alias("at"))
    return h.join(locations.select("user_id", "location_id", "lat", "lon"), ["user_id", "location_id"])


def night_home(semantic: DataFrame, locations: DataFrame, start_hour: int = 22, end_hour: int = 7) -> DataFrame:
    """The place of most arrivals from 22:00 to 07:00 (either included), of all arrivals where a user has none at night; ties by coordinates."""
    second = F.hour("local_arrival") * 3600 + F.minute("local_arrival") * 60 + F.second("local_arrival")
    night = (second >= start_hour * 3600) | (second <= end_hour * 3600)
    s = semantic.select("user_id", "location_id", night.alias("night")).join(locations.select("user_id", "location_id", "lat", "lon"), ["user_id", "location_id"])
    g = s.groupBy("user_id", "lat", "lon").agg(F.count_if("night").alias("at_night"), F.count("*").alias("all"), F.min("location_id").alias("location_id"))
    nights = F.sum("at_night").over(Window.partitionBy("user_id"))
    g = g.withColumn("nights", nights).withColumn("used", F.when(F.col("nights") > 0, F.col("at_night")).otherwise(F.col("all")))
    w = Window.partitionBy("user_id").orderBy(F.desc("used"), "lat", "lon")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "location_id", "nights", (F.col("nights") == 0).alias("all_visits"))


#: Rest and work hours of the two-place comparator, on every day of the week.
REST, WORK = WindowRule("HOME", 0, 6, tuple(range(7)), 0, 0, 0), WindowRule("OFFICE", 8, 18, tuple(range(7)), 0, 0, 0)


def two_place_candidates(semantic: DataFrame, locations: DataFrame) -> DataFrame:
    """Of the two places with most stays (users with two or more), that with most dwell at rest hours and that with most at work hours."""
    w = Window.partitionBy("user_id")
    top = locations.withColumns({"r": F.row_number().over(w.orderBy(F.desc("stay_count"), "location_id")), "n": F.count("*").over(w)}).where("r <= 2 and n >= 2").select("user_id", "location_id", "stay_count")
    out = None
    for rule in (REST, WORK):
        dwell = contributions(semantic, rule).groupBy("user_id", "location_id").agg(F.sum("overlap_s").alias("s"))
        j = top.join(dwell, ["user_id", "location_id"], "left").fillna({"s": 0.0})
        best = j.withColumn("r", F.row_number().over(w.orderBy(F.desc("s"), F.desc("stay_count"), "location_id"))).where("r = 1")
        rows = best.select("user_id", F.lit(rule.label).alias("label"), "location_id", (F.col("s") / 3600).alias("dwell_h"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("same_place", F.min("location_id").over(w) == F.max("location_id").over(w))


def nearest_places(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each place of left (user_id, location_id, lat, lon), the nearest of the user's places of right, and its distance; null where there is none.

    A user's places meet each other; their number is that of places a person has.
    """
    r = right.select("user_id", F.col("location_id").alias("other_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    j = left.join(r, "user_id", "left").withColumn("d", haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    best = j.groupBy("user_id", "location_id").agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", "other_id"))).alias("m"))
    return best.select("user_id", "location_id", F.col("m.other_id").alias("nearest_id"), F.col("m.d").alias("distance_m"))


def compare_candidates(universe: DataFrame, production: DataFrame, other: DataFrame, labels: tuple[str, ...] = ("HOME", "OFFICE")) -> DataFrame:
    """Every user and label of the universe with the place of either source, and one of five states."""
    u = universe.select("user_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    j = u.join(production.select("user_id", "label", F.col("location_id").alias("a")), ["user_id", "label"], "left").join(other.select("user_id", "label", F.col("location_id").alias("b")), ["user_id", "label"], "left")
    state = F.when(F.col("a").isNull() & F.col("b").isNull(), "both_abstain").when(F.col("b").isNull(), "production_only").when(F.col("a").isNull(), "comparator_only").when(F.col("a") == F.col("b"), "same_place").otherwise("different_place")
    return j.withColumn("state", state)
