"""As-of, interval and spatial joins as equi-joins or windows, so that they stay hash-partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine_m


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the last value of right at or before its time, by key: one union and one window, no join."""
    tagged = left.select(F.struct("*").alias("row"), F.col(key), F.col(left_ts).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    other = right.select(F.lit(None).cast(tagged.schema["row"].dataType).alias("row"), F.col(key), F.col(right_ts).alias("t"), F.lit(0).alias("side"), F.col(value).alias("v"))
    w = Window.partitionBy(key).orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.unionByName(other).withColumn(f"asof_{value}", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("row.*", f"asof_{value}")


def canonical_windows(labels: DataFrame) -> DataFrame:
    """user_id, start_time, end_time, mode of the times in which exactly one mode is active; touching pieces of one mode are one.

    A sweep: starts and ends are summed along the time, first by mode, then over a user's modes; no interval meets another one.
    """
    ends = F.array(F.struct(F.col("start_time").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_time").alias("t"), F.lit(-1).alias("d")))
    steps = labels.where("end_time > start_time").select("user_id", "mode", F.inline(ends)).groupBy("user_id", "mode", "t").agg(F.sum("d").alias("d")).where("d <> 0")
    by_mode = Window.partitionBy("user_id", "mode").orderBy("t")
    on = F.sum("d").over(by_mode) > 0
    change = on.cast("int") - (F.sum("d").over(by_mode) - F.col("d") > 0).cast("int")
    by_user = Window.partitionBy("user_id").orderBy("t")
    m = steps.withColumn("change", change).where("change <> 0")
    # A user's modes are numbered, so that the sum of the numbers of active modes is that of the only one.
    m = m.withColumns({"number": F.dense_rank().over(Window.partitionBy("user_id").orderBy("mode")), "modes": F.sort_array(F.collect_set("mode").over(Window.partitionBy("user_id")))})
    at = m.groupBy("user_id", "t").agg(F.sum("change").alias("n"), F.sum(F.col("change") * F.col("number")).alias("number"), F.first("modes").alias("modes"))
    s = at.select("user_id", "t", F.lead("t").over(by_user).alias("until"), F.sum("n").over(by_user).alias("active"), F.sum("number").over(by_user).cast("int").alias("number"), "modes")
    single = s.where("active = 1 and until is not null").withColumn("mode", F.element_at("modes", F.col("number")))
    touches = (F.lag("until").over(by_user) == F.col("t")) & (F.lag("mode").over(by_user) == F.col("mode"))
    run = single.withColumn("new", F.when(touches, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_user))
    return run.groupBy("user_id", "run", "mode").agg(F.min("t").alias("start_time"), F.max("until").alias("end_time")).select("user_id", "start_time", "end_time", "mode")


def _days_of(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day")


def contained_in_one(segments: DataFrame, windows: DataFrame, segment_id: str) -> DataFrame:
    """Segments (user_id, start_time, end_time) that lie in exactly one window, with its mode: an equi-join on user and day of the segment's start."""
    s = segments.withColumn("day", F.to_date("start_time")).alias("s")
    w = windows.select("user_id", F.col("start_time").alias("w_start"), F.col("end_time").alias("w_end"), "mode", _days_of("start_time", "end_time"))
    found = s.join(w, ["user_id", "day"]).where((F.col("w_start") <= F.col("start_time")) & (F.col("end_time") <= F.col("w_end")))
    return found.groupBy(segment_id).agg(F.count("*").alias("n"), F.min("mode").alias("mode")).where("n = 1").select(segment_id, "mode")


def best_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """For each interval of left, the interval of right of the same user that overlaps it longest (ties: the least id).

    An equi-join on user and day; a pair counts on the day on which its overlap begins, so it is met once.
    """
    l = left.select("user_id", F.col(left_id), F.col("start_time").alias("l_start"), F.col("end_time").alias("l_end"), _days_of("start_time", "end_time"))
    r = right.select("user_id", F.col(right_id), F.col("start_time").alias("r_start"), F.col("end_time").alias("r_end"), _days_of("start_time", "end_time"))
    begins = F.greatest("l_start", "r_start")
    pairs = l.join(r, ["user_id", "day"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("day") == F.to_date(begins)))
    shared = F.timestamp_diff("SECOND", begins, F.least("l_end", "r_end"))
    pairs = pairs.withColumn("overlap_s", shared)
    return pairs.groupBy(left_id).agg(F.max(F.struct("overlap_s", (-F.col(right_id)).alias("o"))).alias("m")).select(left_id, (-F.col("m.o")).alias(right_id), F.col("m.overlap_s").alias("overlap_s"))


def within_radius(anchors: DataFrame, places: DataFrame, radius_m: float, cell_deg: float = 0.01) -> DataFrame:
    """anchor_id, place_id, distance_m of all pairs at most radius_m apart: an equi-join on grid cells, each anchor in as many as its circle may touch.

    Anchors and places: id, lat, lon. Latitudes under 80 degrees.
    """
    reach_lat = F.ceil(F.lit(radius_m / 110_574.0 / cell_deg)).cast("int")
    reach_lon = F.ceil(F.lit(radius_m / 111_320.0 / cell_deg) / F.cos(F.radians(F.least(F.abs("lat"), F.lit(80.0))))).cast("int")
    spread = lambda c, reach: F.explode(F.sequence(cell(F.col(c), cell_deg) - reach, cell(F.col(c), cell_deg) + reach))
    a = anchors.select(F.col("id").alias("anchor_id"), "lat", "lon", spread("lat", reach_lat).alias("cy")).select("anchor_id", "lat", "lon", "cy", spread("lon", reach_lon).alias("cx"))
    p = places.select(F.col("id").alias("place_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), cell(F.col("lat"), cell_deg).alias("cy"), cell(F.col("lon"), cell_deg).alias("cx"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    return a.join(p, ["cy", "cx"]).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).select("anchor_id", "place_id", "distance_m")
