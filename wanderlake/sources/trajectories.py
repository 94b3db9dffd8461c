"""Reading location histories: trajectory text files, transport-mode labels, and points derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER_LINES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory files with six header lines and rows lat,lon,0,altitude,days,date,time; the user is the folder two levels up.

    Header lines are told by having no seven fields, so files may be split over tasks.
    """
    return trajectory_rows(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def trajectory_rows(lines: DataFrame) -> DataFrame:
    """user_id, trajectory_id, ts, lat, lon of lines (value, file) of trajectory files."""
    p = F.split("value", ",")
    rows = lines.where(F.size(p) == 7)
    steps = F.split("file", "/")
    return rows.select(
        F.element_at(steps, -3).alias("user_id"), F.element_at(steps, -1).alias("trajectory_id"),
        F.try_to_timestamp(F.concat(p[5], F.lit(" "), p[6]), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        p[0].try_cast("double").alias("lat"), p[1].try_cast("double").alias("lon"),
    )


def read_mode_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files: a title line, then start date, start time, end date, end time and mode between white space."""
    p = F.split(F.trim("value"), "\\s+")
    steps = F.split(F.col("_metadata.file_path"), "/")
    at = lambda i: F.try_to_timestamp(F.concat(p[i], F.lit(" "), p[i + 1]), F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz")
    rows = spark.read.text(path).select(F.element_at(steps, -2).alias("user_id"), at(0).alias("start_time"), at(2).alias("end_time"), F.get(p, F.lit(4)).alias("mode"))
    return rows.where("start_time is not null and end_time > start_time")


def visits(events: DataFrame) -> DataFrame:
    """Events that begin a visit (two hours or more after the user's last), with a place and its coordinates."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    kept = events.withColumn("gap", gap).where("gap is null or gap >= 7200")
    local = F.col("ts") + F.expr("interval 8 hours")
    place = (
        F.when(F.col("user_id") % 3 == 0, F.col("event_id") % 4)
        .when(F.col("event_id") % 5 == 0, 2 + F.col("event_id") % 3)
        .when((F.hour(local) >= 21) | (F.hour(local) < 6), F.lit(0))
        .when((F.weekday(local) < 5) & F.hour(local).between(9, 17), F.lit(1))
        .otherwise(2 + F.col("event_id") % 3)
    )
    v = kept.withColumn("place", place.cast("long"))
    lat = 39.90 + 0.01 * (F.col("user_id") % 50) + 0.005 * F.col("place") + 0.00005 * (F.col("event_id") % 3 - 1)
    return v.select("user_id", "event_id", "event_type", "ts", "place", lat.alias("lat"), (116.40 + 0.004 * F.col("place")).alias("lon"))


def points(events: DataFrame, defects: bool = False) -> DataFrame:
    """Six points a visit, five minutes apart. defects adds bad coordinates, a second place in one second, and jumps."""
    v = visits(events)
    p = v.select("user_id", "event_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), "ts", "lat", "lon")
    p = p.select("user_id", "event_id", (F.col("ts") + F.make_dt_interval(mins=F.col("k") * 5)).alias("ts"), "lat", "lon", "k")
    if not defects:
        return p.select("user_id", "event_id", "ts", "lat", "lon")
    hit = lambda n, k: (F.col("event_id") % n == 0) & (F.col("k") == k)
    row = lambda ts, lat: F.struct(ts.alias("ts"), lat.alias("lat"), F.col("lon").alias("lon"))
    variants = F.array(
        row(F.col("ts"), F.when(hit(97, 2), F.lit(200.0)).otherwise(F.col("lat"))),
        F.when(hit(89, 3), row(F.col("ts"), F.col("lat") + 0.02)),
        F.when(hit(83, 1), row(F.col("ts") + F.expr("interval 60 seconds"), F.col("lat") + 1.0)),
    )
    return p.select("user_id", "event_id", F.inline(F.array_compact(variants)))
