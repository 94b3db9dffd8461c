"""Monthly homes from geohashes: cells of six letters, then of seven within the chosen one, by days, hours and nights of a month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import geohash, geohash_center

#: Least days, least share of the month's days, least hours a day, and how many cells go on to the choice by nights.
LEAST_DAYS, LEAST_SHARE, LEAST_HOURS, FINALISTS = 3, 0.5, 2.0, 3
NIGHT_FROM, NIGHT_TO = 21, 6
MONTH = ["user_id", "year_month"]


def cell_stats(obs: DataFrame, code: str) -> DataFrame:
    """user_id, year_month, code and what was seen there: days, hours a day, sightings an hour, nights, hours a night and sightings a night hour."""
    hours = obs.groupBy(*MONTH, code, "at").agg(F.count("*").alias("n"))
    night = (F.hour("at") >= NIGHT_FROM) | (F.hour("at") < NIGHT_TO)
    date = F.to_date("at")
    of = F.when(night, F.when(F.hour("at") < NIGHT_TO, F.date_sub(date, 1)).otherwise(date))
    h = hours.withColumns({"date": date, "night_of": of})
    g = h.groupBy(*MONTH, code).agg(
        F.count_distinct("date").alias("observed_days"), F.count("*").alias("_hours"), F.sum("n").alias("_seen"), F.count_distinct("night_of").alias("nights"), F.count("night_of").alias("night_hours"), F.coalesce(F.sum(F.when(F.col("night_of").isNotNull(), F.col("n"))), F.lit(0)).alias("_night_seen"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.select(*MONTH, code, "observed_days", rate("_hours", "observed_days").alias("hours_a_day"), rate("_seen", "_hours").alias("seen_an_hour"), "nights", "night_hours", rate("night_hours", "nights").alias("hours_a_night"), rate("_night_seen", "night_hours").alias("seen_a_night_hour"))


def chosen_cell(obs: DataFrame, code: str) -> DataFrame:
    """The cell of each user and month, if any holds enough days and hours: of the best three by days and hours the best by nights."""
    days = obs.groupBy(*MONTH).agg(F.count_distinct(F.to_date("at")).alias("_days"))
    ok = cell_stats(obs, code).join(days, MONTH).where((F.col("observed_days") >= LEAST_DAYS) & (F.col("observed_days") > F.col("_days") * LEAST_SHARE) & (F.col("hours_a_day") >= LEAST_HOURS))
    w = Window.partitionBy(*MONTH)
    by_days = w.orderBy(F.desc("observed_days"), F.desc("hours_a_day"), F.desc("seen_an_hour"), code)
    by_nights = w.orderBy(F.desc("nights"), F.desc("hours_a_night"), F.desc("seen_a_night_hour"), code)
    final = ok.withColumn("_k", F.row_number().over(by_days)).where(F.col("_k") <= FINALISTS)
    return final.withColumn("_k", F.row_number().over(by_nights)).where("_k = 1").select(*MONTH, code, "nights", "night_hours")


def monthly_homes(hours: DataFrame) -> DataFrame:
    """A row a user and month that has a home: geohash6, geohash7, its centre, days seen in the month, nights and night hours. hours: user_id, at (a local hour), lat, lon."""
    obs = hours.select("user_id", "at", F.date_format("at", "yyyy-MM").alias("year_month"), geohash(F.col("lat"), F.col("lon"), 7).alias("geohash7")).withColumn("geohash6", F.substring("geohash7", 1, 6))
    six = chosen_cell(obs, "geohash6").select(*MONTH, "geohash6")
    seven = chosen_cell(obs.join(six, [*MONTH, "geohash6"]), "geohash7")
    days = obs.groupBy(*MONTH).agg(F.count_distinct(F.to_date("at")).alias("observed_days"))
    lat, lon = geohash_center(F.col("geohash7"), 7)
    return seven.join(days, MONTH).select(*MONTH, F.substring("geohash7", 1, 6).alias("geohash6"), "geohash7", lat.alias("lat"), lon.alias("lon"), "observed_days", F.col("nights").alias("home_nights"), F.col("night_hours").alias("home_night_hours"))


def homes_over_months(monthly: DataFrame) -> DataFrame:
    """A row a user: the cell that is home in most months (then by night hours, then by name), its centre, the months with a home and this cell's share of them."""
    g = monthly.groupBy("user_id", "geohash7").agg(F.count_distinct("year_month").alias("months"), F.sum("home_night_hours").alias("hours"))
    w = Window.partitionBy("user_id")
    total = monthly.groupBy("user_id").agg(F.count_distinct("year_month").alias("qualifying_months"))
    best = g.withColumn("_k", F.row_number().over(w.orderBy(F.desc("months"), F.desc("hours"), "geohash7"))).where("_k = 1").join(total, "user_id")
    lat, lon = geohash_center(F.col("geohash7"), 7)
    return best.select("user_id", "geohash7", lat.alias("lat"), lon.alias("lon"), "qualifying_months", (F.col("months") / F.col("qualifying_months")).alias("modal_month_share"))
