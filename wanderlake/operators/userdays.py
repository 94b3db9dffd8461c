"""Days of users: movement of cleaned points, dwell of stays, support gates, and the features that stand on usable days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.stats import entropy_term

#: The support gates of a day.
MIN_POINTS, MIN_SPAN_H, MAX_GAP_H, MIN_STAY_SPAN_H = 3, 2.0, 6.0, 2.0


def point_days(cleaned: DataFrame, zone: str) -> DataFrame:
    """A row a user and local day of cleaned points. Distances and movement never cross a sequence; gaps do."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
    p = cleaned.withColumns({"local_date": F.to_date(local), "hour": F.hour(local)})
    w = Window.partitionBy("user_id", "local_date").orderBy("ts")
    before = F.lag(F.struct("ts", "lat", "lon", "sequence_id")).over(w)
    p = p.withColumn("b", before)
    gap = F.timestamp_diff("MICROSECOND", F.col("b.ts"), F.col("ts")) / 1e6
    same = (F.col("b.sequence_id") == F.col("sequence_id")) & (gap > 0)
    step = haversine_m(F.col("b.lat"), F.col("b.lon"), F.col("lat"), F.col("lon"))
    g = p.withColumns({"gap": gap, "moved_s": F.when(same, gap), "moved_m": F.when(same, step)}).groupBy("user_id", "local_date").agg(
        F.count("*").alias("point_count"), (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 3.6e9).alias("observed_span_h"),
        F.coalesce(F.max("gap") / 3600, F.lit(0.0)).alias("largest_gap_h"), F.coalesce(F.sum("moved_m") / 1000, F.lit(0.0)).alias("distance_km"),
        F.coalesce(F.sum("moved_s") / 3600, F.lit(0.0)).alias("moved_h"), F.count("boundary_before_reason").alias("boundary_count"),
        F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.countDistinct("hour").alias("hours"),
    )
    return g.withColumn("moved_h", F.least("moved_h", "observed_span_h"))


def day_quality(days: DataFrame) -> DataFrame:
    """days with usable_for_profile and usable_for_motif; what is missing fails the gate."""
    profile = (F.col("point_count") >= MIN_POINTS) & (F.col("observed_span_h") >= MIN_SPAN_H) & (F.col("largest_gap_h") <= MAX_GAP_H)
    motif = (F.col("stay_count") >= 1) & (F.col("stay_span_h") >= MIN_STAY_SPAN_H)
    return days.withColumns({"usable_for_profile": F.coalesce(profile, F.lit(False)), "usable_for_motif": F.coalesce(motif, F.lit(False))})


def user_days(points: DataFrame, semantic: DataFrame, hourly: DataFrame) -> DataFrame:
    """point_days and days of stays side by side (full outer), with 24 sums of dwell, their support and the weekday (0 is Monday)."""
    by = ["user_id", "local_date"]
    hour = lambda h: F.sum(F.when(F.col("hour") == h, F.col("dwell_s")).otherwise(0.0))
    dwell = hourly.groupBy(*by).agg(F.countDistinct("location_id").alias("places"), (F.sum("dwell_s") / 3600).alias("dwell_h"), F.array(*[hour(h) for h in range(24)]).alias("hourly_dwell"))
    # Every day that a stay touches has its span from the first arrival to the last departure of these stays.
    touched = semantic.select("user_id", "arrival", "departure", "local_departure", F.explode(F.sequence(F.to_date("local_arrival"), F.to_date("local_departure"))).alias("local_date"), F.to_date("local_arrival").alias("own"))
    touched = touched.where(F.col("local_date").cast("timestamp_ntz") < F.col("local_departure"))
    stays = touched.groupBy(*by).agg(F.count_if(F.col("own") == F.col("local_date")).alias("stay_count"), (F.timestamp_diff("MICROSECOND", F.min("arrival"), F.max("departure")) / 3.6e9).alias("stay_span_h"))
    whole = points.join(dwell.join(stays, by), by, "full").withColumn("hourly_dwell", F.coalesce("hourly_dwell", F.array_repeat(F.lit(0.0), 24)))
    whole = whole.fillna({"stay_count": 0, "places": 0, "dwell_h": 0.0, "stay_span_h": 0.0}).withColumn("weekday", F.weekday("local_date"))
    return day_quality(whole)


def behaviour_features(days: DataFrame, semantic: DataFrame, motifs: DataFrame) -> DataFrame:
    """A row a user: support, concentration of places and hours, weekday shares, motifs of usable days, movement of usable days.

    days: user_days. motifs: user_id, local_date, motif; only days that are usable for motifs count. Ties of motifs go to the least one.
    """
    usable = F.col("usable_for_profile")
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    weekday_h = F.sum(F.when(F.col("weekday") < 5, F.col("dwell_h")).otherwise(0.0))
    per_usable = lambda c: share(F.sum(F.when(usable, F.col(c))), F.count_if(usable))
    support = days.groupBy("user_id").agg(
        F.count("*").alias("active_days"), F.count_if(usable).alias("usable_days"), F.count_if("usable_for_motif").alias("motif_days"),
        share(weekday_h, F.sum("dwell_h")).alias("weekday_dwell_share"), share(F.sum("dwell_h") - weekday_h, F.sum("dwell_h")).alias("weekend_dwell_share"),
        per_usable("distance_km").alias("distance_per_day_km"), per_usable("moved_h").alias("moved_per_day_h"), per_usable("boundary_count").alias("boundaries_per_day"),
    )
    hours = days.select("user_id", F.posexplode("hourly_dwell").alias("hour", "s")).groupBy("user_id", "hour").agg(F.sum("s").alias("s"))
    p = F.col("s") / F.sum("s").over(Window.partitionBy("user_id"))
    concentration = hours.where("s > 0").withColumn("p", p).groupBy("user_id").agg(F.sum(entropy_term(F.col("p"))).alias("hour_entropy"), F.max("p").alias("hour_concentration"))
    places = semantic.groupBy("user_id", "location_id").agg(F.sum("duration_s").alias("d"), F.count("*").alias("n"))
    ranked = places.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("d"), "location_id")))
    upto = lambda k: (F.sum(F.when(F.col("r") <= k, F.col("d")).otherwise(0.0)) / F.sum("d")).alias(f"top_{k}_share")
    place = ranked.groupBy("user_id").agg(F.sum("n").alias("stays"), F.count("*").alias("places"), F.count_if(F.col("n") >= 2).alias("recurring_places"), upto(1), upto(2), upto(3))
    kept = motifs.join(days.where("usable_for_motif").select("user_id", "local_date"), ["user_id", "local_date"], "left_semi").withColumn("late", F.weekday("local_date") >= 5)
    counts = kept.groupBy("user_id", "motif").agg(F.count("*").alias("n"), F.count_if(~F.col("late")).alias("n_week"), F.count_if("late").alias("n_end"))
    counts = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    motif = counts.groupBy("user_id").agg(
        F.max("p").alias("motif_frequency"),
        F.sum(entropy_term(F.col("p"))).alias("motif_entropy"), share(F.max("n_week"), F.sum("n_week")).alias("weekday_motif_share"), share(F.max("n_end"), F.sum("n_end")).alias("weekend_motif_share"),
    )
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "motif"))).where("r = 1").select("user_id", F.col("motif").alias("top_motif"))
    out = support.join(concentration, "user_id", "left").join(place, "user_id", "left").join(motif, "user_id", "left").join(first, "user_id", "left")
    zero = [c for c in out.columns if c not in ("user_id", "top_motif")]
    return out.fillna(0, zero)


def stability(days: DataFrame, jsd: callable) -> DataFrame:
    """Divergence between the early and late usable days of a user, with the support that it needs, and the median over all pairs of weeks."""
    w = Window.partitionBy("user_id")
    d = days.where("usable_for_profile").withColumns({"k": F.row_number().over(w.orderBy("local_date")), "n": F.count("*").over(w), "week": F.date_trunc("week", F.col("local_date"))})
    d = d.withColumn("late", F.col("k") > F.floor(F.col("n") / 2))
    profile = lambda cond: F.array(*[F.sum(F.when(cond, F.col("hourly_dwell")[h]).otherwise(0.0)) for h in range(24)])
    part = lambda c, late: F.coalesce(F.sum(F.when(F.col("late") == late, F.col(c))), F.lit(0.0))
    g = d.groupBy("user_id").agg(
        F.countDistinct("week").alias("weeks"), F.count_if(~F.col("late")).alias("early_days"), F.count_if("late").alias("late_days"),
        part("dwell_h", False).alias("early_h"), part("dwell_h", True).alias("late_h"), profile(~F.col("late")).alias("p"), profile(F.col("late")).alias("q"),
    )
    eligible: Column = (F.col("weeks") >= 2) & (F.col("early_days") >= 3) & (F.col("late_days") >= 3) & (F.col("early_h") >= 6) & (F.col("late_h") >= 6)
    weekly = d.groupBy("user_id", "week").agg(profile(F.lit(True)).alias("v"))
    a, b = weekly.alias("a"), weekly.alias("b")
    # A user has at most a few hundred weeks; pairs are of one user's weeks.
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.week") < F.col("b.week"))).select(F.col("a.user_id").alias("user_id"), jsd(F.col("a.v"), F.col("b.v")).alias("jsd"))
    median = pairs.groupBy("user_id").agg(F.median("jsd").alias("weekly_jsd_median"))
    out = g.withColumn("eligible", eligible).join(median, "user_id", "left")
    return out.select("user_id", "eligible", F.when(F.col("eligible"), jsd(F.col("p"), F.col("q"))).alias("early_late_jsd"), F.when(F.col("eligible"), F.col("weekly_jsd_median")).alias("weekly_jsd_median"), "weeks", "early_days", "late_days")
