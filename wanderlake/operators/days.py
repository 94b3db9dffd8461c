"""Behaviour of days and users: dwell by hour, motifs, transitions, concentration and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import circular_concentration, circular_mean_hour, entropy_term


def hourly_dwell(semantic: DataFrame) -> DataFrame:
    """user_id, location_id, local_date, hour, dwell_s: stays cut at every full hour of the instant, then put on the local clock."""
    hours = F.sequence(F.date_trunc("hour", F.col("arrival")).cast("timestamp_ntz"), F.col("departure"), F.expr("interval 1 hour"))
    h = semantic.select("user_id", "location_id", "arrival", "departure", "timezone_id", F.explode(hours).alias("h"))
    s = F.timestamp_diff("MICROSECOND", F.greatest("arrival", "h"), F.least("departure", F.col("h") + F.expr("interval 1 hour"))) / 1e6
    h = h.withColumn("s", s).where("s > 0").withColumn("local", F.convert_timezone(F.lit("UTC"), F.col("timezone_id"), F.greatest("arrival", "h")))
    return h.groupBy("user_id", "location_id", F.to_date("local").alias("local_date"), F.hour("local").alias("hour")).agg(F.sum("s").alias("dwell_s"))


def daily_motifs(semantic: DataFrame, *more: str) -> DataFrame:
    """The places of each user-day (and of each value of more keys) in order, repeats in a row once. A user-day's stays meet in one group."""
    by = [*more, "user_id", "local_date"]
    w = Window.partitionBy(*by).orderBy("arrival", "location_id")
    d = semantic.withColumn("local_date", F.to_date("local_arrival")).withColumn("before", F.lag("location_id").over(w))
    d = d.where("before is null or before <> location_id")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("arrival", "location_id"))), lambda x: x["location_id"].cast("string"))
    return d.groupBy(*by).agg(F.array_join(steps, ">").alias("motif"))


def transitions(semantic: DataFrame) -> DataFrame:
    """Directed moves between places within a local day: count, different days, and whether on two days or more."""
    w = Window.partitionBy("user_id", "local_date").orderBy("arrival", "location_id")
    d = semantic.withColumn("local_date", F.to_date("local_arrival")).withColumn("next", F.lead("location_id").over(w))
    e = d.where("next is not null and next <> location_id")
    g = e.groupBy("user_id", F.col("location_id").alias("origin"), F.col("next").alias("destination")).agg(F.count("*").alias("moves"), F.countDistinct("local_date").alias("days"))
    return g.withColumn("recurrent", F.col("days") >= 2)


def entropy_of(df: DataFrame, by: str, weight: str) -> DataFrame:
    """Entropy in bits of the weights of each group."""
    total = F.sum(weight).over(Window.partitionBy(by))
    return df.withColumn("p", F.col(weight) / total).groupBy(by).agg(F.sum(entropy_term(F.col("p"))).alias("entropy"))


def user_features(semantic: DataFrame, hourly: DataFrame) -> DataFrame:
    """Shares of the top three places, hour entropy, circular mean hour of arrivals and weekend share."""
    place = semantic.groupBy("user_id", "location_id").agg(F.sum("duration_s").alias("d"))
    w = Window.partitionBy("user_id").orderBy(F.desc("d"), "location_id")
    top = place.withColumn("r", F.row_number().over(w)).groupBy("user_id").agg(*[(F.sum(F.when(F.col("r") == k, F.col("d")).otherwise(0.0)) / F.sum("d")).alias(f"top{k}_share") for k in (1, 2, 3)])
    clock = F.hour("local_arrival") + F.minute("local_arrival") / 60
    per_user = semantic.groupBy("user_id").agg(
        F.count("*").alias("stays"), circular_mean_hour(clock).alias("mean_hour"), circular_concentration(clock).alias("concentration"),
        F.avg((F.weekday("local_arrival") >= 5).cast("double")).alias("weekend_share"),
    )
    hours = entropy_of(hourly.groupBy("user_id", "hour").agg(F.sum("dwell_s").alias("s")), "user_id", "s")
    return per_user.join(top, "user_id").join(hours.withColumnRenamed("entropy", "hour_entropy"), "user_id")


def schedule_stability(hourly: DataFrame) -> DataFrame:
    """Divergence between the hour profiles of the first and second half of a user's dates (four dates or more)."""
    dates = hourly.select("user_id", "local_date").distinct()
    w = Window.partitionBy("user_id")
    half = dates.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("local_date"))}).where("n >= 4").withColumn("late", F.col("k") * 2 > F.col("n"))
    tagged = hourly.join(half.select("user_id", "local_date", "late"), ["user_id", "local_date"])
    seconds = lambda late: F.sum(F.when(F.col("late") == late, F.col("dwell_s")).otherwise(0.0))
    p = tagged.groupBy("user_id", "hour").agg(seconds(False).alias("a"), seconds(True).alias("b"))
    share = lambda c: F.try_divide(c, F.sum(c).over(w))
    p = p.withColumns({"p": share("a"), "q": share("b")})
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(F.lit(0.0)) / 2
    return p.groupBy("user_id").agg(F.when(F.count("p") * F.count("q") > 0, F.sum(part("p") + part("q"))).alias("jsd"))
