"""Windows of a user's days, by calendar and by support, and the shift of moves between early and late days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _user_days(semantic: DataFrame) -> DataFrame:
    return semantic.groupBy("user_id", F.to_date("local_arrival").alias("local_date")).agg(F.count("*").alias("stays"), F.countDistinct("location_id").alias("places"))


def calendar_windows(semantic: DataFrame, width_days: int, min_days: int) -> DataFrame:
    """Windows of width_days from each user's first day, with their observed days and whether these are min_days or more."""
    first = F.min("local_date").over(Window.partitionBy("user_id"))
    d = _user_days(semantic).withColumn("window", F.floor(F.datediff("local_date", first) / width_days))
    g = d.groupBy("user_id", "window").agg(F.count("*").alias("days"), F.sum("stays").alias("stays"))
    return g.withColumn("eligible", F.col("days") >= min_days)


def support_windows(semantic: DataFrame, support_days: int, max_span_days: int) -> DataFrame:
    """Blocks of support_days observed days each (an incomplete last one is left out), with their span and whether it is short enough."""
    w = Window.partitionBy("user_id").orderBy("local_date")
    d = _user_days(semantic).withColumn("block", F.floor((F.row_number().over(w) - 1) / support_days))
    g = d.groupBy("user_id", "block").agg(F.count("*").alias("days"), F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date"), F.sum("places").alias("place_days"))
    span = F.datediff("last_date", "first_date") + 1
    return g.where(F.col("days") == support_days).drop("days").withColumns({"span_days": span, "eligible": span <= max_span_days})


def observation_dates(semantic: DataFrame) -> DataFrame:
    """First, lower median and last of the different dates of each location."""
    d = semantic.select("user_id", "location_id", F.to_date("local_arrival").alias("d")).distinct()
    w = Window.partitionBy("user_id", "location_id")
    k = d.withColumns({"k": F.row_number().over(w.orderBy("d")), "n": F.count("*").over(w)})
    middle = F.max(F.when(F.col("k") == F.floor((F.col("n") - 1) / 2) + 1, F.col("d")))
    return k.groupBy("user_id", "location_id").agg(F.min("d").alias("first_date"), middle.alias("median_date"), F.max("d").alias("last_date"), F.count("*").alias("dates"))


def edge_shift(semantic: DataFrame, min_days: int = 4) -> DataFrame:
    """How the moves (place to place within a day) of the first half of a user's dates differ from the second's: total variation, weighted Jaccard, JSD in bits."""
    day = F.to_date("local_arrival")
    w = Window.partitionBy("user_id", "local_date").orderBy("arrival", "location_id")
    s = semantic.select("user_id", "arrival", "location_id", day.alias("local_date"))
    n = F.max("k").over(Window.partitionBy("user_id"))
    s = s.withColumns({"next": F.lead("location_id").over(w), "k": F.dense_rank().over(Window.partitionBy("user_id").orderBy("local_date"))}).withColumn("n", n)
    moves = s.where((F.col("n") >= min_days) & (F.col("next") != F.col("location_id"))).withColumn("early", F.col("k") * 2 <= F.col("n"))
    e = moves.groupBy("user_id", "location_id", "next").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    total = lambda c: F.sum(c).over(Window.partitionBy("user_id"))
    e = e.withColumns({"p": F.try_divide("a", total("a")), "q": F.try_divide("b", total("b"))}).where("p is not null and q is not null")
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(F.lit(0.0)) / 2
    return e.groupBy("user_id").agg(
        F.count("*").alias("edges"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"),
        (F.sum(F.least("p", "q")) / F.sum(F.greatest("p", "q"))).alias("weighted_jaccard"), F.sum(half("p") + half("q")).alias("jsd"),
    )
