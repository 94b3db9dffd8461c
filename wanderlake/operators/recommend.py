"""Next-destination suggestions from a visit log, and their evaluation on the first held-out visit."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hour_distance

METHODS = ("contextual", "frequency", "recency")


def suggest_destinations(visits: DataFrame, queries: DataFrame, method: str = "contextual", k: int = 3, min_visits: int = 2) -> DataFrame:
    """visits: owner_id, place_id, observed_at, origin_place_id. queries: owner_id, query_at, origin, each owner once.

    Only visits before the query count; the origin isn't suggested. One row a suggestion: owner_id, rank, place_id, score, visits.
    """
    if method not in METHODS or not 1 <= k <= 5 or min_visits < 2:
        raise ValueError("unknown method, k not in 1..5, or a minimum under 2")
    h = visits.join(queries, "owner_id").where(F.col("observed_at") < F.col("query_at"))
    total = F.count("*").over(Window.partitionBy("owner_id"))
    near = hour_distance(F.hour("observed_at"), F.hour("query_at")) <= 2
    weekday = F.weekday("observed_at") == F.weekday("query_at")
    from_origin = F.coalesce(F.col("origin_place_id") == F.col("origin"), F.lit(False))
    g = h.withColumn("total", total).where("origin is null or place_id <> origin").groupBy("owner_id", "place_id", "query_at").agg(
        F.count("*").alias("visits"), F.max("observed_at").alias("latest"), F.first("total").alias("total"),
        F.avg(near.cast("double")).alias("near"), F.avg(weekday.cast("double")).alias("weekday"), F.avg(from_origin.cast("double")).alias("from_origin"),
    ).where(F.col("visits") >= min_visits)
    days = F.timestamp_diff("SECOND", F.col("latest"), F.col("query_at")) / 86400
    # The weights of the score's parts.
    score = {
        "frequency": F.col("visits").cast("double"),
        "recency": -days,
        "contextual": 0.35 * F.col("visits") / F.col("total") + 0.20 / (1 + days / 7) + 0.20 * F.col("near") + 0.10 * F.col("weekday") + 0.15 * F.col("from_origin"),
    }[method]
    w = Window.partitionBy("owner_id").orderBy(F.desc("score"), F.desc("visits"), F.desc("latest"), "place_id")
    return g.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("owner_id", "rank", "place_id", "score", "visits")


def first_heldout(visits: DataFrame, train_fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The training visits of each owner (the first max(3, 70 %)), and the visit after them as a query with its target."""
    w = Window.partitionBy("owner_id")
    n = F.count("*").over(w)
    v = visits.withColumns({"k": F.row_number().over(w.orderBy("observed_at", "place_id")), "n": n})
    # In decimals: 0.7 of 90 is 63, but 62.99... in doubles.
    v = v.withColumn("cut", F.greatest(F.lit(3), F.floor(F.col("n") * F.lit(Decimal(str(train_fraction))))))
    target = v.where("k = cut + 1").select("owner_id", F.col("observed_at").alias("query_at"), F.col("origin_place_id").alias("origin"), F.col("place_id").alias("target"))
    return v.where("k <= cut").select(visits.columns), target


def evaluate_first_heldout(visits: DataFrame, method: str = "contextual") -> DataFrame:
    """Owners, hits at 1 and 3, owners without a suggestion, and targets never seen in training."""
    train, target = first_heldout(visits)
    s = suggest_destinations(train, target.drop("target"), method)
    best = s.join(target.select("owner_id", "target"), "owner_id").groupBy("owner_id").agg(F.min(F.when(F.col("place_id") == F.col("target"), F.col("rank"))).alias("hit"))
    seen = train.select("owner_id", F.col("place_id").alias("target")).distinct().withColumn("seen", F.lit(True))
    j = target.join(best.withColumn("any", F.lit(True)), "owner_id", "left").join(seen, ["owner_id", "target"], "left")
    return j.agg(F.count("*").alias("owners"), F.count_if(F.col("hit") == 1).alias("hit1"), F.count_if(F.col("hit") <= 3).alias("hit3"), F.count_if(F.col("any").isNull()).alias("without"), F.count_if(F.col("seen").isNull()).alias("novel"))
