"""Independent evidence for a user's stable secondary place, against the same user's other places.

Stays carry user_id, location_id, local_arrival, local_departure and duration_s. A cohort has one row a user: user_id, home_id, secondary_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import circular_concentration

EVIDENCE = ("visit_contrast", "home_pair_share", "arrival_concentration", "dwell_regularity")


def stable_cohort(patterns: DataFrame, homes: DataFrame) -> DataFrame:
    """Users whose windows have a stable secondary place (patterns of secondary_patterns) and who have a home (user_id, home_id)."""
    stable = patterns.where("pattern = 'stable_secondary_anchor' and dominant is not null").select("user_id", F.col("dominant").alias("secondary_id"))
    return homes.select("user_id", "home_id").join(stable, "user_id")


def home_pair_days(stays: DataFrame, homes: DataFrame) -> DataFrame:
    """user_id, location_id, pair_days: local dates with a direct change between the home and the place, repeats of a place taken as one."""
    s = stays.join(homes.select("user_id", "home_id"), "user_id").withColumn("d", F.to_date("local_arrival"))
    before = F.lag("location_id").over(Window.partitionBy("user_id", "d").orderBy("local_arrival", "local_departure", "location_id"))
    moved = s.withColumn("before", before).where("before <> location_id and home_id in (before, location_id)")
    other = F.when(F.col("before") == F.col("home_id"), F.col("location_id")).otherwise(F.col("before"))
    return moved.groupBy("user_id", other.alias("location_id")).agg(F.countDistinct("d").alias("pair_days"))


def anchor_metrics(stays: DataFrame, cohort: DataFrame, min_days: int = 3, min_stays: int = 2) -> DataFrame:
    """A row for each place other than home with enough days and stays: is_secondary, active_days and the four metrics of EVIDENCE.

    Metrics are null where they have no meaning: the contrast without weekday or weekend observations, regularity without durations.
    A user's days are counted by place first, so no window holds a user's stays but those of one day.
    """
    s = stays.join(cohort, "user_id").withColumn("d", F.to_date("local_arrival"))
    work = F.when(F.weekday("d") < 5, F.col("d"))
    rest = F.when(F.weekday("d") >= 5, F.col("d"))
    seen = s.groupBy("user_id").agg(F.countDistinct(work).alias("all_work"), F.countDistinct(rest).alias("all_rest"))
    dwell = F.percentile(F.when(F.col("duration_s") >= 0, F.col("duration_s") / 3600), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    clock = F.hour("local_arrival") + F.minute("local_arrival") / 60
    # Distinct dates come from a set a group, so that they and the percentiles share one shuffle.
    days = F.collect_set("d")
    place = s.where("location_id <> home_id").groupBy("user_id", "location_id", "secondary_id").agg(
        F.count("*").alias("stays"), days.alias("days"), dwell.alias("q"), circular_concentration(clock).alias("arrival_concentration")
    )
    place = place.withColumns({"active_days": F.size("days").cast("long"), "work": F.size(F.filter("days", lambda d: F.weekday(d) < 5)), "q25": F.col("q")[0], "q50": F.col("q")[1], "q75": F.col("q")[2]})
    place = place.where((F.col("active_days") >= min_days) & (F.col("stays") >= min_stays))
    j = place.join(seen, "user_id").join(home_pair_days(stays, cohort), ["user_id", "location_id"], "left")
    return j.select(
        "user_id", "location_id", (F.col("location_id") == F.col("secondary_id")).alias("is_secondary"), "active_days",
        (F.try_divide(F.col("work"), F.col("all_work")) - F.try_divide(F.col("active_days") - F.col("work"), F.col("all_rest"))).alias("visit_contrast"),
        (F.coalesce("pair_days", F.lit(0)) / F.col("active_days")).alias("home_pair_share"), "arrival_concentration",
        F.when(F.col("q50") <= 0, 0.0).otherwise(1 / (1 + (F.col("q75") - F.col("q25")) / F.col("q50"))).alias("dwell_regularity"),
    )


def rank_within_user(metrics: DataFrame, evidence: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """A row for each user and metric: the secondary place's value against the user's other places.

    Only users with one secondary place and at least one other. Without a value, or without any among the others, the rest is null and the tests are false.
    """
    long = metrics.unpivot(["user_id", "location_id", "is_secondary"], list(evidence), "metric", "value")
    own = lambda c: F.max(F.when(F.col("is_secondary"), F.col(c)))
    peer = F.when(~F.col("is_secondary"), F.col("value"))
    g = long.groupBy("user_id", "metric").agg(
        F.count_if("is_secondary").alias("candidates"), (F.count("*") - 1).alias("peers"), own("location_id").alias("secondary_id"), own("value").alias("value"),
        F.max("value").alias("most"), F.count(peer).alias("n"), F.percentile(peer, 0.5).alias("peer_median"), F.collect_list("value").alias("all"),
    ).where("candidates = 1 and peers >= 1")
    valid = F.col("value").isNotNull() & (F.col("n") > 0)
    return g.select(
        "user_id", "secondary_id", "peers", "metric", "value", valid.alias("valid"),
        F.when(valid, F.size(F.filter("all", lambda v: v <= F.col("value"))) / F.size("all")).alias("percentile"),
        (valid & (F.col("value") >= F.col("most") - 1e-12)).alias("top1"), F.when(valid, F.col("peer_median")).alias("peer_median"),
        F.when(valid, F.col("value") - F.col("peer_median")).alias("difference"), F.coalesce(valid & (F.col("value") > F.col("peer_median")), F.lit(False)).alias("beats"),
    ).withColumn("top1", F.coalesce("top1", F.lit(False)))


def compare_metrics(ranks: DataFrame) -> DataFrame:
    """Per metric: users compared, how often the secondary place is first or above the median of its peers, and medians."""
    return ranks.groupBy("metric").agg(
        F.count_if("valid").alias("users"), F.count_if("top1").alias("top1_users"), F.count_if("beats").alias("beats_users"),
        F.percentile("percentile", 0.5).alias("median_percentile"), F.percentile("difference", 0.5).alias("median_difference"),
    )


def convergence(ranks: DataFrame) -> DataFrame:
    """Users by how many metrics count, put the secondary place first, and put it above its peers' median."""
    axes = ranks.groupBy("user_id").agg(*[F.count_if(c).alias(f"{c}_axes") for c in ("valid", "top1", "beats")])
    return axes.groupBy("valid_axes", "top1_axes", "beats_axes").agg(F.count("*").alias("users"))
