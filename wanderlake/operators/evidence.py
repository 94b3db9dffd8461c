"""Evidence for HOME and OFFICE from overlaps with local-time windows, ranked candidates, gates and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowRule:
    """A daily window in local hours (over midnight if the end isn't later) with its gates."""

    label: str
    start_hour: int
    end_hour: int
    weekdays: tuple[int, ...]
    min_dates: int
    min_share: float
    min_margin: float


HOME = WindowRule("HOME", 21, 6, tuple(range(7)), 3, 0.50, 0.20)
OFFICE = WindowRule("OFFICE", 9, 17, (0, 1, 2, 3, 4), 3, 0.30, 0.10)
RULES = (HOME, OFFICE)
MIN_DATE_OVERLAP_S, SATURATION_DATES, MIN_STAYS = 600.0, 5, 2


def overlap_s(rule: WindowRule, day: str) -> Column:
    """Seconds of a stay within the rule's window of the date in column day; not positive where they don't meet."""
    at = lambda hour: F.convert_timezone(F.col("timezone_id"), F.lit("UTC"), F.col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour)))
    end_hour = rule.end_hour if rule.end_hour > rule.start_hour else rule.end_hour + 24
    return F.timestamp_diff("MICROSECOND", F.greatest("arrival", at(rule.start_hour)), F.least("departure", at(end_hour))) / 1e6


def contributions(semantic: DataFrame, rule: WindowRule) -> DataFrame:
    """user_id, location_id, behavior_date, overlap_s > 0, for each day from the one before the arrival to the departure.

    The windows' ends are local times of the stay's zone, compared as instants, so a shifted clock counts as it ran.
    """
    days = F.sequence(F.date_sub(F.to_date("local_arrival"), 1), F.to_date("local_departure"))
    d = semantic.select("user_id", "location_id", "arrival", "departure", "timezone_id", F.explode(days).alias("behavior_date"))
    d = d.where(F.weekday("behavior_date").isin(*rule.weekdays))
    return d.withColumn("overlap_s", overlap_s(rule, "behavior_date")).where("overlap_s > 0").select("user_id", "location_id", "behavior_date", "overlap_s")


def window_features(semantic: DataFrame, locations: DataFrame, rule: WindowRule) -> DataFrame:
    """Every location with dwell_s, dates (600 s or more) and share of its user's dwell (0 if there is none)."""
    by_date = contributions(semantic, rule).groupBy("user_id", "location_id", "behavior_date").agg(F.sum("overlap_s").alias("s"))
    by_place = by_date.groupBy("user_id", "location_id").agg(F.sum("s").alias("dwell_s"), F.count_if(F.col("s") >= MIN_DATE_OVERLAP_S).alias("dates"))
    f = locations.join(by_place, ["user_id", "location_id"], "left").fillna({"dwell_s": 0.0, "dates": 0})
    total = F.sum("dwell_s").over(Window.partitionBy("user_id"))
    return f.withColumn("share", F.when(total > 0, F.col("dwell_s") / total).otherwise(F.lit(0.0))).withColumn("label", F.lit(rule.label))


def _ranked(features: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("share"), F.desc("dates"), F.desc("dwell_s"), F.desc("stay_count"), "location_id")
    return features.withColumns({"rank": F.row_number().over(w), "next_share": F.lead("share").over(w)}).where("rank = 1").drop("rank")


def top_candidate(features: DataFrame, rule: WindowRule) -> DataFrame:
    """The best eligible location of each user, and its margin over the next (which counts as 0 where there is none)."""
    ok = features.where((F.col("stay_count") >= MIN_STAYS) & (F.col("dates") >= rule.min_dates) & (F.col("dwell_s") > 0))
    return _ranked(ok).withColumn("margin", F.col("share") - F.coalesce("next_share", F.lit(0.0))).drop("next_share")


def emit(top: DataFrame, rule: WindowRule) -> DataFrame:
    strength = (F.col("share") + F.col("margin") + F.least(F.col("dates") / SATURATION_DATES, F.lit(1.0))) / 3
    return top.where((F.col("share") >= rule.min_share) & (F.col("margin") >= rule.min_margin)).withColumn("strength", strength)


def infer_home_office(semantic: DataFrame, locations: DataFrame) -> DataFrame:
    """user_id, label, location_id, share, margin, dates, strength; the labels are independent of each other."""
    out = None
    for rule in RULES:
        rows = emit(top_candidate(window_features(semantic, locations, rule), rule), rule).select("user_id", "label", "location_id", "share", "margin", "dates", "strength")
        out = rows if out is None else out.unionByName(rows)
    return out


def gate_status(semantic: DataFrame, locations: DataFrame, rule: WindowRule) -> DataFrame:
    """For each user, the first gate that the label fails, or emitted."""
    f = window_features(semantic, locations, rule)
    top = top_candidate(f, rule).select("user_id", "share", "margin")
    per_user = f.groupBy("user_id").agg(F.max((F.col("stay_count") >= MIN_STAYS).cast("int")).alias("recurs"), F.max(F.when(F.col("stay_count") >= MIN_STAYS, F.col("dates"))).alias("most_dates"), F.sum("dwell_s").alias("dwell_s"))
    joined = per_user.join(top, "user_id", "left")
    status: Column = (
        F.when(F.col("recurs") == 0, "no_recurring_location").when(F.col("dwell_s") <= 0, "no_window_dwell").when(F.col("most_dates") < rule.min_dates, "too_few_dates")
        .when(F.col("share").isNull(), "no_candidate").when(F.col("share") < rule.min_share, "low_share").when(F.col("margin") < rule.min_margin, "low_margin").otherwise("emitted")
    )
    return joined.select("user_id", F.lit(rule.label).alias("label"), status.alias("status"))


#: The outcomes of the audit, in the order in which they are tried.
OUTCOMES = (
    "no_cp1_stay", "outside_frozen_v1_geographic_scope", "no_recurring_location", "no_behavioral_window_overlap", "insufficient_relevant_dates",
    "share_below_frozen_gate", "margin_below_frozen_gate", "emitted",
)


def raw_top(features: DataFrame) -> DataFrame:
    """The best recurring location of each user with any dwell in the window, whatever its dates, and its margin."""
    return _ranked(features.where((F.col("stay_count") >= MIN_STAYS) & (F.col("dwell_s") > 0))).withColumn("margin", F.col("share") - F.coalesce("next_share", F.lit(0.0))).drop("next_share")


def opportunities(semantic: DataFrame, rule: WindowRule) -> DataFrame:
    """For each user seen in the window: dates with enough overlap at any place, and hours of overlap."""
    by_date = contributions(semantic, rule).groupBy("user_id", "behavior_date").agg(F.sum("overlap_s").alias("s"))
    return by_date.groupBy("user_id").agg(F.count_if(F.col("s") >= MIN_DATE_OVERLAP_S).alias("opportunity_dates"), (F.sum("s") / 3600).alias("opportunity_hours"))


def label_audit(universe: DataFrame, stays: DataFrame, semantic: DataFrame, locations: DataFrame, rule: WindowRule) -> DataFrame:
    """One outcome for each user of the universe (user_id), with the candidate that it is about."""
    f = window_features(semantic, locations, rule)
    seen = stays.groupBy("user_id").agg(F.lit(True).alias("has_stay"))
    located = locations.groupBy("user_id").agg(F.max((F.col("stay_count") >= MIN_STAYS).cast("int")).alias("recurs"))
    top = top_candidate(f, rule).select("user_id", "location_id", "share", "margin", "dates", (F.col("dwell_s") / 3600).alias("dwell_h"))
    any_overlap = raw_top(f).select("user_id", F.lit(True).alias("overlaps"))
    j = universe.join(seen, "user_id", "left").join(located, "user_id", "left").join(any_overlap, "user_id", "left").join(top, "user_id", "left")
    tests = (
        F.col("has_stay").isNull(), F.col("recurs").isNull(), F.col("recurs") == 0, F.col("overlaps").isNull(), F.col("share").isNull(),
        F.col("share") < rule.min_share, F.col("margin") < rule.min_margin,
    )
    outcome = F.lit(OUTCOMES[-1])
    for test, name in reversed(list(zip(tests, OUTCOMES, strict=False))):
        outcome = F.when(test, name).otherwise(outcome)
    return j.select("user_id", F.lit(rule.label).alias("label"), outcome.alias("outcome"), "location_id", "share", "margin", "dates", "dwell_h")


def gate_diagnostics(semantic: DataFrame, locations: DataFrame, rule: WindowRule) -> DataFrame:
    """For each located user: window opportunity, the best candidate with and without the dates gate, how much of the opportunity they cover, and a seven-way status."""
    f = window_features(semantic, locations, rule)
    users = locations.groupBy("user_id").agg(F.sum("stay_count").alias("stays"), F.count_if(F.col("stay_count") >= MIN_STAYS).alias("recurring"))
    raw = raw_top(f).select("user_id", F.col("location_id").alias("raw_location"), F.col("share").alias("raw_share"), F.col("margin").alias("raw_margin"), F.col("dates").alias("raw_dates"))
    top = top_candidate(f, rule).select("user_id", "location_id", "share", "margin", "dates")
    j = users.join(opportunities(semantic, rule), "user_id", "left").join(raw, "user_id", "left").join(top, "user_id", "left").fillna({"opportunity_dates": 0, "opportunity_hours": 0.0})
    low, near = F.col("share") < rule.min_share, F.col("margin") < rule.min_margin
    status = (
        F.when(F.col("opportunity_dates") <= 0, "no_observed_opportunity").when(F.col("raw_location").isNull(), "no_recurring_candidate").when(F.col("location_id").isNull(), "min_dates_blocked")
        .when(low & near, "share_and_margin_blocked").when(low, "share_blocked").when(near, "margin_blocked").otherwise("emitted")
    )
    coverage = lambda c: F.when(F.col("opportunity_dates") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("opportunity_dates"))
    return j.withColumns({"label": F.lit(rule.label), "raw_coverage": coverage("raw_dates"), "coverage": coverage("dates"), "status": status})


def emission_grid(features: DataFrame, dates: tuple[int, ...], shares: tuple[float, ...], margins: tuple[float, ...]) -> DataFrame:
    """Users that each combination of gates lets through, of all users. The ranking is made anew for each dates gate; one pass for the whole grid."""
    from .relational import with_grid

    able = with_grid(features.where((F.col("stay_count") >= MIN_STAYS) & (F.col("dwell_s") > 0)), min_dates=dates).where(F.col("dates") >= F.col("min_dates"))
    w = Window.partitionBy("user_id", "min_dates").orderBy(F.desc("share"), F.desc("dates"), F.desc("dwell_s"), F.desc("stay_count"), "location_id")
    top = able.withColumns({"r": F.row_number().over(w), "margin": F.col("share") - F.coalesce(F.lead("share").over(w), F.lit(0.0))}).where("r = 1")
    # Rates over a grid of literals, so nothing is lost where no user passes.
    passed = with_grid(top.select("min_dates", "share", "margin"), min_share=shares, min_margin=margins)
    n = F.count_if((F.col("share") >= F.col("min_share")) & (F.col("margin") >= F.col("min_margin")))
    counts = passed.groupBy("min_dates", "min_share", "min_margin").agg(n.alias("emitted"))
    users = features.agg(F.countDistinct("user_id").alias("users"))
    cells = with_grid(users, min_dates=dates, min_share=shares, min_margin=margins)
    out = cells.join(F.broadcast(counts), ["min_dates", "min_share", "min_margin"], "left").fillna({"emitted": 0})
    return out.withColumn("coverage", F.try_divide("emitted", "users"))
