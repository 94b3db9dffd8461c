"""Agreement between methods, splits of a user's dates, exposure regimes and report suppression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import circular_concentration, circular_mean_hour


def recurrence_assignments(semantic: DataFrame, min_weekdays: int = 3) -> DataFrame:
    """HOME: the place of the longest dwell. OFFICE: of the others, the one on the most weekdays (three or more)."""
    d = F.to_date("local_arrival")
    f = semantic.groupBy("user_id", "location_id").agg(F.sum("duration_s").alias("dwell_s"), F.countDistinct(F.when(F.weekday(d) < 5, d)).alias("weekdays"))
    w = Window.partitionBy("user_id")
    home = f.withColumn("r", F.row_number().over(w.orderBy(F.desc("dwell_s"), "location_id")))
    office = home.where("r > 1").where(F.col("weekdays") >= min_weekdays).withColumn("o", F.row_number().over(w.orderBy(F.desc("weekdays"), F.desc("dwell_s"), "location_id"))).where("o = 1")
    pick = lambda df, label: df.select("user_id", F.lit(label).alias("label"), "location_id")
    return pick(home.where("r = 1"), "HOME").unionByName(pick(office, "OFFICE"))


def date_halves(semantic: DataFrame) -> DataFrame:
    """semantic with half (1 or 2 by the order of a user's dates) and odd_week."""
    d = F.to_date("local_arrival")
    w = Window.partitionBy("user_id").orderBy(d)
    s = semantic.withColumn("date_no", F.dense_rank().over(w))
    most = F.max("date_no").over(Window.partitionBy("user_id"))
    return s.withColumns({"half": F.when(F.col("date_no") * 2 <= most, 1).otherwise(2), "odd_week": F.weekofyear(d) % 2 == 1}).drop("date_no")


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each label, users in both (user_id, label, location_id), users that agree, and their share."""
    j = left.select("user_id", "label", F.col("location_id").alias("a")).join(right.select("user_id", "label", F.col("location_id").alias("b")), ["user_id", "label"])
    same = F.count_if(F.col("a") == F.col("b"))
    return j.groupBy("label").agg(F.count("*").alias("users"), same.alias("agree"), (same / F.count("*")).alias("agree_share"))


def exposure_regime(df: DataFrame, value: str) -> DataFrame:
    """df with regime: zero, or the third (low, middle, high) of the mean rank among positive values.

    Ranks are made over the different values with their counts, and joined back to the rows by value.
    """
    counts = df.where(F.col(value) > 0).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_v")  # a row a different value, not a row of df
    below = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    total = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = (below + (F.col("_n") + 1) / 2) / total
    regime = F.when(share <= 1 / 3, "low").when(share <= 2 / 3, "middle").otherwise("high")
    regimes = counts.select("_v", regime.alias("regime"))
    return df.join(regimes, df[value] == regimes["_v"], "left").drop("_v").withColumn("regime", F.coalesce("regime", F.lit("zero")))


def suppressed_counts(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Counts over each column alone and over all, leaving out groups of fewer than ``least`` rows."""
    sets = df.groupingSets([*[[F.col(c)] for c in columns], []], *[F.col(c) for c in columns])
    return sets.agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bernoulli_dropout(df: DataFrame, keys: list[str], rate: float, seed: int) -> DataFrame:
    """The rows whose hash is not under the rate: the same rows whatever the partitioning."""
    unit = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) / 1_000_000
    return df.where(unit >= rate)


FIXED, HOURLY, RECURRENCE = "fixed_window", "hourly_dominant", "recurrence"
#: Target hours of the hourly method, the share of them that a day must show, and the days that a candidate needs.
TARGET_HOURS = {"HOME": tuple(range(0, 6)), "OFFICE": tuple(range(9, 16))}
MIN_HOURS_SHARE, MIN_DAYS, MIN_STAYS = 0.40, 3, 2


#: The columns that tell users apart, without and with variants of their stays.
USER, VARIANT = ("user_id",), ("user_id", "variant")


def with_variants(semantic: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """semantic with the names of the variants whose condition holds for a row, so that one plan runs all variants at once."""
    return semantic.withColumn("variants", F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in variants.items()])))


def _carried(df: DataFrame, by: tuple[str, ...]) -> list[str]:
    return [c if c in df.columns else "variants" for c in by]


def _spread(df: DataFrame) -> DataFrame:
    """A copy of each row for each of its variants; work that is the same in all of them goes before."""
    return df.withColumn("variant", F.explode("variants")).drop("variants") if "variants" in df.columns else df


def place_evidence(semantic: DataFrame, by: tuple[str, ...] = USER) -> DataFrame:
    """A row a place: stay_count, dwell_s, days, weekdays, and for each rule seconds and dates (600 s or more) in its window.

    Stays are counted by place and date first, all rules at once, so one pass serves every method that needs no hours.
    """
    from .evidence import MIN_DATE_OVERLAP_S, RULES, overlap_s

    on = F.to_date("local_arrival")
    # Windows may reach over midnight, so the day before counts as well.
    dates = F.sequence(F.date_sub(on, 1), F.greatest(on, F.to_date("local_departure")))
    d = semantic.select(*_carried(semantic, by), "location_id", "arrival", "departure", "timezone_id", "duration_s", on.alias("on"), F.explode_outer(dates).alias("d"))
    seconds = {r.label: F.greatest(F.lit(0.0), F.when(F.weekday("d").isin(*r.weekdays), overlap_s(r, "d"))) for r in RULES}
    d = d.withColumns({"here": F.col("d").eqNullSafe(F.col("on")), **seconds})
    d = d.where(F.col("here") | (F.greatest(*seconds, F.lit(0.0)) > 0)).select(*_carried(semantic, by), "location_id", "d", "here", F.when(F.col("here"), F.col("duration_s")).alias("s"), *seconds)
    by_date = _spread(d).groupBy(*by, "location_id", "d").agg(F.count_if("here").alias("stays"), F.sum("s").alias("s"), *[F.sum(label).alias(label) for label in seconds])
    came = F.col("stays") > 0
    windows = [c for r in RULES for c in (F.sum(r.label).alias(f"{r.label}_s"), F.count_if(F.col(r.label) >= MIN_DATE_OVERLAP_S).alias(f"{r.label}_dates"))]
    return by_date.groupBy(*by, "location_id").agg(
        F.sum("stays").alias("stay_count"), F.sum("s").alias("dwell_s"), F.count_if(came & F.col("d").isNotNull()).alias("days"), F.count_if(came & (F.weekday("d") < 5)).alias("weekdays"), *windows
    )


def _chosen(places: DataFrame, by: tuple[str, ...], rows: list[tuple[Column, Column]]) -> DataFrame:
    return places.select(*by, F.inline(F.array_compact(F.array(*[F.when(cond, row) for cond, row in rows]))))


def _candidate(method: str, label: str, score: Column, support_days: Column, emitted: Column) -> Column:
    return F.struct(
        F.lit(method).alias("method"), F.lit(label).alias("label"), F.col("location_id"), score.alias("score"), support_days.cast("long").alias("support_days"), F.coalesce(emitted, F.lit(False)).alias("emitted")
    )


def _ranked_fixed(places: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The best candidate of each label by windows, and whether its gates let it through (as evidence.top_candidate)."""
    from .evidence import RULES

    rows, user = [], Window.partitionBy(*by)
    for r in RULES:
        s, n, share, ok = F.col(f"{r.label}_s"), F.col(f"{r.label}_dates"), F.col(f"{r.label}_share"), F.col(f"{r.label}_ok")
        total = F.sum(s).over(user)
        places = places.withColumns({f"{r.label}_share": F.when(total > 0, s / total).otherwise(F.lit(0.0)), f"{r.label}_ok": (F.col("stay_count") >= MIN_STAYS) & (n >= r.min_dates) & (s > 0)})
        w = user.orderBy(ok.desc(), share.desc(), n.desc(), s.desc(), F.desc("stay_count"), "location_id")
        places = places.withColumns({f"{r.label}_rank": F.row_number().over(w), f"{r.label}_next": F.lead(F.when(ok, share)).over(w)})
        emitted = (share >= r.min_share) & (share - F.coalesce(f"{r.label}_next", F.lit(0.0)) >= r.min_margin)
        rows.append((ok & (F.col(f"{r.label}_rank") == 1), _candidate(FIXED, r.label, share, n, emitted)))
    return places, rows


def _ranked_free(places: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """HOME: the recurring place of the longest dwell. OFFICE: of the other recurring ones, that on the most weekdays (three or more)."""
    user, recurs = Window.partitionBy(*by), F.col("stay_count") >= MIN_STAYS
    home = user.orderBy(recurs.desc(), F.desc("dwell_s"), F.desc("days"), F.desc("stay_count"), "location_id")
    places = places.withColumns({"h": F.row_number().over(home), "all_s": F.sum(F.when(recurs, F.col("dwell_s"))).over(user), "most": F.greatest(F.max(F.when(recurs, F.col("weekdays"))).over(user), F.lit(1))})
    other = recurs & (F.col("h") > 1)
    places = places.withColumn("o", F.row_number().over(user.orderBy(other.desc(), F.desc("weekdays"), F.desc("dwell_s"), F.desc("stay_count"), "location_id")))
    no = F.lit(False)
    return places, [
        (recurs & (F.col("h") == 1), _candidate(RECURRENCE, "HOME", F.col("dwell_s") / F.col("all_s"), F.col("days"), no)),
        (other & (F.col("o") == 1) & (F.col("weekdays") >= MIN_DAYS), _candidate(RECURRENCE, "OFFICE", F.col("weekdays") / F.col("most"), F.col("weekdays"), no)),
    ]


def dominant_hours(semantic: DataFrame, by: tuple[str, ...] = USER, hours: tuple[int, ...] | None = None) -> DataFrame:
    """The place with most overlap in each local hour of a user: by, hour_start, location_id, overlap_s. hours: only these of the day."""
    starts = F.sequence(F.date_trunc("hour", F.col("local_arrival")).cast("timestamp_ntz"), F.col("local_departure"), F.expr("interval 1 hour"))
    if hours is not None:
        starts = F.filter(starts, lambda h: F.hour(h).isin(*hours))
    h = semantic.where("local_departure > local_arrival").select(*_carried(semantic, by), "location_id", "local_arrival", "local_departure", F.explode(starts).alias("hour_start"))
    s = F.timestamp_diff("MICROSECOND", F.greatest("local_arrival", "hour_start"), F.least("local_departure", F.col("hour_start") + F.expr("interval 1 hour"))) / 1e6
    h = h.withColumn("s", s).where("s > 0").select(*_carried(semantic, by), "location_id", "hour_start", "s")
    g = _spread(h).groupBy(*by, "hour_start", "location_id").agg(F.sum("s").alias("overlap_s"))
    w = Window.partitionBy(*by, "hour_start").orderBy(F.desc("overlap_s"), "location_id")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def hourly_assignments(semantic: DataFrame, by: tuple[str, ...] = USER) -> DataFrame:
    """HOME by the mean share of observed night hours, OFFICE by the share of observed weekdays, over days that show enough of the target hours."""
    bins = dominant_hours(semantic, by, tuple(sorted({h for hours in TARGET_HOURS.values() for h in hours}))).withColumn("d", F.to_date("hour_start"))
    meant = [F.when(F.hour("hour_start").isin(*hours) & (F.lit(label == "HOME") | (F.weekday("d") < 5)), F.lit(label)) for label, hours in TARGET_HOURS.items()]
    need = F.coalesce(*[F.when(F.col("label") == label, math.ceil(MIN_HOURS_SHARE * len(hours))) for label, hours in TARGET_HOURS.items()])
    day = Window.partitionBy(*by, "label", "d")
    # One row an hour; the first one of a day stands for the day.
    t = bins.withColumn("label", F.explode(F.array_compact(F.array(*meant))))
    t = t.withColumns({"observed": F.count("*").over(day), "head": (F.row_number().over(day.orderBy("hour_start")) == 1).cast("int")}).where(F.col("observed") >= need)
    days = t.groupBy(*by, "label", "d", "location_id").agg((F.count("*") / F.first("observed")).alias("fraction"), F.max("head").alias("head"))
    days = days.withColumn("valid_days", F.sum("head").over(Window.partitionBy(*by, "label")))
    # Rounded, so that ties are ties in whatever order the fractions are added.
    place = days.groupBy(*by, "label", "location_id", "valid_days").agg(F.round(F.avg("fraction"), 9).alias("hour_fraction"), F.count("*").alias("visited"))
    share, home = F.col("visited") / F.col("valid_days"), F.col("label") == "HOME"
    place = place.withColumns({"score": F.when(home, F.col("hour_fraction")).otherwise(share), "then": F.when(home, share).otherwise(F.col("hour_fraction"))})
    w = Window.partitionBy(*by, "label").orderBy(F.desc("score"), F.desc("then"), F.desc("visited"), "location_id")
    recurring = _spread(semantic.select(*_carried(semantic, by), "location_id")).groupBy(*by, "location_id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_STAYS)
    top = place.where(F.col("valid_days") >= MIN_DAYS).join(recurring, [*by, "location_id"], "left_semi").withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.select(*by, F.lit(HOURLY).alias("method"), "label", "location_id", "score", F.col("valid_days").alias("support_days"), F.lit(False).alias("emitted"))


def schedule_free_assignments(semantic: DataFrame) -> DataFrame:
    """HOME: the recurring place of the longest dwell. OFFICE: of the other recurring ones, that on the most weekdays (three or more)."""
    places, rows = _ranked_free(place_evidence(semantic), USER)
    return _chosen(places, USER, rows)


def infer_assignments(semantic: DataFrame, by: tuple[str, ...] = USER) -> DataFrame:
    """The candidates of all three methods: by, method, label, location_id, score, support_days, emitted.

    Every step groups by the user and something else, so stays that are dealt out by user are not dealt out again.
    """
    places, fixed = _ranked_fixed(place_evidence(semantic, by), by)
    places, free = _ranked_free(places, by)
    return _chosen(places, by, fixed + free).unionByName(hourly_assignments(semantic, by))


def date_share_split(semantic: DataFrame, share: float) -> DataFrame:
    """semantic with train: whether the row's date is among the first share of its user's dates (one at least)."""
    d = F.to_date("local_arrival")
    s = semantic.withColumn("_k", F.dense_rank().over(Window.partitionBy("user_id").orderBy(d)))
    n = F.max("_k").over(Window.partitionBy("user_id"))
    return s.withColumn("train", F.col("_k") <= F.greatest(F.lit(1), F.floor(n * share))).drop("_k")


def _half_variants() -> dict[str, Column]:
    """The halves of a user's dates, as the columns first and odd tell."""
    return {"first_second|l": F.col("first"), "first_second|r": ~F.col("first"), "odd_even|l": F.col("odd"), "odd_even|r": ~F.col("odd")}


def _with_halves(semantic: DataFrame) -> DataFrame:
    return date_share_split(semantic, 0.5).withColumnRenamed("train", "first").withColumn("odd", F.weekofyear(F.to_date("local_arrival")) % 2 == 1)


def _both_halves(a: DataFrame) -> DataFrame:
    a = a.withColumns({"split": F.split_part("variant", F.lit("|"), F.lit(1)), "half": F.split_part("variant", F.lit("|"), F.lit(2))})
    pick = lambda h: F.max(F.when(F.col("half") == h, F.col("location_id")))
    both = a.groupBy("split", "user_id", "method", "label").agg(pick("l").alias("left_location"), pick("r").alias("right_location"))
    return both.where("left_location is not null and right_location is not null")


def split_half(semantic: DataFrame) -> DataFrame:
    """split, user_id, method, label, and the location of either half: by early and late dates, and by odd and even weeks."""
    return _both_halves(infer_assignments(with_variants(_with_halves(semantic), _half_variants()).drop("first", "odd"), VARIANT))


def split_half_summary(details: DataFrame) -> DataFrame:
    same = F.count_if(F.col("left_location") == F.col("right_location"))
    return details.groupBy("split", "method", "label").agg(F.count("*").alias("both_halves"), same.alias("same_location"), (same / F.count("*")).alias("agreement"))


def _later_metrics(late: DataFrame) -> DataFrame:
    """user_id, location_id, label, metric, rank: the places of the later dates by their share of dwell (HOME) and of workdays (OFFICE)."""
    d = F.to_date("local_arrival")
    week = F.when(F.weekday(d) < 5, d)
    w = Window.partitionBy("user_id")
    own = late.groupBy("user_id", "location_id").agg(F.sum("duration_s").alias("dwell_s"), F.countDistinct(week).alias("weekdays"))
    all_days = late.groupBy("user_id").agg(F.countDistinct(week).alias("all_weekdays"))
    m = own.join(all_days, "user_id").withColumns({"HOME": F.coalesce(F.try_divide(F.col("dwell_s"), F.sum("dwell_s").over(w)), F.lit(0.0)), "OFFICE": F.coalesce(F.try_divide("weekdays", "all_weekdays"), F.lit(0.0))})
    m = m.withColumns({f"{c}_rank": F.rank().over(w.orderBy(F.desc(c))) for c in ("HOME", "OFFICE")})
    return m.select("user_id", "location_id", F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("metric"), F.col(f"{c}_rank").alias("rank")) for c in ("HOME", "OFFICE")])))


def heldout(semantic: DataFrame, share: float = 0.6) -> DataFrame:
    """Candidates of the first dates, with their share and rank among the places of the later ones."""
    s = date_share_split(semantic, share)
    return infer_assignments(s.where("train").drop("train")).join(_later_metrics(s.where(~F.col("train"))), ["user_id", "location_id", "label"], "left")


def heldout_summary(details: DataFrame) -> DataFrame:
    return details.groupBy("method", "label").agg(
        F.count("*").alias("candidates"), F.avg(F.col("rank").isNotNull().cast("double")).alias("seen_share"), F.avg(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("double")).alias("top1_share"),
        F.median(F.coalesce("metric", F.lit(0.0))).alias("median_metric"), F.median("rank").alias("median_rank"),
    )


def uniform(seed: Column, *keys: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of seed and keys: the same one on any partitioning and in any engine."""
    digest = F.sha2(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in keys]), 256)
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def dropout(semantic: DataFrame, rates: tuple[float, ...] = (0.1, 0.2, 0.3), seeds: tuple[int, ...] = (11, 23, 42)) -> DataFrame:
    """Whether each candidate is found again when stays are left out at random: rate, seed, user_id, method, label, location_id, retained."""
    kept = _kept(rates, seeds)
    return _dropped(infer_assignments(with_variants(semantic, {"all": F.lit(True), **kept}), VARIANT), list(kept))


def _kept(rates: tuple[float, ...], seeds: tuple[int, ...]) -> dict[str, Column]:
    at = F.date_format("arrival", "yyyy-MM-dd HH:mm:ss")
    return {f"{rate}|{seed}": uniform(F.lit(seed), F.col("user_id"), F.col("location_id"), at) >= rate for rate in rates for seed in seeds}


def _dropped(a: DataFrame, variants: list[str]) -> DataFrame:
    return _retained(a, variants).select(F.split_part("variant", F.lit("|"), F.lit(1)).cast("double").alias("rate"), F.split_part("variant", F.lit("|"), F.lit(2)).cast("int").alias("seed"), "user_id", "method", "label", "location_id", "retained")


def _retained(a: DataFrame, variants: list[str]) -> DataFrame:
    """Each candidate of the variant all beside every other variant."""
    at = lambda v: F.max(F.when(F.col("variant") == v, F.col("location_id")))
    # A candidate is the only one of its variant, so all variants meet in one grouping and nothing is worked out twice for a join.
    g = a.groupBy("user_id", "method", "label").agg(at("all").alias("location_id"), F.array(*[F.struct(F.lit(v).alias("variant"), at(v).alias("other")) for v in variants]).alias("others"))
    g = g.where("location_id is not null").select("user_id", "method", "label", "location_id", F.inline("others"))
    return g.withColumn("retained", F.coalesce(F.col("location_id") == F.col("other"), F.lit(False)))


def retention(details: DataFrame, by: str) -> DataFrame:
    return details.groupBy(by, "method", "label").agg(F.count("*").alias("candidates"), F.avg(F.col("retained").cast("double")).alias("retention"))


def time_shift(semantic: DataFrame, hours: int = 12) -> DataFrame:
    """Whether each candidate is found again when the local clock is moved: user_id, method, label, location_id, retained."""
    s = _spread(with_variants(semantic, {"all": F.lit(True), "shifted": F.lit(True)}))
    moved = F.when(F.col("variant") == "shifted", F.make_dt_interval(hours=F.lit(hours))).otherwise(F.make_dt_interval())
    # Instants move with the local clock, so windows that are compared as instants see the shift as well.
    s = s.withColumns({c: F.col(c) + moved for c in ("arrival", "departure", "local_arrival", "local_departure")})
    return _retained(infer_assignments(s, VARIANT), ["shifted"]).withColumn("shift_hours", F.lit(hours)).select("shift_hours", "user_id", "method", "label", "location_id", "retained")


def suite(semantic: DataFrame, uri: str, rate: float = 0.3, seeds: tuple[int, ...] = (11, 23, 42), share: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What infer_assignments(), split_half(), heldout() and dropout() (at one rate) give, from one pass over all variants, written under the shared folder's uri."""
    s = date_share_split(_with_halves(semantic), share)
    dropped = _kept((rate,), seeds)
    variants = {"all": F.lit(True), "train": F.col("train"), **_half_variants(), **dropped}
    a = infer_assignments(with_variants(s, variants).drop("train", "first", "odd"), VARIANT)
    a.write.parquet(uri)
    a = semantic.sparkSession.read.schema(a.schema).parquet(uri)
    of = lambda names: a.where(F.col("variant").isin(names))
    held = of(["train"]).drop("variant").join(_later_metrics(s.where(~F.col("train"))), ["user_id", "location_id", "label"], "left")
    return of(["all"]).drop("variant"), _both_halves(of(list(_half_variants()))), held, _dropped(of(["all", *dropped]), list(dropped))


def home_consensus(assignments: DataFrame, splits: DataFrame, held: DataFrame, dropped: DataFrame, rate: float = 0.3) -> DataFrame:
    """Votes for each HOME candidate, confirmations along three axes of reliability by its own methods, and a tier.

    high: the only winner with two votes or more, and all three axes; medium: two of them; else uncertain.
    """
    by = ["user_id", "location_id"]
    home = assignments.where("label = 'HOME'")
    votes = home.groupBy(*by).agg(F.count("*").alias("votes"), F.max(F.col("method") == FIXED).alias("fixed_selected"), F.max("emitted").alias("fixed_emitted"))
    w = Window.partitionBy("user_id")
    votes = votes.withColumn("most", F.max("votes").over(w)).withColumn("winners", F.count_if(F.col("votes") == F.col("most")).over(w))
    votes = votes.withColumn("unique_winner", (F.col("votes") == F.col("most")) & (F.col("winners") == 1)).drop("most", "winners")
    own = home.select("user_id", "location_id", "method")
    split = own.join(splits.where("label = 'HOME' and left_location = right_location").select("user_id", "method", "split", F.col("left_location").alias("location_id")), [*by, "method"])
    split = split.groupBy(*by).agg(F.countDistinct("split").alias("split_axes"), F.countDistinct("method").alias("split_methods"))
    top1 = own.join(held.where("label = 'HOME' and rank is not null").select(*by, "method", "rank"), [*by, "method"])
    top1 = top1.groupBy(*by).agg(F.count("*").alias("seen_methods"), F.count_if(F.col("rank") == 1).alias("top1_methods"))
    kept = dropped.where((F.col("label") == "HOME") & (F.abs(F.col("rate") - rate) < 1e-9)).groupBy(*by, "method").agg(F.avg(F.col("retained").cast("double")).alias("r"))
    kept = own.join(kept, [*by, "method"]).groupBy(*by).agg(F.count_if(F.col("r") >= 2.0 / 3.0).alias("dropout_methods"), F.avg("r").alias("mean_retention"))
    e = votes.join(split, by, "left").join(top1, by, "left").join(kept, by, "left").fillna(0, ["split_axes", "split_methods", "seen_methods", "top1_methods", "dropout_methods"])
    axes = sum((F.col(c) > 0).cast("int") for c in ("split_axes", "top1_methods", "dropout_methods"))
    strong = F.col("unique_winner") & (F.col("votes") >= 2)
    tier = F.when(strong & (F.col("axes") == 3), "high").when(strong & (F.col("axes") == 2), "medium").otherwise("uncertain")
    production = F.when(F.col("fixed_emitted"), "baseline_emitted").when(F.col("fixed_selected"), "fixed_candidate_not_emitted").otherwise("outside_fixed_candidate")
    e = e.withColumn("axes", axes).withColumns({"tier": tier, "production": production})
    return e.withColumn("expansion", F.col("tier").isin("high", "medium") & (F.col("production") != "baseline_emitted"))


def secondary_windows(semantic: DataFrame, homes: DataFrame, width: int = 42, step: int = 14, min_days: int = 6, min_place_days: int = 3, min_stays: int = 2) -> DataFrame:
    """Sliding windows from each user's first day, and the most visited place other than HOME (homes: user_id, home_id) in each; null where none is visited enough."""
    s = semantic.join(homes, "user_id").withColumn("d", F.to_date("local_arrival"))
    first = F.min("d").over(Window.partitionBy("user_id"))
    s = s.withColumn("day", F.datediff("d", first))
    # Every window that holds the day: its number k has k * step <= day < k * step + width.
    lowest = F.greatest(F.lit(0), F.floor((F.col("day") - width) / step) + 1)
    clock = F.hour("local_arrival") + F.minute("local_arrival") / 60 + F.second("local_arrival") / 3600
    s = s.withColumn("clock", clock).withColumn("window", F.explode(F.sequence(lowest, F.floor(F.col("day") / step))))
    by = ["user_id", "window"]
    seen = s.groupBy(*by).agg(F.countDistinct("d").alias("days")).where(F.col("days") >= min_days)
    place = s.where("location_id <> home_id").groupBy(*by, "location_id").agg(F.countDistinct("d").alias("place_days"), F.count("*").alias("stays"), F.sum("duration_s").alias("dwell_s"), circular_mean_hour(F.col("clock")).alias("hour"), circular_concentration(F.col("clock")).alias("concentration"))
    place = place.where((F.col("place_days") >= min_place_days) & (F.col("stays") >= min_stays))
    w = Window.partitionBy(*by).orderBy(F.desc("place_days"), F.desc("dwell_s"), F.desc("stays"), "location_id")
    top = place.withColumns({"r": F.row_number().over(w), "next_days": F.lead("place_days").over(w)}).where("r = 1").drop("r")
    out = seen.join(top, by, "left")
    return out.select(*by, "days", "location_id", "place_days", (F.col("place_days") / F.col("days")).alias("visit_share"), ((F.col("place_days") - F.coalesce("next_days", F.lit(0))) / F.col("days")).alias("margin"), "hour", "concentration")


def secondary_patterns(windows: DataFrame, stable_share: float = 0.7) -> DataFrame:
    """Per user: how often each place leads, changes, the longest run, and a class of pattern."""
    from .relational import longest_runs

    total = windows.groupBy("user_id").agg(F.count("*").alias("windows"), F.count("location_id").alias("candidate_windows"))
    led = windows.where("location_id is not null")
    counts = led.groupBy("user_id", "location_id").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "location_id")))
    nth = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    best = ranked.groupBy("user_id").agg(F.count("*").alias("places"), nth(1, "location_id").alias("dominant"), nth(1, "n").alias("n1"), F.coalesce(nth(2, "n"), F.lit(0)).alias("n2"))
    runs = longest_runs(led, ["user_id"], ["window"], "location_id").select("user_id", "switches", "longest_run")
    j = total.join(best, "user_id", "left").join(runs, "user_id", "left").fillna(0, ["places", "n1", "n2", "switches", "longest_run"])
    pattern = (
        F.when((F.col("windows") < 3) | (F.col("candidate_windows") < 2), "insufficient").when(F.col("n1") / F.col("candidate_windows") >= stable_share, "stable_secondary_anchor")
        .when(F.col("n2") >= 2, "multi_anchor").otherwise("unstable")
    )
    return j.select("user_id", "windows", "candidate_windows", "places", "dominant", F.try_divide("n1", "candidate_windows").alias("dominant_share"), F.try_divide("n2", "candidate_windows").alias("second_share"), "switches", "longest_run", pattern.alias("pattern"))
