"""Scored evidence and its validation on later stays: splits without leakage, future windows, masks, paired outcomes and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import MIN_DATE_OVERLAP_S, WindowRule, contributions
from .reliability import uniform


def score_evidence(c: DataFrame) -> DataFrame:
    """c with dominance, coverage, support, evidence and status; evidence is null where an input is missing or impossible.

    c: top_share, runner_up_share, support_days, opportunity_days, stability. A missing runner-up is unknown, not complete dominance.
    """
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x)) < float("inf"))
    ok: dict[str, Column] = {
        "runner_up": finite("top_share") & finite("runner_up_share") & (F.col("top_share") > 0) & (F.col("top_share") <= 1) & (F.col("runner_up_share") >= 0) & (F.col("runner_up_share") <= F.col("top_share")),
        "opportunity": finite("support_days") & finite("opportunity_days") & (F.col("support_days") >= 1) & (F.col("support_days") <= F.col("opportunity_days"))
        & (F.col("support_days") == F.floor("support_days")) & (F.col("opportunity_days") == F.floor("opportunity_days")),
        "stability": finite("stability") & F.col("stability").between(0, 1),
    }
    ok = {k: F.coalesce(v, F.lit(False)) for k, v in ok.items()}
    dominance = F.when(ok["runner_up"], F.col("top_share") / (F.col("top_share") + F.col("runner_up_share")))
    coverage = F.when(ok["opportunity"], F.col("support_days") / F.col("opportunity_days"))
    support = F.when(ok["opportunity"], F.least(F.col("support_days") / 5, F.lit(1.0)))
    out = c.withColumns({"dominance": dominance, "coverage": coverage, "support": support})
    evidence = F.when(ok["runner_up"] & ok["opportunity"] & ok["stability"], F.cbrt(F.col("dominance") * F.col("coverage") * F.col("stability")) * F.sqrt("support"))
    status = F.lit("ok")
    for name in ("stability", "opportunity", "runner_up"):
        status = F.when(~ok[name], f"missing_or_invalid_{name}").otherwise(status)
    return out.withColumns({"evidence": evidence, "status": status, "blockers": F.concat_ws("+", *[F.when(~v, F.lit(k)) for k, v in ok.items()])})


def suppressed_summary(df: DataFrame, sets: list[list[str]], values: list[str], least: int = 5) -> DataFrame:
    """Counts and medians over each set of columns; medians of groups of fewer than ``least`` rows are left out."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), *[F.median(v).alias(f"median_{v}") for v in values])
    return g.withColumns({f"median_{v}": F.when(F.col("n") >= least, F.col(f"median_{v}")) for v in values})


def cut_by_dates(stays: DataFrame, fraction: float = 0.7) -> DataFrame:
    """stays with part: train, future, or crossing, by the date (UTC) that follows the first ``fraction`` of a user's arrival dates; none where a user has one date."""
    w = Window.partitionBy("user_id")
    d = stays.select("user_id", F.to_date("arrival").alias("d")).distinct().withColumns({"k": F.row_number().over(w.orderBy("d")) - 1, "n": F.count("*").over(w)})
    at = F.least(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction) - 1e-9)), F.col("n") - 1)
    cut = d.where((F.col("n") >= 2) & (F.col("k") == at)).select("user_id", F.col("d").cast("timestamp_ntz").alias("cut"))
    part = F.when(F.col("cut").isNull(), "none").when(F.col("departure") <= F.col("cut"), "train").when(F.col("arrival") >= F.col("cut"), "future").otherwise("crossing")
    return stays.join(cut, "user_id", "left").withColumn("part", part)


def split_counts(parts: DataFrame) -> DataFrame:
    n = lambda p: F.count_if(F.col("part") == p)
    return parts.groupBy("user_id").agg(F.countDistinct(F.to_date("arrival")).alias("dates"), n("train").alias("train"), n("future").alias("future"), n("crossing").alias("crossing"))


def future_windows(emitted: DataFrame, future: DataFrame, rule: WindowRule) -> DataFrame:
    """For each candidate (user_id, location_id): later dates in the window at any place, at its own and at others, whether it can be assessed and comes back."""
    by_date = contributions(future, rule).groupBy("user_id", "location_id", "behavior_date").agg(F.sum("overlap_s").alias("s")).where(F.col("s") >= MIN_DATE_OVERLAP_S)
    own = by_date.join(emitted.select("user_id", F.col("location_id").alias("own")), "user_id")
    same = F.when(F.col("location_id") == F.col("own"), F.col("behavior_date"))
    g = own.groupBy("user_id").agg(F.countDistinct("behavior_date").alias("opportunity"), F.countDistinct(same).alias("same"), F.countDistinct(F.when(F.col("location_id") != F.col("own"), F.col("behavior_date"))).alias("other"))
    return emitted.join(g, "user_id", "left").fillna(0, ["opportunity", "same", "other"]).withColumns({"assessable": F.col("opportunity") > 0, "reappears": F.col("same") > 0})


def masked_dates(stays: DataFrame, rate: float, replicate: int) -> DataFrame:
    """stays without ceil(rate * n) whole dates of each user, chosen by the hash of user, rate, replicate and date."""
    d = stays.select("user_id", F.to_date("arrival").alias("_d")).distinct()
    w = Window.partitionBy("user_id")
    r = F.row_number().over(w.orderBy(uniform(F.lit(f"{rate}|{replicate}"), F.col("user_id"), F.col("_d")), "_d"))
    kept = d.withColumns({"r": r, "n": F.count("*").over(w)}).where(F.col("r") > F.ceil(F.col("n") * F.lit(rate) - 1e-9)).select("user_id", "_d")
    return stays.withColumn("_d", F.to_date("arrival")).join(kept, ["user_id", "_d"], "left_semi").drop("_d")


def discordance(early: DataFrame, late: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Pairs of two cutoffs by which of them has the flag: both, early_only, late_only, neither."""
    j = early.select(*keys, F.col(flag).alias("e")).join(late.select(*keys, F.col(flag).alias("l")), keys)
    n = lambda e, x: F.count_if((F.col("e") == e) & (F.col("l") == x))
    return j.agg(F.count("*").alias("pairs"), n(True, True).alias("both"), n(True, False).alias("early_only"), n(False, True).alias("late_only"), n(False, False).alias("neither"))


def concordance(df: DataFrame, by: list[str], flag: str, score: str, least: int = 5) -> DataFrame:
    """The chance that a row with the flag scores over one without (ties count half), from ranks of the different scores; null for classes under ``least``."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(flag).alias("yes"), F.count_if(~F.col(flag)).alias("no"))
    below = F.sum("no").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    won = F.col("yes") * (F.coalesce(below, F.lit(0)) + F.col("no") / 2)
    g = counts.withColumn("won", won).groupBy(*by).agg(F.sum("won").alias("w"), F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    return g.select(*by, "yes", "no", F.when((F.col("yes") >= least) & (F.col("no") >= least), F.col("w") / (F.col("yes") * F.col("no"))).alias("concordance"))
