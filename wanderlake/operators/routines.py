"""Routines: sequences of places on supported days, moves between them, edges, users, and how stable both are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import circular_concentration, circular_mean_hour, entropy_term

DAY = ["user_id", "local_date"]
#: Days that make an edge repeated, and days that either half needs.
REPEAT_DAYS, MIN_HALF_DAYS = 2, 3


def day_segments(semantic: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """Stays of each day with repeats of a place in a row as one: user_id, local_date, segment, location_id, arrival, departure, left_local."""
    s = semantic.withColumn("local_date", F.to_date("local_arrival"))
    if usable is not None:
        s = s.join(usable.select(*DAY).distinct(), DAY, "left_semi")
    w = Window.partitionBy(*DAY).orderBy("arrival", "departure", "location_id")
    new = F.when(F.lag("location_id").over(w) == F.col("location_id"), 0).otherwise(1)
    s = s.withColumn("new", new).withColumn("segment", F.sum("new").over(w))
    return s.groupBy(*DAY, "segment", "location_id").agg(F.min("arrival").alias("arrival"), F.max("departure").alias("departure"), F.max_by("local_departure", F.struct("arrival", "departure")).alias("left_local"))


def day_sequences(segments: DataFrame) -> DataFrame:
    """A row a day: motif, number of segments and moves. A user-day's segments meet in one group."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("segment", "location_id"))), lambda x: F.concat(F.lit("L"), x["location_id"].cast("string")))
    return segments.groupBy(*DAY).agg(F.array_join(steps, ">").alias("motif"), F.count("*").alias("segments"), (F.count("*") - 1).alias("moves"))


def day_moves(segments: DataFrame) -> DataFrame:
    """A row a move within a day: origin, destination, hour of departure on the local clock, hours on the way."""
    w = Window.partitionBy(*DAY).orderBy("segment")
    m = segments.withColumns({"destination": F.lead("location_id").over(w), "next_arrival": F.lead("arrival").over(w)}).where("destination is not null")
    hour = F.hour("left_local") + F.minute("left_local") / 60 + F.second("left_local") / 3600
    return m.select(*DAY, F.col("segment").alias("move"), F.col("location_id").alias("origin"), "destination", hour.alias("departure_hour"), (F.timestamp_diff("MICROSECOND", F.col("departure"), F.col("next_arrival")) / 3.6e9).alias("gap_h"))


def edges(moves: DataFrame, sequences: DataFrame) -> DataFrame:
    """A row an edge: moves, active days (also by weekday), mean hour and its concentration, shares of days and moves, whether repeated."""
    week = F.when(F.weekday("local_date") < 5, F.col("local_date"))
    end = F.when(F.weekday("local_date") >= 5, F.col("local_date"))
    g = moves.groupBy("user_id", "origin", "destination").agg(
        F.count("*").alias("moves"), F.countDistinct("local_date").alias("days"), F.countDistinct(week).alias("week_days"), F.countDistinct(end).alias("weekend_days"),
        circular_mean_hour(F.col("departure_hour")).alias("hour"), circular_concentration(F.col("departure_hour")).alias("concentration"),
    )
    # Hours that cancel out have no mean; a mean of midnight is 0, on whichever side rounding leaves it.
    g = g.withColumn("hour", F.when(F.round("concentration", 9) > 0, F.when(F.col("hour") < 24 - 5e-10, F.col("hour")).otherwise(0.0)))
    support = sequences.groupBy("user_id").agg(F.count("*").alias("usable_days"))
    share = F.col("moves") / F.sum("moves").over(Window.partitionBy("user_id"))
    return g.join(support, "user_id").withColumns({"day_share": F.col("days") / F.col("usable_days"), "move_share": share, "repeated": F.col("days") >= REPEAT_DAYS})


def users(edge: DataFrame, sequences: DataFrame) -> DataFrame:
    """A row a user with usable days, also without any edge: counts, shares of the top edge, entropy of edges, frequency of the top motif."""
    days = sequences.groupBy("user_id").agg(F.count("*").alias("usable_days"), F.count_if(F.col("moves") > 0).alias("move_days"))
    motif = sequences.groupBy("user_id", "motif").agg(F.count("*").alias("n")).groupBy("user_id").agg((F.max("n") / F.sum("n")).alias("top_motif_share"))
    w = Window.partitionBy("user_id").orderBy(F.desc("days"), F.desc("moves"), F.desc("concentration"), "origin", "destination")
    e = edge.withColumn("r", F.row_number().over(w))
    top = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    g = e.groupBy("user_id").agg(
        F.sum("moves").alias("moves"), F.count("*").alias("edges"), F.count_if("repeated").alias("repeated_edges"), top("day_share").alias("top_day_share"), top("move_share").alias("top_move_share"),
        F.sum(entropy_term(F.col("move_share"))).alias("edge_entropy"), F.median(F.when(F.col("repeated"), F.col("concentration"))).alias("repeated_concentration"),
    )
    zero = ["moves", "edges", "repeated_edges", "top_day_share", "top_move_share", "edge_entropy"]
    return days.join(motif, "user_id").join(g, "user_id", "left").fillna(0, zero).withColumns({"has_repeated": F.col("repeated_edges") > 0, "motif_half": F.col("top_motif_share") >= 0.5})


def top_edge_halves(moves: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per user, the top edge of the early and of the late half of usable days, where either has enough of them, and whether they are the same."""
    w = Window.partitionBy("user_id")
    d = sequences.select(*DAY).withColumns({"k": F.row_number().over(w.orderBy("local_date")), "n": F.count("*").over(w)}).withColumn("late", F.col("k") > F.floor(F.col("n") / 2))
    halves = d.groupBy("user_id").agg(F.count_if(~F.col("late")).alias("early_days"), F.count_if("late").alias("late_days"))
    g = moves.join(d.select(*DAY, "late"), DAY).groupBy("user_id", "late", "origin", "destination").agg(F.countDistinct("local_date").alias("days"), F.count("*").alias("moves"))
    r = F.row_number().over(Window.partitionBy("user_id", "late").orderBy(F.desc("days"), F.desc("moves"), "origin", "destination"))
    top = g.withColumn("r", r).where("r = 1").withColumn("edge", F.concat_ws(">", "origin", "destination"))
    pick = lambda late: F.max(F.when(F.col("late") == late, F.col("edge")))
    t = top.groupBy("user_id").agg(pick(False).alias("early_edge"), pick(True).alias("late_edge"))
    j = halves.join(t, "user_id", "left").withColumn("eligible", (F.col("early_days") >= MIN_HALF_DAYS) & (F.col("late_days") >= MIN_HALF_DAYS))
    own = lambda c: F.when(F.col("eligible"), F.col(c)).alias(c)
    same = F.when(F.col("eligible"), F.coalesce(F.col("early_edge") == F.col("late_edge"), F.lit(False)))
    return j.select("user_id", "eligible", "early_days", "late_days", own("early_edge"), own("late_edge"), same.alias("same_edge"))


def recurrence_grid(edge: DataFrame, day_thresholds: tuple[int, ...] = (2, 3, 5), concentrations: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Edges and users that reach each combination of active days and concentration."""
    from .relational import with_grid

    g = with_grid(edge.select("user_id", "days", "concentration"), least_days=day_thresholds, least_concentration=concentrations)
    ok = (F.col("days") >= F.col("least_days")) & (F.round("concentration", 9) >= F.col("least_concentration"))
    return g.groupBy("least_days", "least_concentration").agg(F.count_if(ok).alias("edges"), F.countDistinct(F.when(ok, F.col("user_id"))).alias("users"))


def motif_and_edge_users(sequences: DataFrame, edge: DataFrame, min_days: int = 6, motif_share: float = 0.5) -> DataFrame:
    """Users with a frequent motif, with a repeated edge, and on which side of both they are."""
    from .relational import outer_with_side

    n = sequences.groupBy("user_id", "motif").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.sum("n").alias("days"), F.max("n").alias("most"))
    able = n.where(F.col("days") >= min_days)
    motif = able.where(F.col("most") / F.col("days") >= motif_share).select("user_id")
    od = edge.where("repeated").select("user_id").distinct().join(able, "user_id", "left_semi")
    return outer_with_side(motif, od, ["user_id"]).withColumn("side", F.when(F.col("side") == "left_only", "motif_only").when(F.col("side") == "right_only", "edge_only").otherwise("both"))


def adjacent_windows(windows: DataFrame, moves: DataFrame, by_window: str) -> DataFrame:
    """Eligible windows beside the next one of the user, with the divergence of their edges in bits. windows: user_id, local_date, by_window of every day of an eligible window."""
    counts = moves.join(windows, DAY).groupBy("user_id", by_window, "origin", "destination").agg(F.count("*").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id", by_window))).drop("n")
    ids = windows.select("user_id", by_window).distinct()
    pairs = ids.join(ids.select("user_id", (F.col(by_window) - 1).alias(by_window)), ["user_id", by_window])
    # Either window's edges go to the pair that it is part of, so no edge meets another one.
    sides = share.select("user_id", F.explode(F.array(F.struct(F.col(by_window).alias(by_window), F.lit(0).alias("side")), F.struct((F.col(by_window) - 1).alias(by_window), F.lit(1).alias("side")))).alias("x"), "origin", "destination", "p").select("user_id", "x.*", "origin", "destination", "p")
    both = sides.join(pairs, ["user_id", by_window]).groupBy("user_id", by_window, "origin", "destination").agg(F.sum(F.when(F.col("side") == 0, F.col("p")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("side") == 1, F.col("p")).otherwise(0.0)).alias("q"))
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(F.lit(0.0)) / 2
    ok = (F.sum("p") > 0) & (F.sum("q") > 0)
    out = both.groupBy("user_id", by_window).agg(F.when(ok, F.sum(half("p") + half("q"))).alias("jsd"), F.when(ok, F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"))
    return pairs.join(out, ["user_id", by_window], "left")


def days_with_moves(moves: DataFrame, sequences: DataFrame) -> DataFrame:
    """user_id, local_date and the day's moves as an array (origin, destination), of every day of sequences, also without a move. A user-day's moves meet in one group."""
    pairs = moves.groupBy(*DAY).agg(F.collect_list(F.struct("origin", "destination")).alias("pairs"))
    return sequences.select(*DAY).join(pairs, DAY, "left")


def partition_null(day: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per user: the divergence of edges between early and late days, and how often as many days drawn at random are parted as far or farther. day: days_with_moves().

    A replicate orders a user's days by a hash; all replicates and the real split are one plan. Every step groups by the user and something else, so days that are
    dealt out by user are not dealt out again, nor are the replicates, which carry the days' moves instead of being joined with them.
    """
    from .reliability import uniform

    days = day.withColumn("r", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    place = F.when(F.col("r") < 0, F.lit(0.0)).otherwise(uniform(F.lit(seed), F.col("user_id"), F.col("r"), F.col("local_date")))
    w = Window.partitionBy("user_id", "r")
    d = days.withColumns({"k": F.row_number().over(w.orderBy(place, "local_date")), "n": F.count("*").over(w)}).where(F.col("n") >= 2 * MIN_HALF_DAYS)
    e = d.select("user_id", "r", (F.col("k") > F.floor(F.col("n") / 2)).alias("late"), F.inline("pairs")).groupBy("user_id", "r", "origin", "destination").agg(F.count_if(~F.col("late")).alias("a"), F.count_if("late").alias("b"))
    e = e.withColumns({"p": F.try_divide("a", F.sum("a").over(w)), "q": F.try_divide("b", F.sum("b").over(w))})
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(F.lit(0.0)) / 2
    j = e.where("p is not null and q is not null").groupBy("user_id", "r").agg(F.round(F.sum(half("p") + half("q")), 9).alias("jsd"))
    j = j.withColumn("real", F.max(F.when(F.col("r") < 0, F.col("jsd"))).over(Window.partitionBy("user_id")))
    null = F.col("r") >= 0
    g = j.where("real is not null").groupBy("user_id").agg(F.first("real").alias("jsd"), F.count_if(null).alias("replicates"), F.median(F.when(null, F.col("jsd"))).alias("median_null"), F.count_if(null & (F.col("jsd") >= F.col("real"))).alias("as_far"))
    return g.withColumn("p_value", (F.col("as_far") + 1) / (F.col("replicates") + 1))


def mixture_1d(x: np.ndarray, k: int, least_sd: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means and deviations of k normal components by EM from quantiles, and the log likelihood."""
    mean = np.quantile(x, (np.arange(k) + 0.5) / k)
    sd, weight, before = np.full(k, max(float(x.std()) / k, least_sd)), np.full(k, 1 / k), -np.inf
    for _ in range(300):
        log = np.log(weight) - np.log(sd) - 0.5 * np.log(2 * np.pi) - 0.5 * ((x[:, None] - mean) / sd) ** 2
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        part = np.exp(log - total[:, None])
        mass = np.maximum(part.sum(axis=0), 1e-12)
        weight, mean = mass / mass.sum(), (part * x[:, None]).sum(axis=0) / mass
        sd = np.maximum(np.sqrt((part * (x[:, None] - mean) ** 2).sum(axis=0) / mass), least_sd)
        if total.sum() - before < 1e-8:
            break
        before = float(total.sum())
    return weight, mean, sd, before


def departure_modes(moves: DataFrame, least_moves: int = 8, most: int = 3, least_gain: float = 0.0, least_weight: float = 0.0, least_hours: float = 0.0) -> DataFrame:
    """Per edge with enough moves: how many modes its departure hours have by BIC, the gain over one mode, the modes' hours.

    The day is cut opposite to the mean hour, so that modes around midnight stay whole. With the last three arguments several modes count
    only if the gain, every weight and every distance between neighbours reach them. An edge's moves meet in one group; a few hundred a person and edge.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        h = g["departure_hour"].to_numpy(float)
        angle = h * np.pi / 12
        centre = np.arctan2(np.sin(angle).mean(), np.cos(angle).mean()) * 12 / np.pi
        x = np.sort((h - centre + 12) % 24 - 12)
        fits = [mixture_1d(x, k) for k in range(1, min(most, len(x)) + 1)]
        bic = [(3 * k + 2) * np.log(len(x)) - 2 * f[3] for k, f in enumerate(fits)]
        best = int(np.argmin(bic))
        weight, mean = fits[best][0], np.sort(fits[best][1])
        gain = float(bic[0] - bic[best])
        if best and (gain < least_gain or weight.min() < least_weight or np.diff(mean).min() < least_hours):
            best, mean = 0, fits[0][1]
        hours = [float(m) for m in np.sort((mean + centre) % 24)]
        first = g.iloc[0]
        return pd.DataFrame({"user_id": [first["user_id"]], "origin": [first["origin"]], "destination": [first["destination"]], "moves": [len(x)], "modes": [best + 1], "bic_gain": [gain], "hours": [hours]})

    n = F.count("*").over(Window.partitionBy("user_id", "origin", "destination"))
    able = moves.select("user_id", "origin", "destination", "departure_hour").withColumn("n", n).where(F.col("n") >= least_moves).drop("n")
    return able.groupBy("user_id", "origin", "destination").applyInPandas(fit, "user_id long, origin long, destination long, moves long, modes long, bic_gain double, hours array<double>")


def strict_mode_grid(moves: DataFrame, gains: tuple[float, ...] = (6.0, 10.0), weights: tuple[float, ...] = (0.15, 0.2), hours: tuple[float, ...] = (1.5, 2.0), least_moves: int = 8) -> DataFrame:
    """Edges with several modes under each combination of strict limits."""
    out = None
    for gain in gains:
        for weight in weights:
            for apart in hours:
                m = departure_modes(moves, least_moves, 3, gain, weight, apart)
                rows = m.agg(F.count("*").alias("edges"), F.count_if(F.col("modes") > 1).alias("multimodal")).select(F.lit(gain).alias("least_gain"), F.lit(weight).alias("least_weight"), F.lit(apart).alias("least_hours"), "edges", "multimodal")
                out = rows if out is None else out.unionByName(rows)
    return out
