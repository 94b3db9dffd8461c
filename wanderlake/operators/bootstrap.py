"""Seeded resampling. Every random number is a hash of a seed, a row's own key and the replicate, so draws are the same on any partitioning and need no join.

A resample with replacement is a count a row and replicate: Poisson with mean one, as large samples have it. Counts are made where the rows are and
their sums go to (group, replicate) before the shuffle, so what is shuffled is groups by replicates, not rows by replicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chances that a Poisson number of mean one is at most 0, 1, ... 7. What is beyond the last counts as 8.
POISSON_ONE = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
#: Numbers of 32 bits in one hash.
A_HASH = 8


def with_uniforms(rows: DataFrame, key: Column, replicates: int, seed: int) -> DataFrame:
    """rows with r (0 to replicates - 1) and u, a number from 0 to under 1 for the key and replicate. One hash serves eight replicates."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // A_HASH))).alias("_b")
    hashed = rows.withColumn("_k", key.cast("string")).select("*", blocks)
    hashed = hashed.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "_k", F.col("_b").cast("string")).cast("binary"), 256))
    slot = hashed.select("*", F.explode(F.sequence(F.lit(0), F.lit(A_HASH - 1))).alias("_i")).withColumn("r", F.col("_b") * A_HASH + F.col("_i")).where(F.col("r") < replicates)
    u = F.conv(F.substring("_h", F.col("_i") * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967296.0
    return slot.withColumn("u", u).drop("_k", "_b", "_h", "_i")


def poisson(u: Column) -> Column:
    """The Poisson number of mean one that a uniform number stands for."""
    out = F.lit(len(POISSON_ONE))
    for n, chance in reversed(list(enumerate(POISSON_ONE))):
        out = F.when(u < chance, F.lit(n)).otherwise(out)
    return out


def replicate_means(rows: DataFrame, by: list[str], key: Column, values: list[str], replicates: int, seed: int) -> DataFrame:
    """by, r, and the mean of each value in each replicate of each group. A replicate that drew no row of a group is left out."""
    drawn = with_uniforms(rows, key, replicates, seed).withColumn("_w", poisson(F.col("u"))).where("_w > 0")
    weighted = lambda v: (F.sum(F.col("_w") * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v)
    return drawn.groupBy(*by, "r").agg(*[weighted(v) for v in values])


def bootstrap_means(rows: DataFrame, by: str, key: list[str], value: str, replicates: int, seed: int) -> DataFrame:
    """Per group: number, mean, the 2.5th and 97.5th percentile of the means of resamples, and the share of these over zero. key tells a row within its group."""
    name = F.concat_ws("|", F.col(by).cast("string"), *[F.col(k).cast("string") for k in key])
    means = replicate_means(rows, [by], name, [value], replicates, seed)
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    ends = means.groupBy(by).agg(q.alias("q"), F.avg((F.col(value) > 0).cast("double")).alias("over_zero"))
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return n.join(ends, by).select(by, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "over_zero")


def sides_of_pairs(rows: DataFrame, pairs: DataFrame, user: str) -> DataFrame:
    """rows of the users of pairs (pair, candidate, control), once for each pair and side that the user is of, with pair and is_candidate."""
    ends = pairs.select("pair", F.inline(F.array(F.struct(F.col("candidate").alias("_user"), F.lit(True).alias("is_candidate")), F.struct(F.col("control").alias("_user"), F.lit(False).alias("is_candidate")))))
    return rows.join(ends, F.col(user) == F.col("_user")).drop("_user")


def equalized(sides: DataFrame, stratum: str, key: Column, replicates: int, seed: int) -> DataFrame:
    """Rows of both sides of each pair with r: in each stratum the side with more rows gives as many, drawn without replacement, as the other has.

    A side that has no more than the other is taken whole in every replicate, without a draw; only the other is ranked by hash.
    """
    counts = sides.groupBy("pair", stratum).agg(F.least(F.count_if("is_candidate"), F.count_if(~F.col("is_candidate"))).alias("_n"), F.greatest(F.count_if("is_candidate"), F.count_if(~F.col("is_candidate"))).alias("_most"), (F.count_if("is_candidate") > F.count_if(~F.col("is_candidate"))).alias("_more"))
    counts = counts.where("_n > 0").withColumnsRenamed({"pair": "_pair", stratum: "_stratum"})
    met = sides.join(counts, (F.col("pair") == F.col("_pair")) & F.col(stratum).eqNullSafe(F.col("_stratum"))).drop("_pair", "_stratum")
    larger = (F.col("_most") > F.col("_n")) & (F.col("is_candidate") == F.col("_more"))
    drawn = with_uniforms(met.where(larger), key, replicates, seed)
    rank = F.row_number().over(Window.partitionBy("pair", "is_candidate", stratum, "r").orderBy("u", key))
    chosen = drawn.withColumn("_rank", rank).where("_rank <= _n").drop("_rank", "u")
    whole = met.where(~larger).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return chosen.unionByName(whole).drop("_n", "_most", "_more")


def _summary(replicas: DataFrame, by: list[str]) -> DataFrame:
    q = F.percentile("difference", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    g = replicas.groupBy(*by).agg(F.count("difference").alias("replicates"), q.alias("q"), F.avg((F.col("difference") > 0).cast("double")).alias("over_zero"))
    return g.select(*by, "replicates", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "over_zero")


def _differences(means: DataFrame, metrics: list[str]) -> DataFrame:
    """pair, r, metric, difference (candidate less control) of a row a pair, side and replicate; only where both sides have a value."""
    long = means.select("pair", "is_candidate", "r", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    side = lambda flag: F.max(F.when(F.col("is_candidate") == flag, F.col("value")))
    return long.groupBy("pair", "r", "metric").agg((side(True) - side(False)).alias("difference")).where("difference is not null")


def paired_bootstrap(days: DataFrame, pairs: DataFrame, stratum: str, key: list[str], metrics: list[str], replicates: int, seed: int) -> DataFrame:
    """Per pair and metric: over replicates of equalised days, the differences' median, 2.5th and 97.5th percentile and their share over zero.

    days: user_id, stratum, key, metrics. pairs: pair, candidate, control; pairs without common strata give no rows.
    """
    name = F.concat_ws("|", "pair", F.col("is_candidate").cast("string"), *[F.col(k).cast("string") for k in key])
    chosen = equalized(sides_of_pairs(days, pairs, "user_id"), stratum, name, replicates, seed)
    means = chosen.groupBy("pair", "is_candidate", "r").agg(*[F.avg(m).alias(m) for m in metrics])
    return _summary(_differences(means, metrics), ["pair", "metric"])


def transport_bootstrap(segments: DataFrame, pairs: DataFrame, key: list[str], replicates: int, seed: int, least_h: float) -> DataFrame:
    """Per pair and metric (km an hour, motorised and active share of distance): differences over replicates, each of equal hours on both sides.

    segments: user_id, key, duration_s, distance_m, motorized, active. A replicate takes a side's segments in the order of their hashes until the hours of the side with
    fewer are reached; of the last one only the part that is needed counts. Pairs of under least_h common hours are left out.
    """
    sides = sides_of_pairs(segments, pairs, "user_id").where("duration_s > 0")
    whole = sides.groupBy("pair").agg(F.sum(F.when(F.col("is_candidate"), F.col("duration_s"))).alias("_a"), F.sum(F.when(~F.col("is_candidate"), F.col("duration_s"))).alias("_b"))
    target = whole.select(F.col("pair").alias("_pair"), F.least("_a", "_b").alias("_target")).where((F.col("_a") > 0) & (F.col("_b") > 0) & (F.col("_target") >= least_h * 3600))
    name = F.concat_ws("|", "pair", F.col("is_candidate").cast("string"), *[F.col(k).cast("string") for k in key])
    drawn = with_uniforms(sides.join(target, F.col("pair") == F.col("_pair")), name, replicates, seed)
    before = F.coalesce(F.sum("duration_s").over(Window.partitionBy("pair", "is_candidate", "r").orderBy("u", name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    used = drawn.withColumn("_used", F.least(F.col("duration_s"), F.col("_target") - before)).where("_used > 0")
    part = F.col("distance_m") * F.col("_used") / F.col("duration_s")
    g = used.groupBy("pair", "is_candidate", "r").agg(F.sum(part).alias("_m"), F.sum("_used").alias("_s"), F.sum(F.when(F.col("motorized"), part).otherwise(0.0)).alias("_mm"), F.sum(F.when(F.col("active"), part).otherwise(0.0)).alias("_am"))
    share = lambda c: F.when(F.col("_m") > 0, F.col(c) / F.when(F.col("_m") > 0, F.col("_m"))).otherwise(0.0)
    means = g.select("pair", "is_candidate", "r", (F.col("_m") / 1000 / (F.col("_s") / 3600)).alias("distance_km_per_hour"), share("_mm").alias("motorized_distance_share"), share("_am").alias("active_distance_share"))
    # Below rounding errors a difference is 0, so that equal sides differ by 0 in whatever order their parts are added.
    differences = _differences(means, ["distance_km_per_hour", "motorized_distance_share", "active_distance_share"]).withColumn("difference", F.when(F.abs("difference") < 1e-9, 0.0).otherwise(F.col("difference")))
    return _summary(differences, ["pair", "metric"])
