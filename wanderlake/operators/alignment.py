"""Alignment of two clusterings of the same stays, of later stays with frozen clusters, and of two inventories of intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine_m
from .sweeps import whole_groups


def _digest(key: list[str]) -> Column:
    """A number of 60 bits for a member, from the SHA-256 of its key; null parts are empty."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")


def signatures(clustered: DataFrame, key: list[str]) -> DataFrame:
    """user_id, location_id, members, signature: two clusters of different members have different ones, whatever their labels and orders.

    The sum of the members' digests and their number, added up before the shuffle; no list of members is made.
    """
    return clustered.groupBy("user_id", "location_id").agg(F.count("*").alias("members"), F.sum(_digest(key)).cast("string").alias("signature"))


def membership_parity(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A row a user: clusters of the same members in both, in left alone and in right alone, and whether all are in both."""
    pick = lambda df, side: signatures(df, key).select("user_id", "members", "signature", F.lit(1).alias(side))
    both = pick(left, "l").join(pick(right, "r"), ["user_id", "members", "signature"], "full")
    n = lambda x: F.count_if(x)
    g = both.groupBy("user_id").agg(n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"), n(F.col("r").isNull()).alias("only_left"), n(F.col("l").isNull()).alias("only_right"))
    return g.withColumn("exact", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def contingency(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """user_id, left_id, right_id, shared, relation: the members that two clusters share, and how the clusters lie to each other.

    same: they share with none but each other; split: the left one falls apart into right ones that have nothing else; merge: the other way
    round; mixed: neither. What a member's partner lacks in the other clustering does not count.
    """
    l = left.select("user_id", *key, F.col("location_id").alias("left_id"))
    r = right.select(F.col("user_id").alias("_u"), *[F.col(k).alias(f"_{k}") for k in key], F.col("location_id").alias("right_id"))
    met = l.join(r, (F.col("user_id") == F.col("_u")) & F.expr(" and ".join(f"`{k}` <=> `_{k}`" for k in key)))
    n = met.groupBy("user_id", "left_id", "right_id").agg(F.count("*").alias("shared"))
    by_left, by_right = Window.partitionBy("user_id", "left_id"), Window.partitionBy("user_id", "right_id")
    d = n.withColumns({"_nl": F.count("*").over(by_left), "_nr": F.count("*").over(by_right)})
    d = d.withColumns({"_ml": F.max("_nr").over(by_left), "_mr": F.max("_nl").over(by_right)})
    relation = (
        F.when((F.col("_nl") == 1) & (F.col("_nr") == 1), "same").when((F.col("_nl") > 1) & (F.col("_ml") == 1), "split").when((F.col("_nr") > 1) & (F.col("_mr") == 1), "merge").otherwise("mixed")
    )
    return d.withColumn("relation", relation).select("user_id", "left_id", "right_id", "shared", "relation")


def assigned(pairs: DataFrame) -> DataFrame:
    """pairs (contingency()) with assigned: one partner at most for each cluster, those that share most first, ties by ids.

    A user's pairs, of which there are no more than its stays, are gone through in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["user_id"]):
            left, right = t["left_id"].to_pylist(), t["right_id"].to_pylist()
            chosen = np.zeros(t.num_rows, bool)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                used_left, used_right = set(), set()
                for i in range(a, b):
                    if left[i] not in used_left and right[i] not in used_right:
                        used_left.add(left[i])
                        used_right.add(right[i])
                        chosen[i] = True
            yield from t.append_column("assigned", pa.array(chosen)).to_batches()

    ordered = pairs.repartition("user_id").sortWithinPartitions("user_id", F.desc("shared"), "left_id", "right_id")
    kinds = ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes)
    return ordered.mapInArrow(run, kinds + ", assigned boolean")


UNMATCHED, AMBIGUOUS = -1, -2


def align_to_frozen(later: DataFrame, frozen: DataFrame, key: list[str], most_m: float) -> DataFrame:
    """later (user_id, lat, lon, key) with location_id and match: the one frozen location (user_id, location_id, lat, lon of its members) of the user of which every member is within most_m.

    None: -1, not_matched; several: -2, ambiguous. A later stay meets only the locations that have their first member's cell near its own.
    """
    size = most_m / 110_574.0
    spots = frozen.select("user_id", "location_id", "lat", "lon").distinct()
    firsts = spots.groupBy("user_id", "location_id").agg(F.min(F.struct("lat", "lon")).alias("p"))
    # In a row of cells, all are as wide as most_m at the row's far side from the equator.
    width = lambda cy: F.lit(size) / F.greatest(F.cos(F.radians(F.least((F.abs(cy) + 2) * size, F.lit(89.0)))), F.lit(0.01))
    at = firsts.select(F.col("user_id").alias("_u"), "location_id", cell(F.col("p.lat"), size).alias("cy"), "p").withColumn("cx", F.floor(F.col("p.lon") / width(F.col("cy"))))
    own = later.select("user_id", *key, "lat", "lon").withColumn("cy", F.explode(F.sequence(cell(F.col("lat"), size) - 1, cell(F.col("lat"), size) + 1)))
    own = own.withColumn("cx", F.explode(F.sequence(F.floor(F.col("lon") / width(F.col("cy"))) - 1, F.floor(F.col("lon") / width(F.col("cy"))) + 1)))
    limit = most_m + 1e-6
    near = own.join(at, (F.col("user_id") == F.col("_u")) & (own.cy == at.cy) & (own.cx == at.cx)).where(haversine_m(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")) <= limit)
    members = spots.select(F.col("user_id").alias("_mu"), F.col("location_id").alias("_ml"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    whole = near.select("user_id", *key, "lat", "lon", "location_id").join(members, (F.col("user_id") == F.col("_mu")) & (F.col("location_id") == F.col("_ml")))
    inside = whole.groupBy("user_id", *key, "location_id").agg(F.max(haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).alias("far")).where(F.col("far") <= limit)
    options = inside.groupBy("user_id", *key).agg(F.count("*").alias("_n"), F.min("location_id").alias("_loc"))
    out = later.join(options, ["user_id", *key], "left")
    location = F.when(F.col("_n") == 1, F.col("_loc")).when(F.col("_n") > 1, F.lit(AMBIGUOUS)).otherwise(F.lit(UNMATCHED))
    match = F.when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "ambiguous").otherwise("not_matched")
    return out.select(*later.columns, location.cast("long").alias("location_id"), match.alias("match"))


PAIRED = "user_id long, left_id long, right_id long, overlap_s double"


def best_matching(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs to take so that the weights' sum is greatest and no interval is taken twice. Pairs in order of time, of intervals that do not overlap within a side.

    Pairs that share an interval stand together, so the best up to a pair is the best without it, or it and the best before the first pair that shares with it.
    """
    n = len(left)

    def start(ids: np.ndarray) -> np.ndarray:
        new = np.append(True, ids[1:] != ids[:-1])
        return np.flatnonzero(new)[np.cumsum(new) - 1]

    first = np.minimum(start(left), start(right)) if n else np.zeros(0, np.int64)
    best = np.zeros(n + 1)
    for i in range(n):
        best[i + 1] = max(best[i], best[first[i]] + weight[i])
    taken, i = np.zeros(n, bool), n
    while i > 0:
        if best[i] > best[i - 1]:
            taken[i - 1] = True
            i = int(first[i - 1])
        else:
            i -= 1
    return taken


def match_inventories(left: DataFrame, right: DataFrame) -> DataFrame:
    """user_id, left_id, right_id, overlap_s: the one-to-one matching of two inventories (user_id, id, start_time, end_time) with the greatest time in common.

    Within an inventory a user's intervals do not overlap (touching is allowed). Intervals meet in an equi-join on user and day. Runs of pairs that share
    intervals are independent of each other; a run is matched in order of time, so a user's runs may lie in many tasks.
    """
    day = lambda: F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))).alias("day")
    l = left.select("user_id", F.col("id").alias("left_id"), F.col("start_time").alias("ls"), F.col("end_time").alias("le"), day())
    r = right.select("user_id", F.col("id").alias("right_id"), F.col("start_time").alias("rs"), F.col("end_time").alias("re"), day())
    begins, ends = F.greatest("ls", "rs"), F.least("le", "re")
    pairs = l.join(r, ["user_id", "day"]).where((begins < ends) & (F.col("day") == F.to_date(begins)))
    w = Window.partitionBy("user_id").orderBy("begin", "ls", "rs")
    timed = pairs.select(F.col("user_id").cast("long").alias("user_id"), F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"), begins.alias("begin"), "ls", "rs", (F.timestamp_diff("MICROSECOND", begins, ends) / 1e6).alias("overlap_s"))
    linked = (F.lag("left_id").over(w) == F.col("left_id")) | (F.lag("right_id").over(w) == F.col("right_id"))
    runs = timed.withColumn("run", F.sum(F.when(linked, 0).otherwise(1)).over(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["user_id", "run"]):
            a, b, weight = (np.asarray(t[c]) for c in ("left_id", "right_id", "overlap_s"))
            taken = np.concatenate([best_matching(a[i:j], b[i:j], weight[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield from t.select(["user_id", "left_id", "right_id", "overlap_s"]).filter(pa.array(taken)).to_batches()

    return runs.repartition("user_id", "run").sortWithinPartitions("user_id", "run", "begin", "ls", "rs").select("user_id", "run", "left_id", "right_id", "overlap_s").mapInArrow(run, PAIRED)


def inventory_details(left: DataFrame, right: DataFrame) -> DataFrame:
    """source, user_id, id, matched_id, overlap_s, overlap_over_shorter, distance_m of every interval of both inventories (with lat and lon); 0 overlap where there is no partner."""
    m = match_inventories(left, right)

    def of(source: DataFrame, target: DataFrame, name: str, own: str, other: str) -> DataFrame:
        length = lambda df: F.timestamp_diff("MICROSECOND", df["start_time"], df["end_time"]) / 1e6
        s = source.select("user_id", "id", "lat", "lon", length(source).alias("s"))
        t = target.select(F.col("user_id").alias("_u"), F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), length(target).alias("_s"))
        p = m.select(F.col("user_id").alias("_pu"), F.col(own).alias("_own"), F.col(other).alias("matched_id"), "overlap_s")
        d = s.join(p, (F.col("user_id") == F.col("_pu")) & (F.col("id") == F.col("_own")), "left").join(t, (F.col("user_id") == F.col("_u")) & (F.col("matched_id") == F.col("_id")), "left")
        shorter = F.least("s", "_s")
        ratio = F.when(shorter > 0, F.col("overlap_s") / F.when(shorter > 0, shorter)).otherwise(0.0)
        return d.select(F.lit(name).alias("source"), "user_id", "id", "matched_id", F.coalesce("overlap_s", F.lit(0.0)).alias("overlap_s"), F.coalesce(ratio, F.lit(0.0)).alias("overlap_over_shorter"), haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("distance_m"))

    return of(left, right, "left", "left_id", "right_id").unionByName(of(right, left, "right", "right_id", "left_id"))


def inventory_summary(details: DataFrame, near_m: float = 200.0, strong: float = 0.5) -> DataFrame:
    """A row an inventory: intervals, those with a partner, those with one near by, those with a strong match, and their rates."""
    near, any_ = F.coalesce(F.col("distance_m") <= near_m, F.lit(False)), F.col("overlap_s") > 0
    g = details.groupBy("source").agg(F.count("*").alias("stays"), F.count_if(any_).alias("overlap_any"), F.count_if(any_ & near).alias("overlap_near"), F.count_if((F.col("overlap_over_shorter") >= strong) & near).alias("strong_match"))
    return g.withColumns({f"{c}_rate": F.col(c) / F.col("stays") for c in ("overlap_any", "overlap_near", "strong_match")})
