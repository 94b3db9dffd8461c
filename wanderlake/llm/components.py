"""Connected components of a table of links, by alternating star contractions.

Every step is a min by group and a join back to the links. The min is pre-aggregated before the shuffle. In the join, nodes with
very many links (HOT, and a ten-thousandth of all link ends, so there are at most ten thousand of them) are broadcast, so that the
links of a hot node stay where they are; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MOST_ROUNDS = 40
#: A node is hot with more links than this, and than one in MOST_HOT of all link ends.
HOT, MOST_HOT = 100_000, 10_000


def with_group(df: DataFrame, group: DataFrame, ends: int) -> DataFrame:
    """df with m of its node a in group (a, n, m). ends: the sum of n."""
    if ends <= HOT:
        return df.join(group.select("a", "m"), "a")
    hot = group.where(F.col("n") > max(HOT, ends // MOST_HOT)).select("a", F.col("m").alias("hot_m"))
    cold = group.where(F.col("n") <= max(HOT, ends // MOST_HOT)).select("a", "m")
    found = df.join(F.broadcast(hot), "a", "left")  # at most MOST_HOT rows
    # Rows of hot nodes have their m; the others are shuffled to theirs.
    return found.where("hot_m is not null").withColumnRenamed("hot_m", "m").unionByName(found.where("hot_m is null").drop("hot_m").join(cold, "a"))


def _both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label for every node of links (a, b): label is the least node that can be reached."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    before, n = None, edges.count()
    for k in range(1, MOST_ROUNDS + 1):
        both = _both_ways(edges)
        least = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("m"))
        large = with_group(both.where("b > a"), least, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        small = with_group(large, low, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = scratch.save(small.distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        edges = after
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    # Settled: every node but a component's least links to that least node.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
