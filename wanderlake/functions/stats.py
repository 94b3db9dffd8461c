"""Statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def circular_mean_hour(hour: Column) -> Column:
    """Mean hour of the day on the circle, 0 to 24."""
    angle = hour * F.lit(2 * math.pi / 24)
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * F.lit(24 / (2 * math.pi))
    return F.when(mean < 0, mean + 24).otherwise(mean)


def circular_concentration(hour: Column) -> Column:
    """Length of the mean direction: 1 if all hours are one, 0 if they cancel out."""
    angle = hour * F.lit(2 * math.pi / 24)
    return F.hypot(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def hour_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 24
    return F.least(d, 24 - d)


def entropy_term(share: Column) -> Column:
    """-p log2 p, and 0 for p = 0."""
    return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    peers = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(peers) - 1) / 2


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two array columns of weights; null if either sums to 0. The totals are folded once, as 1-element arrays."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.array(F.struct(p.alias("p"), q.alias("q"), total(p).alias("a"), total(q).alias("b")))
    terms = lambda t: F.zip_with(t["p"], t["q"], lambda x, y: (part(x / t["a"], (x / t["a"] + y / t["b"]) / 2) + part(y / t["b"], (x / t["a"] + y / t["b"]) / 2)) / 2)
    return F.transform(both, lambda t: F.when((t["a"] > 0) & (t["b"] > 0), total(terms(t))))[0]
