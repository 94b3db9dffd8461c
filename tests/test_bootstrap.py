"""Resampling against its definition and against plain samples."""

import math
import statistics

from pyspark.sql import functions as F

from wanderlake.operators import bootstrap


def test_counts_are_poisson_with_mean_one(spark):
    rows = spark.range(4000).withColumn("v", F.col("id").cast("double"))
    drawn = bootstrap.with_uniforms(rows, F.col("id"), 20, 3).withColumn("w", bootstrap.poisson(F.col("u")))
    got = {r.w: r["count"] for r in drawn.groupBy("w").count().collect()}
    n = sum(got.values())
    assert n == 80_000 and max(got) < 9
    for k in range(5):
        assert abs(got[k] / n - math.exp(-1) / math.factorial(k)) < 0.006
    assert drawn.groupBy("r").count().count() == 20
    again = bootstrap.with_uniforms(rows.repartition(7), F.col("id"), 20, 3)
    assert again.agg(F.sum("u").cast("decimal(20,6)")).first() == drawn.agg(F.sum("u").cast("decimal(20,6)")).first()


def test_spread_of_means_is_the_standard_error(spark):
    values = [((i * 37) % 101) / 10 for i in range(400)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 2.0), ("c", 0, None)], "g string, i int, v double")
    got = {r.g: r for r in bootstrap.bootstrap_means(df, "g", ["i"], "v", 400, 5).collect()}
    se = statistics.pstdev(values) / math.sqrt(len(values))
    assert abs((got["a"].high - got["a"].low) / (2 * 1.96 * se) - 1) < 0.2 and got["a"].n == 400
    assert got["b"].low == got["b"].high == 2.0 and got["c"].low is None


def test_equal_days_of_both_sides(spark):
    rows = [(1, d, d % 7 < 5, 1.0) for d in range(20)] + [(2, d, d % 7 < 5, 3.0) for d in range(9)] + [(3, d, True, 0.0) for d in range(5)] + [(4, 0, False, 0.0)]
    days = spark.createDataFrame(rows, "user_id long, d int, workday boolean, v double")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 2, 1), (12, 3, 4), (13, 1, 99)], "pair long, candidate long, control long")
    sides = bootstrap.sides_of_pairs(days, pairs, "user_id")
    chosen = bootstrap.equalized(sides, "workday", F.concat_ws("|", "pair", "is_candidate", "d"), 9, 1).collect()
    seen = {}
    for r in chosen:
        seen.setdefault((r.pair, r.r, r.workday), {}).setdefault(r.is_candidate, set()).add(r.d)
    assert {k[0] for k in seen} == {10, 11} and {k[1] for k in seen} == set(range(9))
    assert all(len(x[True]) == len(x[False]) for x in seen.values())
    assert len({frozenset(x[True]) for (p, _, w), x in seen.items() if p == 10 and w}) > 1
    got = {(r.pair, r.metric): r for r in bootstrap.paired_bootstrap(days, pairs, "workday", ["d"], ["v"], 9, 1).collect()}
    assert got[10, "v"].median == -2.0 and got[11, "v"].over_zero == 1.0 and len(got) == 2


def test_equal_hours_of_both_sides(spark):
    rows = [(1, i, 3600.0, 36_000.0, True, False) for i in range(8)] + [(2, i, 5000.0, 5000.0, False, True) for i in range(3)] + [(3, 0, 60.0, 1.0, True, False), (2, 9, 0.0, 7.0, True, True)]
    s = spark.createDataFrame(rows, "user_id long, i int, duration_s double, distance_m double, motorized boolean, active boolean")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "pair long, candidate long, control long")
    got = {(r.pair, r.metric): r for r in bootstrap.transport_bootstrap(s, pairs, ["i"], 12, 2, 1.0).collect()}
    assert {p for p, _ in got} == {1} and all(r.replicates == 12 for r in got.values())
    assert abs(got[1, "distance_km_per_hour"].median - (36.0 - 3.6)) < 1e-9
    assert got[1, "motorized_distance_share"].low == 1.0 and got[1, "active_distance_share"].high == -1.0


def test_equal_sides_differ_by_exactly_zero(spark):
    """Both sides hold the same segments, so a replicate takes all of them, added in orders of their own."""
    parts = [(i, 600.0 + 0.1 * i, 100.0 / (i + 3), i % 3 == 0, i % 5 == 0) for i in range(60)]
    s = spark.createDataFrame([(u, *p) for u in (2, 3) for p in parts], "user_id long, i int, duration_s double, distance_m double, motorized boolean, active boolean")
    pairs = spark.createDataFrame([(2, 2, 3)], "pair long, candidate long, control long")
    for r in bootstrap.transport_bootstrap(s, pairs, ["i"], 20, 7, 1.0).collect():
        assert (r.low, r.median, r.high, r.over_zero) == (0.0, 0.0, 0.0, 0.0)
