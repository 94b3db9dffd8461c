"""Relational pieces that audits are made of: checked keys, outer joins with their side, grids, matching, runs, modes, rank correlation."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing when it is run if a key occurs twice. The check is a window on the keys, so it shares a later join's partitioning."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return df.withColumn("_once", ok).where("_once").drop("_once")


def outer_with_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with side: both, left_only or right_only. Null keys match nothing."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full").withColumn("side", side).drop("_l", "_r")


def with_grid(df: DataFrame, **values: Iterable) -> DataFrame:
    """Every row with every combination of the values: an explode of literal arrays, no join."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return df


def mode_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group and its count; ties go to the least one. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def longest_runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """For each group: rows, changes of the value from row to row, and the length of its longest run of equal values."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    steps = df.withColumn("_new", (first | ~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = steps.groupBy(*by, "_run").agg(F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.sum("n").alias("rows"), (F.count("*") - 1).alias("switches"), F.max("n").alias("longest_run"))


def spearman(df: DataFrame, by: list[str], left: str, right: str, least: int = 3) -> DataFrame:
    """Rank correlation (ties share the mean rank) of each group's complete pairs; null under ``least`` pairs or where one side is constant."""
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    ranked = both.withColumns({"_x": average_rank(F.col(left), by), "_y": average_rank(F.col(right), by)})
    g = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"), F.covar_pop("_x", "_y").alias("_c"))
    rho = F.when((F.col("n") >= least) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_c") / (F.col("_sx") * F.col("_sy")))
    return g.withColumn("rho", rho).drop("_sx", "_sy", "_c")


def set_overlap(left: DataFrame, right: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """For each group: members of both sets, of the left alone (dropped), of the right alone (added), and their Jaccard similarity."""
    sides = outer_with_side(left.select(*by, *keys).distinct(), right.select(*by, *keys).distinct(), [*by, *keys])
    n = lambda s: F.count_if(F.col("side") == s)
    return sides.groupBy(*by).agg(n("both").alias("retained"), n("left_only").alias("dropped"), n("right_only").alias("added"), (n("both") / F.count("*")).alias("jaccard"))


def pairwise_overlap(flags: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For all pairs of flag columns: rows with both, with either, and shares. One pass; as many sums as pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    sums = [x for a, b in pairs for x in (F.count_if(on(a) & on(b)), F.count_if(on(a) | on(b)), F.count_if(on(a)), F.count_if(on(b)))]
    one = flags.agg(F.array(*sums).alias("s"))
    rows = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), *[F.col("s")[4 * i + j].alias(n) for j, n in enumerate(("both", "either", "n_left", "n_right"))]) for i, (a, b) in enumerate(pairs)]
    out = one.select(F.inline(F.array(*rows)))
    return out.withColumns({"jaccard": F.try_divide("both", "either"), "left_share": F.try_divide("both", "n_left"), "right_share": F.try_divide("both", "n_right")})


def greedy_match(candidates: DataFrame, controls: DataFrame, stratum: list[str], key: str, covariates: list[str]) -> DataFrame:
    """One control for each candidate, nearest by covariates in units of their standard deviation over all, none used twice.

    Candidates choose in order of their key, which is sequential; a stratum is one group, so strata bound what meets in a task.
    """
    everyone = candidates.select(*stratum, key, *covariates).unionByName(controls.select(*stratum, key, *covariates))
    scale = everyone.agg(*[F.stddev_pop(c).alias(c) for c in covariates]).first()
    unit = [float(scale[c]) if scale[c] else 1.0 for c in covariates]

    def run(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(key, kind="stable"), b.sort_values(key, kind="stable")
        x, y = a[covariates].to_numpy(float) / unit, b[covariates].to_numpy(float) / unit
        free, out = np.ones(len(b), bool), []
        for i in range(len(a)):
            if not free.any():
                break
            d = np.where(free, ((y - x[i]) ** 2).sum(axis=1), np.inf)
            j = int(d.argmin())
            free[j] = False
            out.append((a[key].iloc[i], b[key].iloc[j], float(d[j])))
        return pd.DataFrame(out, columns=["candidate", "control", "distance"])

    kind = dict(candidates.dtypes)[key]
    return candidates.groupBy(*stratum).cogroup(controls.groupBy(*stratum)).applyInPandas(run, f"candidate {kind}, control {kind}, distance double")
