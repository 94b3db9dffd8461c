"""Canary buckets and drift windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollout_bucket(token: Column, buckets: int = 10_000) -> Column:
    """A stable bucket of the token: the first eight hex digits of its SHA-256, modulo the number of buckets."""
    return F.conv(F.substr(F.sha2(token.cast("string"), 256), F.lit(1), F.lit(8)), 16, 10).cast("long") % buckets


def drift_alerts(events: DataFrame, key: str, order: list[str], kind: str, reference: int = 100, window: int = 50, least_shift: float = 0.2) -> DataFrame:
    """For each key: windows of ``window`` rows after the first ``reference`` rows, the largest change of a kind's share against these, and alert after two such windows in a row."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    e = events.select(key, F.col(kind).alias("kind"), n.alias("n")).withColumn("block", F.when(F.col("n") < reference, -1).otherwise(F.floor((F.col("n") - reference) / window)))
    counts = e.groupBy(key, "block", "kind").agg(F.count("*").alias("c"))
    share = counts.withColumns({"size": F.sum("c").over(Window.partitionBy(key, "block"))}).withColumn("share", F.col("c") / F.col("size"))
    base = share.where("block = -1").select(key, "kind", F.col("share").alias("base"))
    blocks = share.where((F.col("block") >= 0) & (F.col("size") == window))
    grid = blocks.select(key, "block").distinct().join(share.select(key, "kind").distinct(), key)
    shift = F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("base", F.lit(0.0)))
    per = grid.join(blocks, [key, "block", "kind"], "left").join(base, [key, "kind"], "left").groupBy(key, "block").agg(F.max(shift).alias("shift"))
    shifted = F.col("shift") >= least_shift
    w = Window.partitionBy(key).orderBy("block")
    return per.withColumn("alert", shifted & F.coalesce(F.lag(shifted).over(w), F.lit(False)))
