"""Registered queries of archives: points are packed into ZIP archives by Spark and read back through the source, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archives
from ..sources.shared import shared_folder
from ..sources.trajectories import points, table
from .queries import VISITS, query

#: One trajectory a user and day.
_FILES = VISITS + """,
pt as (select user_id, event_id, ts + to_seconds(k * 300) as ts, 39.90 + 0.01 * (user_id % 50) + 0.005 * place + 0.00005 * (event_id % 3 - 1) as lat, 116.40 + 0.004 * place as lon
  from (select *, unnest(range(6)) as k from v)),
fl as (select cast(user_id as varchar) as user_id, strftime(ts, '%Y%m%d') || '.plt' as trajectory_id, date_trunc('second', ts) as ts, lat, lon from pt)
"""


def packed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of archives that hold all points, a member a user and day."""
    p = points(table(spark, sf_dir, "events"))
    number = lambda c: F.format_string("%.6f", F.col(c))
    line = F.concat_ws(",", number("lat"), number("lon"), F.lit("0"), F.lit("0"), F.lit("0"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    member = F.concat(F.lit("Data/"), F.col("user_id").cast("string"), F.lit("/Trajectory/"), F.date_format("ts", "yyyyMMdd"), F.lit(".plt"))
    rows = p.select(member.alias("member"), F.struct(F.lit(1).alias("part"), F.col("ts"), F.col("event_id")).alias("place"), line.alias("value"))
    heads = rows.select("member").distinct().withColumn("value", F.lit("\n".join(f"header {i}" for i in range(1, 7))))
    none = F.struct(F.lit(0).alias("part"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id"))
    uri = shared_folder(spark, "archives")
    archives.write_zip(rows.unionByName(heads.select("member", none.alias("place"), "value")), uri).count()
    return uri


@query(_FILES + """select user_id, trajectory_id, count(*) as points, count(*) as valid_points, 0::bigint as untimed, count(distinct ts) as different_times, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts,
  round(min(lat), 6) as south, round(max(lat), 6) as north, round(min(lon), 6) as west, round(max(lon), 6) as east from fl group by user_id, trajectory_id""")
def archived_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.summarize_trajectories(archives.read_zip_points(spark, packed(spark, sf_dir), range_bytes=1 << 20))


@query(_FILES + "select user_id, count(distinct trajectory_id) as members, sum(bytes)::bigint as size from (select user_id, trajectory_id, 54 + sum(28 + len(printf('%.6f', lat)) + len(printf('%.6f', lon)))::bigint as bytes from fl group by user_id, trajectory_id) group by user_id")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.member_inventory(spark, packed(spark, sf_dir), ".plt").groupBy("user_id").agg(F.count("*").alias("members"), F.sum("size").alias("size"))
