"""The folder that driver and executors share, for tables and files between the steps of a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; only where that is unset and Spark is one process, under this machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/wanderlake-{name}/{uuid.uuid4().hex}"


#: Rows that a task is dealt, so that its memory and time stay the same however large the input is.
ROWS_A_TASK = 50_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, a table that is read from files, dealt out by keys into as many parts as its rows need.

    Adaptive execution would join parts up to 64 MB of packed rows, which become many more once they are exploded. Counting reads the files' footers only.
    """
    parts = -(-df.count() // ROWS_A_TASK)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once under the shared folder and read from there, so that each of many readers takes as many tasks as its own rows need."""
    uri = shared_folder(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
