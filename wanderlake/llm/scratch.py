"""Intermediate tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is
missing and Spark runs within one process, a temporary folder of this machine is taken; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.gettempdir() + "/wanderlake-scratch"


class Scratch:
    """Named Parquet tables of one query run; a lost executor rereads them instead of recomputing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/wanderlake/{uuid.uuid4().hex}"
        atexit.register(self._drop_quietly)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _drop_quietly(self) -> None:
        # At interpreter exit the session may already be stopped; then the files simply stay.
        if self.spark._sc._jsc is not None:
            try:
                self.drop()
            except Exception:
                pass
