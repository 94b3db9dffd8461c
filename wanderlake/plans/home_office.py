"""The production plan: points, cleaned sequences, stays, locations, evidence, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, evidence, locate, stays
from ..sources.shared import dealt, kept
from ..sources.trajectories import points, table


@dataclass(frozen=True)
class Located:
    """Stays with places (a table in the shared folder, dealt out by user) and a row a place."""

    semantic: DataFrame
    locations: DataFrame

    def release(self) -> None:
        self.semantic.unpersist()


def observations(spark: SparkSession, sf_dir: str, defects: bool = False) -> DataFrame:
    """Points of the events table, dealt out by user in bounded parts."""
    return points(dealt(table(spark, sf_dir, "events"), "user_id"), defects)


def detect(points_df: DataFrame) -> DataFrame:
    return stays.detect_staypoints(clean.clean_trajectory(points_df))


def locate_stays(stays_df: DataFrame, method: str = "complete_link", threshold_m: float = 200.0, zones: DataFrame | None = None) -> Located:
    # Written once, since the kernels behind it are dear and consumers read it many times; a cached table would keep its first number of partitions for each of them.
    semantic = dealt(kept(locate.cluster_stays(locate.with_local_time(stays_df, zones), method, threshold_m), "stays"), "user_id")
    return Located(semantic, locate.summarize_locations(semantic))


def from_events(spark: SparkSession, sf_dir: str) -> Located:
    return locate_stays(detect(observations(spark, sf_dir)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = from_events(spark, sf_dir)
    return evidence.infer_home_office(located.semantic, located.locations)
