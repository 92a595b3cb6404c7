"""Sinks: odometry, clouds and maps as tables, in batch or per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_odometry(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_gnss_poses(df: DataFrame, path: str) -> None:
    """Satellite poses: scan_id, t, position and rotation, one row for each synchronised scan."""
    df.write.mode("append").parquet(path)


def read_trajectory(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """Poses of an odometry or satellite table in order of time."""
    return spark.read.parquet(path).orderBy(*by, "t")


def write_cloud(df: DataFrame, path: str, t: str = "t", span: float = 3600.0) -> None:
    """Points of registered scans, in folders by time (an hour) rather than by scan, sorted by scan within files."""
    slices = df.withColumn("slice", F.floor(F.col(t) / span).cast("bigint"))
    slices.repartition("slice", F.pmod(F.xxhash64("scan_id"), F.lit(16))).sortWithinPartitions("slice", "scan_id").write.mode("append").partitionBy("slice").parquet(path)


def write_map(df: DataFrame, path: str, version: int) -> DataFrame:
    """A version of the local map as a table of its own, read back: the next one builds on files, not on the plans of all before."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return df.sparkSession.read.parquet(f"{path}/version={version}")


def write_tiles(df: DataFrame, path: str) -> None:
    """Map points by tile, so that readers of a few tiles prune the rest."""
    df.repartition("tile_x", "tile_y").write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)


def per_batch(write: Callable[[DataFrame, str], None], path: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch goes to a folder of its own, so that a repeated batch replaces itself."""

    def run(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return run if write is None else (lambda df, batch: write(df, f"{path}/batch={batch}"))
