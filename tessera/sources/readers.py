"""Sources: sensor tables with explicit schemas, topic streams, and LAS tiles."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas

_DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_lidar_decoder(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a sensor type: fn turns a table of its messages into points."""
    _DECODERS[name] = fn


def lidar_decoder(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in _DECODERS:
        raise KeyError(f"no decoder for {name}; there are {sorted(_DECODERS)}")
    return _DECODERS[name]


def recordings(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """All files of a folder whose names match a glob, in one table; order is a column, not a property of files."""
    return spark.read.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def lidar(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    return recordings(spark, path, schemas.LIDAR, pattern)


def imu(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    return recordings(spark, path, schemas.IMU, pattern)


def gnss(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Fixes with status 0 and finite positions."""
    return clean_fixes(recordings(spark, path, schemas.GNSS, pattern))


def clean_fixes(df: DataFrame) -> DataFrame:
    return df.filter((F.col("status") == 0) & ~F.isnan(F.col("lat") + F.col("lon") + F.col("alt")))


def demultiplex(messages: DataFrame, topics: list[str], topic: str = "topic") -> dict[str, DataFrame]:
    """One table per topic; with files partitioned by topic only that partition is read."""
    return {t: messages.filter(F.col(topic) == t) for t in topics}


def parse_las(raw: bytes) -> np.ndarray:
    """x, y, z of all records of a LAS file (public format, versions 1.0 to 1.4)."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, start, size = raw[25], struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<H", raw, 105)[0]
    n = struct.unpack_from("<I", raw, 107)[0]
    if minor >= 4 and n == 0:
        n = struct.unpack_from("<Q", raw, 247)[0]
    scale, offset = np.array(struct.unpack_from("<3d", raw, 131)), np.array(struct.unpack_from("<3d", raw, 155))
    rec = np.frombuffer(raw, np.uint8, n * size, start).reshape(n, size)[:, :12].copy().view("<i4")
    return rec * scale + offset


def las_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Points of all tiles of a folder: tile_x, tile_y, x, y, z.  Any store that Spark reads; one file per task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tile_x_*_y_*.las").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for part in parts:
            for name, raw in zip(part["path"], part["content"], strict=True):
                m = re.search(r"tile_x_(\d+)_y_(\d+)\.las$", name)
                if m:
                    xyz = parse_las(bytes(raw))
                    yield pd.DataFrame({"tile_x": np.int32(m[1]), "tile_y": np.int32(m[2]), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return files.select("path", "content").mapInPandas(run, schemas.TILE_POINTS)
