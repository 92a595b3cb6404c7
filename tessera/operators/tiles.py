"""The tiled prior map: catalogue, nearest tiles, refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = r"^tile_x_(\d+)_y_(\d+)\.las$"


def catalog(names: DataFrame, name: str = "filename", size: float = 50.0) -> DataFrame:
    """Tiles of file names that fit the pattern, with their corner and centre."""
    x, y = (F.regexp_extract(name, NAME, i).cast("int") for i in (1, 2))
    t = names.filter(F.col(name).rlike(NAME)).withColumns({"tile_x": x, "tile_y": y})
    return t.withColumns({"cx": F.col("tile_x") + size / 2, "cy": F.col("tile_y") + size / 2})


def file_name(cx: str = "cx", cy: str = "cy", size: float = 50.0):
    return F.format_string("tile_x_%d_y_%d.las", (F.col(cx) - size / 2).cast("int"), (F.col(cy) - size / 2).cast("int"))


def nearest(tiles: DataFrame, east: float, north: float, k: int, within: float, name: str = "filename") -> DataFrame:
    """The k tiles whose centres are nearest, strictly within a distance; ties by name."""
    d2 = (F.col("cx") - east) * (F.col("cx") - east) + (F.col("cy") - north) * (F.col("cy") - north)
    return tiles.withColumn("d2", d2).filter(F.col("d2") < within * within).orderBy("d2", name).limit(k)


def required(names: DataFrame, tiles: DataFrame, name: str = "filename") -> DataFrame:
    """The tiles of all asked names, in order of names; a name that the catalogue lacks raises an error when it is read."""
    known = tiles.withColumn("_known", F.lit(True))
    found = names.select(name).distinct().join(known, name, "left")
    sure = F.when(F.col("_known"), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no such tile: "), F.col(name))).cast("string"))
    return found.withColumn(name, sure).drop("_known").orderBy(name)


def fresh(tiles: DataFrame, recent: DataFrame, name: str = "filename") -> DataFrame:
    """Tiles that are not among the recent ones."""
    return tiles.join(recent.select(name).distinct(), name, "left_anti")
