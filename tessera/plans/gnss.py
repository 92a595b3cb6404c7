"""Satellite positions as a trajectory: origin, local frame, yaw of that frame against the filter's."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo, lie
from tessera.operators import calibration as cal


def origins(fixes: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """key, lat0, lon0, alt0: mean of the first n fixes, each axis weighted by its inverse variance (var_e, var_n, var_u)."""
    first = cal.first_n(fixes, key, order, n)
    mean = lambda c, v: cal.weighted_mean(F.col(c), F.col(v))
    return first.groupBy(key).agg(mean("lat", "var_e").alias("lat0"), mean("lon", "var_n").alias("lon0"), mean("alt", "var_u").alias("alt0"))


def positions(fixes: DataFrame, key: str, order: list[str], n: int = 10, limit: float = 10_000.0, strict_xyz: bool = True) -> DataFrame:
    """Fixes with east, north, up from their recording's origin; those beyond the limit go (on x alone unless strict)."""
    d = fixes.join(origins(fixes, key, order, n), key)
    e, nn, u = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), F.col("lat0"), F.col("lon0"), F.col("alt0"))
    d = d.withColumns({"east": e, "north": nn, "up": u})
    keep = F.abs("east") <= limit
    if strict_xyz:
        keep = keep & (F.abs("north") <= limit) & (F.abs("up") <= limit)
    return d.filter(keep)


def paired(fixes: DataFrame, poses: DataFrame, by: list[str]) -> DataFrame:
    """Satellite positions (east, north, up) beside the filter's (mx, my, mz) of the same scans."""
    m = poses.select(*by, F.col("px").alias("mx"), F.col("py").alias("my"), F.col("pz").alias("mz"))
    return fixes.join(m, by)


def calibration_pairs(pairs: DataFrame, key: str, order: list[str], start: float = 0.5, distance: float = 30.0) -> DataFrame:
    """Pairs (mx, my, mz; east, north, up) from the first movement until the calibration distance is reached, that row included."""
    m = [F.col(c) for c in ("mx", "my", "mz")]
    moving = pairs.filter(F.sqrt(m[0] * m[0] + m[1] * m[1] + m[2] * m[2]) > start)
    far = F.when(F.sqrt(m[0] * m[0] + m[1] * m[1]) > distance, 1).otherwise(0)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = moving.withColumn("_far", far).withColumn("_done", F.coalesce(F.sum("_far").over(before), F.lit(0)))
    return done.filter("_done = 0").drop("_far", "_done")


def solve_yaw(pairs: DataFrame) -> float | None:
    """Yaw that turns the satellite frame into the filter's: alignment over all pairs, roll and pitch dropped."""
    a, b = ("east", "north", "up"), ("mx", "my", "mz")
    row = cal.alignment_moments(pairs, a, b).first()
    if row["n"] < 3:
        return None
    cov = np.array([[row[f"cov_{p}_{q}"] for q in b] for p in a])
    r, _ = cal.kabsch(np.array([row[f"mean_{p}"] for p in a]), np.array([row[f"mean_{q}"] for q in b]), cov)
    return lie.yaw(r)


def world(d: DataFrame, yaw: float) -> DataFrame:
    """Adds wx, wy, wz (position in the filter's frame) and the heading's rotation (r00, r01, r10, r11) from the track."""
    c, s = math.cos(yaw), math.sin(yaw)
    m = geo.yaw_matrix(F.col("track")) if "track" in d.columns else tuple(F.lit(v) for v in (c, -s, s, c))
    cols: dict[str, Column] = {"wx": c * F.col("east") - s * F.col("north"), "wy": s * F.col("east") + c * F.col("north"), "wz": F.col("up")}
    return d.withColumns(cols | dict(zip(("r00", "r01", "r10", "r11"), m, strict=True)))
