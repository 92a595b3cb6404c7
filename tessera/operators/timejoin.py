"""Joins and windows over time: intervals, as-of, nearest fixes, neighbours, epochs.

As-of joins are a union of both sides and one ordered window; nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_sync(ends: DataFrame, samples: DataFrame, key: str, t: str = "t", scan: str = "scan_id", tie: str = "id") -> DataFrame:
    """Each sample with the first scan of its key that ends at or after it: samples in (previous end, end]."""
    both = ends.select(key, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.col(scan).alias("_scan"), F.lit(None).cast(samples.schema[tie].dataType).alias("_id")).unionByName(samples.select(key, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(ends.schema[scan].dataType).alias("_scan"), F.col(tie).alias("_id")))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_scan").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("_first", F.first("_scan", ignorenulls=True).over(w)).filter("_side = 0 and _first is not null").select(key, F.col("_id").alias(tie), F.col("_t").alias(t), F.col("_first").alias(scan))


def asof(left: DataFrame, right: DataFrame, key: str, t: str, left_id: str, values: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """Each left row with the values of the latest right row at or before it (strictly before; or the first after)."""
    r = F.struct(*[F.col(v) for v in values])
    side = 1 if strict != forward else 0
    both = left.select(key, F.col(t).alias("_t"), F.lit(1 - side).alias("_side"), F.col(left_id).alias("_id"), F.lit(None).cast(right.select(r.alias("r")).schema["r"].dataType).alias("_r")).unionByName(right.select(key, F.col(t).alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), r.alias("_r")))
    w = Window.partitionBy(key).orderBy("_t", "_side")
    pick = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_m", pick).filter(F.col("_id").isNotNull()).select(key, F.col("_id").alias(left_id), F.col("_t").alias(t), "_m.*")


def nearest_fix(scans: DataFrame, fixes: DataFrame, key: str, t: str, scan: str, fix: str) -> DataFrame:
    """The first fix after a scan's end if there is one, else the last before it."""
    named = fixes.withColumn("_ft", F.col(t)).withColumnRenamed(fix, "_fix")
    after = asof(scans, named, key, t, scan, ["_fix", "_ft"], forward=True).withColumnsRenamed({"_fix": "_fa", "_ft": "_ta"})
    before = asof(scans, named, key, t, scan, ["_fix", "_ft"]).drop(t).withColumnsRenamed({"_fix": "_fb", "_ft": "_tb"})
    return after.join(before, [key, scan]).select(key, scan, t, F.coalesce("_fa", "_fb").alias(fix), F.coalesce("_ta", "_tb").alias("fix_t"))


def pairs(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Adds prev_<value> of the row before; the first row of a key goes."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values})
    return out.filter(F.col(f"prev_{values[0]}").isNotNull())


def epochs(df: DataFrame, key: str, order: list[str], t: str) -> DataFrame:
    """Adds epoch: the number of times that time went backwards so far, in order of arrival."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_back", F.when(F.col(t) < F.lag(t).over(w), 1).otherwise(0)).withColumn("epoch", F.sum("_back").over(w)).drop("_back")


def self_sync(lidar_t: Column, imu_t: Column, gap: float = 1.0, lead: float = 0.1) -> Column:
    """Clock shift to add to inertial stamps when they lag the scans by more than `gap`."""
    return F.when(F.abs(lidar_t - imu_t) > gap, lidar_t + lead - imu_t).otherwise(0.0)
