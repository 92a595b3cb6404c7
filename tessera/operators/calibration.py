"""Small statistics of streams: weighted means, medians, running moments, rigid alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, variance: Column) -> Column:
    """Mean weighted by inverse variances."""
    return F.sum(value / variance) / F.sum(1 / variance)


def first_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def running_stats(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds run_n, run_mean and run_var (population) up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"run_n": F.count(value).over(w), "run_mean": F.avg(value).over(w), "run_var": F.var_pop(value).over(w)})


def running_fold(values: Column) -> Column:
    """Mean and variance of an ordered array by the recurrences m += (x - m) / n and v = v (n - 1) / n + (x - m)(x - m') / n; m' is the mean before.

    An aggregate of the array in the order that it has: exact where the result depends on the order.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["var"] * (n - 1) / n + (x - mean) * (x - s["mean"]) / n).alias("var"))

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), zero, step)


def median_by_norm(df: DataFrame, key: str, xyz: tuple[str, str, str], tie: str) -> DataFrame:
    """Vector of middle norm of each key; the mean of the two middle vectors where their number is even."""
    n2 = sum((F.col(c) * F.col(c) for c in xyz[1:]), F.col(xyz[0]) * F.col(xyz[0]))
    w = Window.partitionBy(key)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(n2, tie))).withColumn("_n", F.count("*").over(w))
    mid = ranked.filter((2 * F.col("_r") >= F.col("_n")) & (2 * F.col("_r") <= F.col("_n") + 2) & ((F.col("_n") % 2 == 0) | (2 * F.col("_r") == F.col("_n") + 1)))
    return mid.groupBy(key).agg(*[F.avg(c).alias(c) for c in xyz])


def alignment_moments(pairs: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Means and cross-covariances of paired points in one aggregation: all that a rigid alignment needs."""
    cols = [F.avg(c).alias(f"mean_{c}") for c in (*a, *b)] + [F.covar_pop(p, q).alias(f"cov_{p}_{q}") for p in a for q in b]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *cols)


def kabsch(mean_a: np.ndarray, mean_b: np.ndarray, cov_ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation with b = R a + t, reflections excluded."""
    u, _, vt = np.linalg.svd(cov_ab)
    v = vt.T
    if np.linalg.det(v @ u.T) < 0:
        v[:, 2] = -v[:, 2]
    r = v @ u.T
    return r, mean_b - r @ mean_a


def balance(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds balance: the largest count over this one, at least 1."""
    return counts.withColumn("balance", F.greatest(F.max(n).over(Window.partitionBy(F.lit(1))) / F.col(n), F.lit(1.0)))
