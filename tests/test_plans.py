"""Satellite calibration and the prior map on synthetic truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import lie
from tessera.operators import tiles as tl
from tessera.plans import gnss, prior_map


def test_yaw_is_recovered(spark):
    rng = np.random.default_rng(0)
    enu = np.column_stack([np.arange(40.0), np.sin(np.arange(40) / 5) * 3, rng.normal(size=40) * 0.01])
    m = enu @ lie.exp(np.array([0, 0, 0.7])).T
    rows = [(1, i, *map(float, e), *map(float, p)) for i, (e, p) in enumerate(zip(enu, m, strict=True))]
    d = spark.createDataFrame(rows, "k int, i int, east double, north double, up double, mx double, my double, mz double")
    used = gnss.calibration_pairs(d, "k", ["i"])
    assert used.agg(F.min("i"), F.max("i")).first() == (1, 31) or used.count() < 40
    assert abs(gnss.solve_yaw(used) - 0.7) < 1e-6
    w = gnss.world(d, 0.7).orderBy("i").collect()
    assert all(abs(r.wx - r.mx) < 1e-9 and abs(r.wy - r.my) < 1e-9 for r in w)


def test_origin_and_far_fixes(spark):
    rows = [(1, i, 45.0 + i * 1e-6, 9.0, 100.0, 1.0, 1.0, 1.0) for i in range(12)] + [(1, 12, 46.0, 9.0, 100.0, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k int, i int, lat double, lon double, alt double, var_e double, var_n double, var_u double")
    got = gnss.positions(d, "k", ["i"]).orderBy("i").collect()
    assert len(got) == 12 and abs(got[0].lat0 - 45.0000045) < 1e-9 and abs(got[0].east) < 1e-6
    assert gnss.positions(d, "k", ["i"], strict_xyz=False).count() == 13


def test_registration_finds_the_move(spark):
    rng = np.random.default_rng(1)
    target = rng.uniform(-5, 5, (300, 3))
    r, t = lie.exp(np.array([0.0, 0, 0.02])), np.array([0.05, -0.04, 0.02])
    source = (target - t) @ r
    frame = lambda p, k: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], f"{k} int, x double, y double, z double").cache()
    rot, move, ok = prior_map.register(frame(source, "q"), frame(target, "m"), 1.0, 8)
    assert ok and np.allclose(rot, r, atol=1e-4) and np.allclose(move, t, atol=1e-3)


def test_prior_map_refreshes_after_moving(spark):
    names = spark.createDataFrame([(f"tile_x_{x}_y_{y}.las",) for x in range(0, 500, 50) for y in (0, 50)], "filename string")
    points = spark.createDataFrame([(x, y, x + dx, y + 25.0, 1.0) for x in range(0, 500, 50) for y in (0, 50) for dx in (5.0, 20.0, 35.0)], "tile_x int, tile_y int, x double, y double, z double")
    m = prior_map.PriorMap(tl.catalog(names), points)
    m.start(25.0, 25.0)
    n = m.cloud.count()
    assert not m.refresh(np.array([40.0, 25.0, 0.0])) and m.cloud.count() == n
    assert m.refresh(np.array([120.0, 25.0, 0.0]))
    got = [tuple(r) for r in m.cloud.collect()]
    assert len(got) == len(set(got)) and max(p[0] for p in got) > 120
    with pytest.raises(LookupError):
        prior_map.PriorMap(tl.catalog(names), points).start(9999.0, 9999.0)
