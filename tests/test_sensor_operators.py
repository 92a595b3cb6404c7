"""Operators against brute force and at their borders."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours as nb
from tessera.operators import points as pt
from tessera.operators import tiles as tl
from tessera.operators import timejoin as tj
from tessera.sources import readers, sinks
from tessera.streaming import replay


def test_range_band_keeps_borders_and_drops_nan(spark):
    d = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 100.0, 0.0, 0.0), (3, 0.49, 0.0, 0.0), (4, 100.1, 0.0, 0.0), (5, float("nan"), 0.0, 0.0), (6, None, 0.0, 0.0)], "id int, x double, y double, z double")
    assert [r.id for r in pt.range_band(d, 0.5, 100.0).orderBy("id").collect()] == [1, 2]


def test_voxel_is_idempotent_on_single_points(spark):
    d = spark.createDataFrame([(float(i), 0.0, 0.0) for i in range(5)], "x double, y double, z double")
    assert sorted(r.x for r in pt.voxel_grid(d, 1.0).collect()) == [0, 1, 2, 3, 4]


def test_interval_sync_takes_each_sample_once(spark):
    ends = spark.createDataFrame([(1, 10.0, 100), (1, 20.0, 200)], "k int, t double, scan_id long")
    s = spark.createDataFrame([(1, float(t), t) for t in (1, 10, 11, 20, 21)], "k int, t double, id int")
    got = {r.id: r.scan_id for r in tj.interval_sync(ends, s, "k").collect()}
    assert got == {1: 100, 10: 100, 11: 200, 20: 200}


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 2), (1, 0.5, 3)], "k int, t double, id int")
    right = spark.createDataFrame([(1, 1.0, 10), (1, 2.0, 20)], "k int, t double, h int")
    got = {r.id: r.h for r in tj.asof(left, right, "k", "t", "id", ["h"], strict=True).collect()}
    assert got == {1: None, 2: 10, 3: None}
    got = {r.id: r.h for r in tj.asof(left, right, "k", "t", "id", ["h"]).collect()}
    assert got == {1: 10, 2: 20, 3: None}


@pytest.mark.parametrize(("fixes", "want"), [([1, 2, 3.5, 5], 3.5), ([1, 2, 2.9, 3.5, 5], 3.5), ([1, 2], 2), ([4, 5], 4), ([2.8, 3.1, 3.3], 3.1)])
def test_nearest_fix_prefers_the_one_after(spark, fixes, want):
    scans = spark.createDataFrame([(1, 3.0, 7)], "k int, t double, scan int")
    f = spark.createDataFrame([(1, float(t), float(t)) for t in fixes], "k int, t double, fix double")
    assert tj.nearest_fix(scans, f, "k", "t", "scan", "fix").first().fix == want


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    q, m = rng.uniform(-2, 2, (60, 3)), rng.uniform(-2, 2, (400, 3))
    scan = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "q int, x double, y double, z double")
    cloud = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], "m int, x double, y double, z double")
    got = {(r.q, r.m) for r in nb.knn(scan, cloud, 5, 1.0).collect()}
    want = set()
    for i, p in enumerate(q):
        d = ((m - p) ** 2).sum(1)
        near = np.argsort(d, kind="stable")[:5]
        if d[near[-1]] <= 1:
            want |= {(i, int(j)) for j in near}
    assert got == want


def test_knn_keeps_distance_one(spark):
    scan = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "q int, x double, y double, z double")
    cloud = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "m int, x double, y double, z double")
    assert nb.knn(scan, cloud, 1, 1.0).count() == 1


def test_planes_match_numpy_and_flat_is_rejected(spark):
    rng = np.random.default_rng(2)
    rows = [(g, *map(float, p)) for g in range(20) for p in rng.normal(size=(5, 3)) * [1, 1, 0.05]]
    rows += [(99, float(x), float(y), 0.0) for x, y in ((0, 0), (0.5, 0), (0, 0.5), (-0.5, 0), (0, -0.5))]
    d = spark.createDataFrame(rows, "g int, x double, y double, z double")
    got = {r.g: r for r in nb.planes(d, ["g"]).collect()}
    for g in range(20):
        p = np.array([r[1:] for r in rows if r[0] == g])
        c = p - p.mean(0)
        w, v = np.linalg.eigh((1e-6 * np.eye(3) + c.T @ c) / 5)
        n = np.array([got[g].nx, got[g].ny, got[g].nz])
        assert abs(got[g].l0 - w[0]) < 1e-9 and abs(abs(n @ v[:, 0]) - 1) < 1e-6
    assert 99 not in {r.g for r in nb.planar(nb.planes(d, ["g"])).collect()}


def test_tiles(spark):
    names = spark.createDataFrame([("tile_x_100_y_50.las",), ("tile_x_-1_y_5.las",), ("a.las",)], "filename string")
    t = tl.catalog(names)
    assert [(r.tile_x, r.cx, r.cy) for r in t.collect()] == [(100, 125.0, 75.0)]
    assert t.select(tl.file_name().alias("n")).first().n == "tile_x_100_y_50.las"
    assert tl.fresh(t, t).count() == 0


def las_bytes(xyz):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<H", head, 105, 20)
    struct.pack_into("<I", head, 107, len(xyz))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10.0, 20.0, 0.0)
    body = b"".join(struct.pack("<3i", *[round((v - o) / 0.01) for v, o in zip(p, (10, 20, 0), strict=True)]) + bytes(8) for p in xyz)
    return bytes(head) + body


def test_las_tiles(spark, tmp_path):
    (tmp_path / "tile_x_100_y_50.las").write_bytes(las_bytes([(101.5, 52.25, 3.0), (102.0, 53.0, -1.0)]))
    (tmp_path / "other.las").write_bytes(b"x")
    got = sorted(tuple(r) for r in readers.las_tiles(spark, str(tmp_path)).collect())
    assert np.allclose(got, [(100, 50, 101.5, 52.25, 3.0), (100, 50, 102.0, 53.0, -1.0)])


def test_motion_gate_in_batch_and_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, i, float(i * 10), 0.0) for i in range(10)], "k long, i long, x double, y double")
    batch = [r.i for r in replay.motion_gate(d, "k", "i", 25.0).orderBy("i").collect()]
    assert batch == [0, 3, 6, 9]
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = replay.replay(spark, str(tmp_path / "in"), d.schema)
    replay.run_available(replay.motion_gate(s, "k", "i", 25.0), sinks.per_batch(sinks.write_odometry, str(tmp_path / "out")), str(tmp_path / "cp"))
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_decode_counts_from_the_first_raw_point(spark):
    p = "array<struct<x:float,y:float,z:float,intensity:float,timestamp:double,ring:int>>"
    d = spark.createDataFrame([(5.0, [(1.0, 0.0, 0.0, 9.0, 100.0, 1), (2.0, 0.0, 0.0, 9.0, 100.5, 2)])], f"t double, points {p}")
    assert [(r.scan_id, r.pt_idx, r.time) for r in pt.decode(d).collect()] == [(1, 0, 0.0), (1, 1, 0.5)]


def test_clean_fixes(spark):
    d = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 1.0, 2.0, 3.0), (0, float("nan"), 2.0, 3.0), (-1, 1.0, 2.0, 3.0)], "status int, lat double, lon double, alt double")
    assert readers.clean_fixes(d).count() == 1


def test_epochs(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate([1.0, 2.0, 1.5, 1.6, 0.1])], "k int, i int, t double")
    assert [r.epoch for r in tj.epochs(d, "k", ["i"], "t").orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_decoder_registry():
    readers.register_lidar_decoder("plain", lambda d: d)
    assert readers.lidar_decoder("plain")(3) == 3
    with pytest.raises(KeyError):
        readers.lidar_decoder("none")


def test_utm_of_a_known_place(spark):
    from tessera.functions import geo

    z, e, n = geo.utm(F.lit(0.0), F.lit(9.0))
    r = spark.range(1).select(z.alias("z"), e.alias("e"), n.alias("n")).first()
    assert r.z == 32 and abs(r.e - 500000) < 1e-3 and abs(r.n) < 1e-3
