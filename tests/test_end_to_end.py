"""From raw scans and inertial samples to a trajectory table, on a synthetic recording with known truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import lie
from tessera.operators import calibration as cal
from tessera.operators import points as pt
from tessera.operators import tiles as tl
from tessera.plans import gnss, odometry
from tessera.schemas import LIDAR, ODOMETRY
from tessera.sources import sinks

CFG = EngineConfig(extrinsic_r=(1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0), extrinsic_t=(0.0, 0, 0), leaf_scan=0.4, leaf_map=0.4, point_step=1, min_dist=0.5, max_dist=60.0)
STILL, STEP, SCANS, SPEED, RADIUS = 1.0, 0.1, 30, 0.7, 2.0
HALF = np.array([5.0, 7.0, 2.0])  # of the room: about five points of a scan within a metre of each other


def truth(t):
    """Position and heading: a second of rest, then a circle that is entered smoothly."""
    s = max(0.0, t - STILL)
    a = SPEED / RADIUS * (s - (1 - np.exp(-2 * s)) / 2)
    return np.array([RADIUS * np.sin(a), RADIUS * (1 - np.cos(a)), 0.0]), a


def room(rng):
    """Walls, floor and ceiling of a box as points with two centimetres of noise."""
    u = rng.uniform(-1, 1, (9000, 3)) * HALF
    axis, side = rng.integers(0, 3, 9000), rng.choice([-1.0, 1.0], 9000)
    u[np.arange(9000), axis] = side * HALF[axis]
    return u + rng.normal(size=u.shape) * 0.02


def recording():
    rng = np.random.default_rng(4)
    walls, scans, samples = room(rng), [], []
    for i in range(SCANS):
        t0, points = i * STEP, []
        for j, k in enumerate(rng.choice(len(walls), 700, replace=False)):
            t = t0 + 0.09 * j / 700
            p, a = truth(t)
            local = lie.exp(np.array([0, 0, a])).T @ (walls[k] - p)
            points.append((*map(float, local), 1.0, t, 0))
        scans.append((1.0 + t0, t0, points))
    h = 1e-3
    for t in np.arange(-0.5, SCANS * STEP, 0.005):
        (p0, _), (p1, a1), (p2, _) = truth(t - h), truth(t), truth(t + h)
        acc = lie.exp(np.array([0, 0, a1])).T @ ((p0 - 2 * p1 + p2) / h**2 + np.array([0, 0, 9.81]))
        samples.append((float(t), *map(float, acc), 0.0, 0.0, float((truth(t + h)[1] - truth(t - h)[1]) / (2 * h))))
    return scans, samples


def test_recording_to_trajectory(spark, tmp_path):
    scans, samples = recording()
    lidar = spark.createDataFrame(scans, LIDAR)
    points = pt.decode(lidar, cfg=CFG).select(F.lit(1).alias("rec"), "scan_id", "t", F.col("time").cast("double").alias("time"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    imu = spark.createDataFrame(samples, "imu_t double, imu_ax double, imu_ay double, imu_az double, imu_gx double, imu_gy double, imu_gz double").withColumn("rec", F.lit(1))
    both = points.unionByName(imu, allowMissingColumns=True)
    cfg = CFG
    sinks.write_odometry(both.groupBy("rec").applyInPandas(lambda pdf: odometry.track(pdf, cfg), ODOMETRY), str(tmp_path / "odometry"))
    got = sinks.read_trajectory(spark, str(tmp_path / "odometry")).collect()
    assert len(got) == SCANS - 1 and [r.t for r in got] == sorted(r.t for r in got)  # the first scan is the start
    for r in got:
        p, a = truth(r.t + 0.09)
        yaw = 2 * np.arctan2(r.qz, r.qw)
        assert np.abs(np.array([r.px, r.py, r.pz]) - p).max() < 0.05 and abs(np.angle(np.exp(1j * (yaw - a)))) < 0.01
        cov = np.array(r.cov).reshape(6, 6)
        assert np.allclose(cov, cov.T) and (np.linalg.eigvalsh(cov) > 0).all()
    # Positions of a satellite frame that is turned by 0.4 give that turn back.
    turned = [(r.scan_id, *map(float, lie.exp(np.array([0, 0, -0.4])) @ np.array([r.px, r.py, r.pz]))) for r in got]
    fixes = spark.createDataFrame(turned, "scan_id long, east double, north double, up double")
    assert abs(gnss.solve_yaw(gnss.paired(fixes, spark.read.parquet(str(tmp_path / "odometry")), ["scan_id"])) - 0.4) < 0.01


def test_neighbours_in_cells_equal_brute_force():
    rng = np.random.default_rng(2)
    points, cloud = rng.normal(size=(80, 3)) * 2, rng.normal(size=(500, 3)) * 2
    at, near = odometry.nearest_in_cells(points, cloud, 0.9, 5)
    want = {}
    for i, p in enumerate(points):
        d2 = ((cloud - p) ** 2).sum(axis=1)
        order = np.argsort(d2, kind="stable")[:5]
        if d2[order[-1]] <= 0.81:
            want[i] = order.tolist()
    assert {int(i): n.tolist() for i, n in zip(at, near, strict=True)} == want and want


def test_running_fold_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=50).tolist()
    r = spark.createDataFrame([(x,)], "x array<double>").select(cal.running_fold(F.col("x")).alias("f")).first().f
    assert (r.n, round(r["mean"], 9), round(r["var"], 9)) == (50, round(float(np.mean(x)), 9), round(float(np.var(x)), 9))


def test_required_tiles_patches_clouds_and_maps(spark, tmp_path):
    names = spark.createDataFrame([(f"tile_x_{x}_y_0.las",) for x in (50, 0, 100)], "filename string")
    tiles = tl.catalog(names)
    assert [r.tile_x for r in tl.required(names.limit(3), tiles).collect()] == [0, 100, 50]
    with pytest.raises(Exception, match="no such tile"):
        tl.required(spark.createDataFrame([("tile_x_7_y_7.las",)], "filename string"), tiles).collect()
    cloud = spark.createDataFrame([(i % 3, float(4000 * (i % 2)), float(i), 0.0, 0.0) for i in range(30)], "scan_id long, t double, x double, y double, z double")
    sinks.write_cloud(cloud, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("slice=*")) == ["slice=0", "slice=1"] and spark.read.parquet(str(tmp_path / "c")).count() == 30
    assert sinks.write_map(cloud, str(tmp_path / "m"), 3).count() == 30
    assert {(r.tile_x, r.n) for r in pt.patches(cloud, 10.0, 10).collect()} == {(0, 10), (1, 10), (2, 10)}


def test_pose_records_compare_and_print(spark):
    one = [F.lit(v) for v in (1.0, 2.0, 3.0)]
    rec = pt.pose_record(F.lit(0.5), one, one, one, one, [F.lit(float(k)) for k in range(9)])
    r = spark.range(1).select((rec == rec).alias("same"), F.to_json(rec).alias("text")).first()
    assert r.same and '"offset_time":0.5' in r.text


def test_rigid_motions():
    a, b = (lie.exp(np.array([0.1, 0.2, 0.3])), np.array([1.0, 2, 3])), (lie.exp(np.array([-0.3, 0.1, 0.2])), np.array([0.5, 0, 1]))
    r, t = lie.compose(lie.inverse(a), lie.compose(a, b))
    assert np.allclose(r, b[0]) and np.allclose(t, b[1])
    assert np.allclose(lie.euler(lie.exp(np.array([0, 0, 0.7]))), [0, 0, 0.7]) and np.allclose(lie.euler(lie.exp(np.array([0.3, 0, 0]))), [0.3, 0, 0])
