"""The registered queries and the SQL that each is held against.

The tables here hold no laser data, so adapters stand in: `points` are the first three elements of
`embeddings` (label: scan), `bulk` is `lineitem`, `streams` are `events` (user: stream; k: second
channel).  Every query reads its whole table through the library's own operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.linalg import huber
from tessera.operators import calibration as cal
from tessera.operators import neighbours as nb
from tessera.operators import points as pt
from tessera.operators import tiles as tl
from tessera.operators import timejoin as tj
from tessera.sources import readers
from tessera.streaming import replay

RADIUS = 0.15


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def streams(spark: SparkSession, sf: str) -> DataFrame:
    ev = read(spark, sf, "events")
    t = F.col("ts").cast("timestamp").cast("double")
    return ev.select("event_id", "user_id", "event_type", t.alias("t"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


_POINTS = "points AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_BULK = "bulk AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"
_STREAMS = "streams AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS t, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)"


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 makes -0.0 plain.  Where means of decimals end in a tie, both sides add a nudge first."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(name) if name else out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# Points: filters, voxels, transforms


@query("stride_sample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 7 = 0")
def stride_sample(spark, sf):
    """every n-th raw index."""
    return pt.stride(read(spark, sf, "lineitem"), 7, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("range_band", f"WITH {_POINTS} SELECT vec_id, round(sqrt(sqrt(x*x + y*y + z*z)), 6) AS intensity FROM points WHERE x*x + y*y + z*z >= 0.01 * 1.0 AND x*x + y*y + z*z <= 0.0625")
def range_band(spark, sf):
    """range band, borders included, and the intensity that is derived from the range."""
    d = pt.range_band(points(spark, sf), 0.1, 0.25)
    return d.select("vec_id", r6(F.sqrt(F.sqrt(pt.squared_range(F.col("x"), F.col("y"), F.col("z")))), "intensity"))


@query("derived_time", f"WITH {_STREAMS} SELECT event_id, round(t - min(t) OVER (PARTITION BY user_id), 3) AS rel FROM streams")
def derived_time(spark, sf):
    """Time since the first row of each stream."""
    from pyspark.sql import Window

    return streams(spark, sf).select("event_id", r6(F.col("t") - F.min("t").over(Window.partitionBy("user_id")), "rel", 3))


@query("crop_box", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_extendedprice BETWEEN 10000 AND 60000 AND l_discount BETWEEN 0.02 AND 0.08")
def crop_box(spark, sf):
    """Box crop; literal bounds reach the scan."""
    d = read(spark, sf, "lineitem").filter(F.col("l_quantity").between(10, 40) & F.col("l_extendedprice").between(10000, 60000) & F.col("l_discount").between(0.02, 0.08))
    return d.select("l_orderkey", "l_linenumber")


@query("voxel_grid", f"WITH {_BULK} SELECT floor(x/10)::BIGINT AS cx, floor(y/10)::BIGINT AS cy, floor(z/4)::BIGINT AS cz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM bulk GROUP BY 1, 2, 3")
def voxel_grid(spark, sf):
    """A1: one centroid per cell."""
    return pt.voxel_grid(bulk(spark, sf), (10.0, 10.0, 4.0)).select("cx", "cy", "cz", *[r6(c, c) for c in "xyz"], "n")


@query("map_union_voxel", f"WITH {_BULK}, a AS (SELECT floor(x/5) cx, floor(y/5) cy, floor(z/2) cz, avg(x) x, avg(y) y, avg(z) z FROM bulk WHERE l_linenumber <= 3 GROUP BY 1, 2, 3), u AS (SELECT x, y, z FROM a UNION ALL SELECT x, y, z FROM bulk WHERE l_linenumber > 3) SELECT floor(x/5)::BIGINT AS cx, floor(y/5)::BIGINT AS cy, floor(z/2)::BIGINT AS cz, round(avg(x) + 3.3e-9, 6) AS x, round(avg(y) + 3.3e-9, 6) AS y, round(avg(z) + 3.3e-9, 6) AS z, count(*) AS n FROM u WHERE x BETWEEN 5 AND 45 AND y BETWEEN 5 AND 65 AND z BETWEEN 0 AND 8 GROUP BY 1, 2, 3")
def map_union_voxel(spark, sf):
    """ST9 (U1, F7, A1): a map step: union, crop, voxels of centroids."""
    b, leaf = bulk(spark, sf), (5.0, 5.0, 2.0)
    old = pt.voxel_grid(b.filter("l_linenumber <= 3"), leaf).select("x", "y", "z")
    both = old.unionByName(b.filter("l_linenumber > 3").select("x", "y", "z"))
    d = pt.voxel_grid(pt.crop_box(both, (25.0, 35.0, 4.0), (20.0, 30.0, 4.0)), leaf)
    return d.select("cx", "cy", "cz", *[r6(F.col(c) + 3.3e-9, c) for c in "xyz"], "n")


_ROT = (math.cos(0.3), -math.sin(0.3), 0.0, math.sin(0.3), math.cos(0.3), 0.0, 0.0, 0.0, 1.0)


@query("rigid_transform", f"WITH {_POINTS} SELECT vec_id, round({_ROT[0]!r}*x + {_ROT[1]!r}*y + 1.5, 6) AS x, round({_ROT[3]!r}*x + {_ROT[4]!r}*y - 2.0, 6) AS y, round(z + 0.25, 6) AS z FROM points")
def rigid_transform(spark, sf):
    """M1-M3: R p + t."""
    return pt.transform(points(spark, sf), _ROT, (1.5, -2.0, 0.25)).select("vec_id", *[r6(c, c) for c in "xyz"])


@query("deskew_expr", f"WITH {_POINTS}, d AS (SELECT *, (vec_id % 10) / 100.0::DOUBLE AS dt FROM points) SELECT vec_id, round(x*cos(0.5*dt) - y*sin(0.5*dt) + 0.1 + 2.0*dt + 0.5*0.3*dt*dt - 0.4, 6) AS x, round(x*sin(0.5*dt) + y*cos(0.5*dt) - 1.0*dt, 6) AS y, round(z + 0.5*0.1*dt*dt, 6) AS z FROM d")
def deskew_expr(spark, sf):
    """M4: motion correction of each point within its scan."""
    lit = lambda *v: tuple(F.lit(x) for x in v)
    d = points(spark, sf).withColumn("dt", (F.col("vec_id") % 10) / 100.0)
    new = pt.deskew((F.col("x"), F.col("y"), F.col("z")), F.col("dt"), lit(0.0, 0.0, 0.5), lit(0.3, 0.0, 0.1), lit(2.0, -1.0, 0.0), lit(0.1, 0.0, 0.0), lit(0.4, 0.0, 0.0))
    return d.select("vec_id", *[r6(c, n) for c, n in zip(new, "xyz", strict=True)])


@query("ground_height", f"WITH {_BULK}, low AS (SELECT z FROM (SELECT l_quantity AS x, l_extendedprice/1000 AS y, l_tax * 100 + l_extendedprice / 1000 AS z FROM lineitem) WHERE (x - 25)*(x - 25) + (y - 30)*(y - 30) < 400 ORDER BY z LIMIT 100) SELECT round(median(z), 6) AS ground_z, count(*) AS n FROM low")
def ground_height(spark, sf):
    """A13 (F9, O4, A12): median of the 100 lowest points within a radius."""
    d = read(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100 + F.col("l_extendedprice") / 1000).alias("z"))
    return pt.ground_height(d, 25.0, 30.0, radius=20.0).select(r6("ground_z", "ground_z"), "n")


# Streams: cleaning and joins over time


@query("status_nan_filter", f"WITH {_STREAMS} SELECT event_id FROM streams WHERE k::INT % 5 = 0 AND NOT isnan(value + k)")
def status_nan_filter(spark, sf):
    """fixes with status 0 and finite positions."""
    d = streams(spark, sf).withColumns({"status": F.col("k").cast("int") % 5, "lat": F.col("value"), "lon": F.col("k"), "alt": F.lit(0.0)})
    return readers.clean_fixes(d).select("event_id")


@query("topic_demux", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1")
def topic_demux(spark, sf):
    """Topics that are read, each as a table of its own."""
    parts = readers.demultiplex(streams(spark, sf), ["click", "purchase", "view"], "event_type")
    out = None
    for d in parts.values():
        d = d.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), "total", 4))
        out = d if out is None else out.unionByName(d)
    return out


@query("interval_sync", f"WITH {_STREAMS}, s AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM streams WHERE event_type = 'purchase') SELECT i.event_id, s.event_id AS scan_id FROM streams i JOIN s ON i.user_id = s.user_id AND i.t <= s.t AND (s.prev IS NULL OR i.t > s.prev) WHERE i.event_type = 'click'")
def interval_sync(spark, sf):
    """J1, ST4: each sample goes to the first scan that ends at or after it."""
    d = streams(spark, sf)
    scans = d.filter("event_type = 'purchase'").withColumnRenamed("event_id", "scan_id")
    return tj.interval_sync(scans, d.filter("event_type = 'click'"), "user_id", tie="event_id").select("event_id", "scan_id")


@query("asof_segment", f"WITH {_STREAMS} SELECT a.event_id, b.event_id AS head_id, round(a.t - b.t, 3) AS dt FROM (SELECT * FROM streams WHERE event_type = 'view') a ASOF LEFT JOIN (SELECT * FROM streams WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.t > b.t")
def asof_segment(spark, sf):
    """The latest segment head strictly before each point."""
    d = streams(spark, sf)
    heads = d.filter("event_type = 'click'").select("user_id", "t", F.col("event_id").alias("head_id"), F.col("t").alias("head_t"))
    out = tj.asof(d.filter("event_type = 'view'"), heads, "user_id", "t", "event_id", ["head_id", "head_t"], strict=True)
    return out.select("event_id", "head_id", r6(F.col("t") - F.col("head_t"), "dt", 3))


@query("nearest_fix", f"WITH {_STREAMS}, s AS (SELECT * FROM streams WHERE event_type = 'purchase'), f AS (SELECT * FROM streams WHERE event_type = 'signup'), a AS (SELECT s.event_id, s.user_id, s.t, f.event_id AS fa FROM s ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.t <= f.t) SELECT a.event_id, coalesce(a.fa, f.event_id) AS fix_id FROM a ASOF LEFT JOIN f ON a.user_id = f.user_id AND a.t >= f.t")
def nearest_fix(spark, sf):
    """The first fix after a scan's end, else the last before it."""
    d = streams(spark, sf)
    fixes = d.filter("event_type = 'signup'").withColumnRenamed("event_id", "fix_id")
    return tj.nearest_fix(d.filter("event_type = 'purchase'"), fixes, "user_id", "t", "event_id", "fix_id").select("event_id", "fix_id")


@query("imu_pairs", f"WITH {_STREAMS} SELECT * FROM (SELECT event_id, round((value + lag(value) OVER w) / 2, 6) AS mid, round(t - lag(t) OVER w, 3) AS dt FROM streams WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE dt IS NOT NULL")
def imu_pairs(spark, sf):
    """Neighbouring samples and their trapezoid means."""
    d = tj.pairs(streams(spark, sf), "user_id", ["t", "event_id"], ["t", "value"])
    return d.select("event_id", r6((F.col("value") + F.col("prev_value")) / 2, "mid"), r6(F.col("t") - F.col("prev_t"), "dt", 3))


@query("regress_epochs", f"WITH {_STREAMS}, b AS (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY event_type ORDER BY event_id) THEN 1 ELSE 0 END AS back FROM streams) SELECT event_id, sum(back) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS epoch FROM b")
def regress_epochs(spark, sf):
    """ST2: a stamp that goes backwards opens a new epoch."""
    return tj.epochs(streams(spark, sf), "event_type", ["event_id"], "t").select("event_id", F.col("epoch").cast("bigint"))


@query("self_sync", f"WITH {_STREAMS}, m AS (SELECT user_id, min(t) FILTER (event_type = 'purchase') AS a, min(t) FILTER (event_type = 'click') AS b FROM streams GROUP BY 1) SELECT user_id, round(CASE WHEN abs(a - b) > 1 THEN a + 0.1 - b ELSE 0 END, 3) AS shift FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def self_sync(spark, sf):
    """ST3: one clock shift per recording."""
    first = lambda e: F.min(F.when(F.col("event_type") == e, F.col("t")))
    d = streams(spark, sf).groupBy("user_id").agg(first("purchase").alias("a"), first("click").alias("b")).filter("a is not null and b is not null")
    return d.select("user_id", r6(tj.self_sync(F.col("a"), F.col("b")), "shift", 3))


@query("running_stats", f"WITH {_STREAMS} SELECT event_id, count(*) OVER w AS run_n, round(avg(value) OVER w + 3.3e-9, 6) AS run_mean, round(var_pop(value) OVER w + 3.3e-7, 4) AS run_var FROM streams WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)")
def running_stats(spark, sf):
    """A2, A3: running mean and variance."""
    d = cal.running_stats(streams(spark, sf), "user_id", ["t", "event_id"], "value")
    return d.select("event_id", "run_n", r6(F.col("run_mean") + 3.3e-9, "run_mean"), r6(F.col("run_var") + 3.3e-7, "run_var", 4))


_GATE = f"""WITH RECURSIVE {_STREAMS}, o AS (SELECT user_id, event_id, value AS x, k AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM streams),
g AS (SELECT user_id, event_id, n, x AS lx, y AS ly, true AS ok FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN m.far THEN o.x ELSE g.lx END, CASE WHEN m.far THEN o.y ELSE g.ly END, m.far
FROM g JOIN o ON o.user_id = g.user_id AND o.n = g.n + 1, LATERAL (SELECT (o.x - g.lx) * (o.x - g.lx) + (o.y - g.ly) * (o.y - g.ly) > 10000 AS far) m)
SELECT user_id, event_id FROM g WHERE ok"""


@query("motion_gate", _GATE)
def motion_gate(spark, sf):
    """F15, ST13: rows that moved enough since the last accepted one (state, not a lag)."""
    d = streams(spark, sf).select(F.col("user_id"), "event_id", F.col("value").alias("x"), F.col("k").alias("y"))
    return replay.motion_gate(d, "user_id", "event_id", gate=100.0).select("user_id", "event_id")


# Neighbours, planes, normal equations


def _scan_map(spark, sf):
    p = points(spark, sf)
    return p.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "q"), p.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "m")


_KNN = "pairs AS (SELECT a.vec_id AS q, b.vec_id AS m, a.x AS qx, a.y AS qy, a.z AS qz, b.x, b.y, b.z, b.label % 2 AS map_id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM points a, points b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"
_KNN5 = f"{_KNN}, hits AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, m) AS rank FROM pairs WHERE d2 <= {RADIUS * RADIUS!r}), near AS (SELECT * FROM hits WHERE rank <= 5 QUALIFY count(*) OVER (PARTITION BY q) = 5)"


@query("knn5", f"WITH {_POINTS}, {_KNN5} SELECT q, m, rank, round(d2, 8) AS d2 FROM near")
def knn5(spark, sf):
    """Five nearest neighbours within a radius, by an equi-join on cells."""
    scan, cloud = _scan_map(spark, sf)
    return nb.knn(scan, cloud, 5, RADIUS).select("q", "m", "rank", r6("d2", "d2", 8))


@query("knn5_dual", f"WITH {_POINTS}, {_KNN}, hits AS (SELECT *, row_number() OVER (PARTITION BY q, map_id ORDER BY d2, m) AS rank FROM pairs WHERE d2 <= {RADIUS * RADIUS!r}), near AS (SELECT * FROM hits WHERE rank <= 5 QUALIFY count(*) OVER (PARTITION BY q, map_id) = 5) SELECT q, map_id, m, rank FROM near")
def knn5_dual(spark, sf):
    """Neighbours in two maps with one join."""
    scan, cloud = _scan_map(spark, sf)
    return nb.knn(scan, cloud.withColumn("map_id", F.col("label") % 2), 5, RADIUS, ("map_id",)).select("q", "map_id", "m", "rank")


def _sql_planes(source: str, by: str, extra: str = "") -> str:
    """CTEs mo, eg, pl: planes of groups of a source in closed form."""
    return f"""mo AS (SELECT {by}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) + 1e-6/count(*) AS xx, var_pop(y) + 1e-6/count(*) AS yy, var_pop(z) + 1e-6/count(*) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz{extra} FROM {source} GROUP BY {by}),
    e1 AS (SELECT *, (xx + yy + zz)/3 AS tr FROM mo WHERE n >= 3),
    e2 AS (SELECT *, sqrt(((xx-tr)*(xx-tr) + (yy-tr)*(yy-tr) + (zz-tr)*(zz-tr) + 2*(xy*xy + xz*xz + yz*yz))/6) AS pp FROM e1),
    e3 AS (SELECT *, acos(greatest(-1.0, least(1.0, ((xx-tr)*((yy-tr)*(zz-tr) - yz*yz) - xy*(xy*(zz-tr) - yz*xz) + xz*(xy*yz - (yy-tr)*xz)) / (2*pp*pp*pp))))/3 AS phi FROM e2),
    e4 AS (SELECT *, tr + 2*pp*cos(phi + {2 * math.pi / 3!r}) AS l0, tr + 2*pp*cos(phi) AS l2 FROM e3),
    e5 AS (SELECT *, 3*tr - l0 - l2 AS l1, xy*yz - xz*(yy-l0) AS ax, xz*xy - (xx-l0)*yz AS ay, (xx-l0)*(yy-l0) - xy*xy AS az, xy*(zz-l0) - xz*yz AS bx, xz*xz - (xx-l0)*(zz-l0) AS by_, (xx-l0)*yz - xy*xz AS bz, (yy-l0)*(zz-l0) - yz*yz AS cx, yz*xz - xy*(zz-l0) AS cy, xy*yz - (yy-l0)*xz AS cz FROM e4),
    e6 AS (SELECT *, ax*ax + ay*ay + az*az AS sa, bx*bx + by_*by_ + bz*bz AS sb, cx*cx + cy*cy + cz*cz AS sc FROM e5),
    e7 AS (SELECT *, CASE WHEN sa >= sb AND sa >= sc THEN ax WHEN sb >= sc THEN bx ELSE cx END AS vx, CASE WHEN sa >= sb AND sa >= sc THEN ay WHEN sb >= sc THEN by_ ELSE cy END AS vy, CASE WHEN sa >= sb AND sa >= sc THEN az WHEN sb >= sc THEN bz ELSE cz END AS vz FROM e6),
    e8 AS (SELECT *, vx/sqrt(vx*vx + vy*vy + vz*vz) AS nx, vy/sqrt(vx*vx + vy*vy + vz*vz) AS ny, vz/sqrt(vx*vx + vy*vy + vz*vz) AS nz FROM e7),
    pl AS (SELECT *, -(nx*mx + ny*my + nz*mz) AS d, l0 + 0.001 AS plane_var, l0/(l0 + l1 + l2) AS curvature FROM e8)"""


@query("plane_pca", f"WITH {_POINTS}, {_sql_planes('points', 'label')} SELECT label, n, round(l0, 8) AS l0, round(l1, 8) AS l1, round(l2, 8) AS l2, round(nx*nx, 6) AS nxx, round(ny*ny, 6) AS nyy, round(nx*ny, 6) AS nxy, round(abs(d), 6) AS d FROM pl")
def plane_pca(spark, sf):
    """Plane of each group; the normal's sign is arbitrary, so its products are shown."""
    p = nb.planes(points(spark, sf), ["label"])
    return p.select("label", "n", *[r6(c, c, 8) for c in ("l0", "l1", "l2")], r6(F.col("nx") * F.col("nx"), "nxx"), r6(F.col("ny") * F.col("ny"), "nyy"), r6(F.col("nx") * F.col("ny"), "nxy"), r6(F.abs("d"), "d"))


@query("planarity_gate", f"WITH {_POINTS}, {_KNN5}, {_sql_planes('near', 'q')} SELECT q, round(curvature, 6) AS curvature FROM pl WHERE curvature > 1e-5 AND curvature <= 0.04")
def planarity_gate(spark, sf):
    """neighbourhoods that are flat, but not perfectly flat."""
    scan, cloud = _scan_map(spark, sf)
    return nb.planar(nb.planes(nb.knn(scan, cloud, 5, RADIUS), ["q"])).select("q", r6("curvature", "curvature"))


_RES = f"WITH {_POINTS}, {_KNN5}, {_sql_planes('near', 'q', ', min(qx) AS px, min(qy) AS py, min(qz) AS pz')}, rs AS (SELECT *, nx*px + ny*py + nz*pz + d AS p2p FROM pl WHERE curvature > 1e-5 AND curvature <= 0.04), rw AS (SELECT *, 1000.0 * CASE WHEN abs(p2p)/sqrt(plane_var) <= 1 THEN 1 ELSE sqrt(plane_var)/abs(p2p) END AS weight FROM rs)"


def _residuals(spark, sf):
    scan, cloud = _scan_map(spark, sf)
    p = nb.planes(nb.knn(scan, cloud, 5, RADIUS), ["q"], [F.min(f"q{c}").alias(f"p{c}") for c in "xyz"])
    return nb.residuals(nb.planar(p), tuple(F.col(f"p{c}") for c in "xyz"), F.lit(0.0))


@query("residual_weight", f"{_RES} SELECT q, round(abs(p2p), 6) AS p2p, round(weight, 4) AS weight FROM rw")
def residual_weight(spark, sf):
    """Distance to the plane and its robust weight."""
    return _residuals(spark, sf).select("q", r6(F.abs("p2p"), "p2p"), r6("weight", "weight", 4))


@query("huber", "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_quantity/10) <= 2 THEN 1 ELSE 2/abs(l_quantity/10) END, 6) AS w FROM lineitem")
def huber_weight(spark, sf):
    """The weight alone."""
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(huber(F.col("l_quantity") / 10, 2.0), "w"))


_J = ["nx", "ny", "nz", "py*nz - pz*ny", "pz*nx - px*nz", "px*ny - py*nx"]


@query("normal_equations", f"{_RES} SELECT count(*) AS n, " + ", ".join(f"round(sum(weight*({_J[i]})*({_J[j]})), 4) AS h_{i}_{j}" for i in range(6) for j in range(i, 6)) + ", " + ", ".join(f"round(sum(weight*({_J[i]})*(-p2p)), 4) AS b_{i}" for i in range(6)) + " FROM rw")
def normal_equations(spark, sf):
    """J'wJ and J'wr in one aggregation."""
    d = _residuals(spark, sf)
    out = nb.normal_equations(d, nb.pose_jacobian(tuple(F.col(f"p{c}") for c in "xyz")), F.col("cost"), F.col("weight"))
    return out.select("n", *[r6(c, c, 4) for c in out.columns if c != "n"])


@query("residual_pipeline", f"WITH p0 AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), p1 AS (SELECT min(vec_id) AS id, floor(x/0.02) cx, floor(y/0.02) cy, floor(z/0.02) cz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p0 WHERE x BETWEEN -0.3 AND 0.3 AND y BETWEEN -0.3 AND 0.3 AND z BETWEEN -0.3 AND 0.3 GROUP BY 2, 3, 4), points AS (SELECT id AS vec_id, 0 AS label, x, y, z FROM p1), " + _RES.split(_POINTS + ", ")[1] + " SELECT count(*) AS n, round(sum(weight), 3) AS weight, round(sum(weight*p2p*p2p), 6) AS cost FROM rw")
def residual_pipeline(spark, sf):
    """Crop, voxels, neighbours, planes, weighted residual."""
    p = pt.crop_box(points(spark, sf), (0.0, 0.0, 0.0), (0.3, 0.3, 0.3))
    cells = [c.alias(k) for c, k in zip(pt.voxel_cells((0.02,) * 3), ("cx", "cy", "cz"), strict=True)]
    v = p.groupBy(*cells).agg(F.min("vec_id").alias("id"), *[F.avg(c).alias(c) for c in "xyz"])
    hits = nb.knn(v.filter("id % 2 = 0").withColumnRenamed("id", "q"), v.filter("id % 2 = 1").withColumnRenamed("id", "m"), 5, RADIUS)
    d = nb.residuals(nb.planar(nb.planes(hits, ["q"], [F.min(f"q{c}").alias(f"p{c}") for c in "xyz"])), tuple(F.col(f"p{c}") for c in "xyz"), F.lit(0.0))
    return d.agg(F.count("*").alias("n"), r6(F.sum("weight"), "weight", 3), r6(F.sum(F.col("weight") * F.col("p2p") * F.col("p2p")), "cost"))


@query("balance_weights", f"WITH {_POINTS}, c AS (SELECT label, count(*) AS n FROM points GROUP BY 1) SELECT label, n, round(greatest(max(n) OVER () / n::DOUBLE, 1.0), 6) AS balance FROM c")
def balance_weights(spark, sf):
    """Systems of small maps count as much as those of large ones."""
    return cal.balance(points(spark, sf).groupBy("label").agg(F.count("*").alias("n"))).select("label", "n", r6("balance", "balance"))


# Calibration and geodesy


@query("weighted_origin", f"WITH {_STREAMS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM streams) SELECT user_id, round(sum(value/(1+k))/sum(1/(1+k)), 6) AS origin FROM f WHERE rn <= 10 GROUP BY 1")
def weighted_origin(spark, sf):
    """A7, ST10, W4: origin from the first ten fixes, weighted by inverse variances."""
    d = cal.first_n(streams(spark, sf), "user_id", ["t", "event_id"], 10)
    return d.groupBy("user_id").agg(r6(cal.weighted_mean(F.col("value"), 1 + F.col("k")), "origin"))


_PAIR = f"{_POINTS}, pr AS (SELECT label, x AS ax, y AS ay, z AS az, {_ROT[0]!r}*x + {_ROT[1]!r}*y + 1.5 AS bx, {_ROT[3]!r}*x + {_ROT[4]!r}*y - 2.0 AS by_, z + 0.25 AS bz FROM points)"


def _pairs(spark, sf):
    a = points(spark, sf).select("vec_id", "label", "x", "y", "z", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    return pt.transform(a, _ROT, (1.5, -2.0, 0.25)).withColumnsRenamed({"x": "bx", "y": "by_", "z": "bz"})


@query("kabsch_moments", f"WITH {_PAIR} SELECT label, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("ax", "ay", "az", "bx", "by_", "bz")) + ", " + ", ".join(f"round(covar_pop({p}, {q}), 8) AS cov_{p}_{q}" for p in ("ax", "ay", "az") for q in ("bx", "by_", "bz")) + " FROM pr GROUP BY 1")
def kabsch_moments(spark, sf):
    """All that a rigid alignment needs, in one aggregation."""
    m = cal.alignment_moments(_pairs(spark, sf), ("ax", "ay", "az"), ("bx", "by_", "bz"), ("label",))
    return m.select("label", "n", *[r6(c, c, 8 if c.startswith("cov") else 6) for c in m.columns if c not in ("label", "n")])


@query("kabsch_yaw", f"WITH {_PAIR} SELECT label, round(atan2(covar_pop(ax, by_) - covar_pop(ay, bx), covar_pop(ax, bx) + covar_pop(ay, by_)), 6) AS yaw FROM pr GROUP BY 1")
def kabsch_yaw(spark, sf):
    """A8, M22, ST11: the planar angle of the alignment in closed form."""
    m = cal.alignment_moments(_pairs(spark, sf), ("ax", "ay", "az"), ("bx", "by_", "bz"), ("label",))
    return m.select("label", r6(F.atan2(F.col("cov_ax_by_") - F.col("cov_ay_bx"), F.col("cov_ax_bx") + F.col("cov_ay_by_")), "yaw"))


@query("stddev3", f"WITH {_BULK} SELECT round(stddev_pop(x), 6) AS sx, round(stddev_pop(y), 6) AS sy, round(stddev_pop(z), 6) AS sz, round(avg(x), 6) AS mx FROM bulk")
def stddev3(spark, sf):
    """Population deviations per axis."""
    return bulk(spark, sf).agg(*[r6(F.stddev_pop(c), f"s{c}") for c in "xyz"], r6(F.avg("x"), "mx"))


@query("median", "SELECT l_linenumber, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY 1")
def median(spark, sf):
    """Midpoint of the two middle values of an even number."""
    return read(spark, sf, "lineitem").groupBy("l_linenumber").agg(r6(F.median("l_extendedprice"), "med", 4))


@query("median_by_norm", f"WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x*x + y*y + z*z, vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM points) SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM r WHERE i IN ((n + 1)//2, n//2 + 1) GROUP BY 1")
def median_by_norm(spark, sf):
    """A5, O3: the vector of middle norm."""
    return cal.median_by_norm(points(spark, sf), "label", ("x", "y", "z"), "vec_id").select("label", *[r6(c, c) for c in "xyz"])


_LLA = f"{_STREAMS}, g AS (SELECT event_id, 45 + value/10000 AS lat, 9 + k/1000 AS lon, 100 + k AS alt FROM streams)"


def _ecef_sql(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    n = f"({geo.A}/sqrt(1 - {geo.E2!r}*sin(radians({lat}))*sin(radians({lat}))))"
    return f"(({n}+{alt})*cos(radians({lat}))*cos(radians({lon})))", f"(({n}+{alt})*cos(radians({lat}))*sin(radians({lon})))", f"(({n}*(1-{geo.E2!r})+{alt})*sin(radians({lat})))"


_X, _O = _ecef_sql("lat", "lon", "alt"), _ecef_sql("45.02", "9.05", "120.0")


@query("lla_to_enu", f"WITH {_LLA}, d AS (SELECT event_id, {_X[0]} - {_O[0]} AS dx, {_X[1]} - {_O[1]} AS dy, {_X[2]} - {_O[2]} AS dz FROM g) SELECT event_id, round(-sin(radians(9.05))*dx + cos(radians(9.05))*dy, 4) AS east, round(-sin(radians(45.02))*cos(radians(9.05))*dx - sin(radians(45.02))*sin(radians(9.05))*dy + cos(radians(45.02))*dz, 4) AS north, round(cos(radians(45.02))*cos(radians(9.05))*dx + cos(radians(45.02))*sin(radians(9.05))*dy + sin(radians(45.02))*dz, 4) AS up FROM d")
def lla_to_enu(spark, sf):
    """Positions in a local Cartesian frame."""
    d = streams(spark, sf).select("event_id", (45 + F.col("value") / 10000).alias("lat"), (9 + F.col("k") / 1000).alias("lon"), (100 + F.col("k")).alias("alt"))
    e, n, u = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), F.lit(45.02), F.lit(9.05), F.lit(120.0))
    return d.select("event_id", r6(e, "east", 4), r6(n, "north", 4), r6(u, "up", 4))


def _gnss_sql() -> str:
    x, o = _ecef_sql("lat", "lon", "alt"), _ecef_sql("lat0", "lon0", "alt0")
    return f"""WITH {_STREAMS}, g AS (SELECT event_id, user_id, t, 45 + value/10000 AS lat, 9 + k/1000 AS lon, 100 + k AS alt, 1 + k AS v FROM streams),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM g),
    o AS (SELECT user_id, sum(lat/v)/sum(1/v) AS lat0, sum(lon/v)/sum(1/v) AS lon0, sum(alt/v)/sum(1/v) AS alt0 FROM r WHERE rn <= 10 GROUP BY 1),
    d AS (SELECT event_id, lat0, lon0, {x[0]} - {o[0]} AS dx, {x[1]} - {o[1]} AS dy, {x[2]} - {o[2]} AS dz FROM g JOIN o USING (user_id)),
    e AS (SELECT event_id, -sin(radians(lon0))*dx + cos(radians(lon0))*dy AS east, -sin(radians(lat0))*cos(radians(lon0))*dx - sin(radians(lat0))*sin(radians(lon0))*dy + cos(radians(lat0))*dz AS north, cos(radians(lat0))*cos(radians(lon0))*dx + cos(radians(lat0))*sin(radians(lon0))*dy + sin(radians(lat0))*dz AS up FROM d)
    SELECT event_id, round({math.cos(0.3)!r}*east - {math.sin(0.3)!r}*north, 3) AS wx, round({math.sin(0.3)!r}*east + {math.cos(0.3)!r}*north, 3) AS wy, round(up, 3) AS wz FROM e WHERE abs(east) <= 4000 AND abs(north) <= 4000 AND abs(up) <= 4000"""


@query("gnss_trajectory", _gnss_sql())
def gnss_trajectory(spark, sf):
    """ST10, M17, F11, M19: origin of each recording, local frame, sanity gate, turned into the filter's frame."""
    from tessera.plans import gnss

    d = streams(spark, sf).select("event_id", "user_id", "t", (45 + F.col("value") / 10000).alias("lat"), (9 + F.col("k") / 1000).alias("lon"), (100 + F.col("k")).alias("alt"), *[(1 + F.col("k")).alias(f"var_{c}") for c in "enu"])
    w = gnss.world(gnss.positions(d, "user_id", ["t", "event_id"], limit=4000.0), 0.3)
    return w.select("event_id", *[r6(c, c, 3) for c in ("wx", "wy", "wz")])


def _utm_sql() -> str:
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    c, scale = 2 * math.sqrt(n) / (1 + n), 0.9996 * geo.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(series, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(series, 1))])
    return f"""WITH {_STREAMS}, a AS (SELECT event_id, 45 + value / 10000 AS lat, 9 + k / 1000 AS lon FROM streams),
b AS (SELECT *, (floor((lon + 180) / 6) + 1)::INT AS zone, radians(lat) AS p FROM a), c AS (SELECT *, radians(lon - (zone * 6 - 183)) AS q, sinh(atanh(sin(p)) - {c!r} * atanh({c!r} * sin(p))) AS t FROM b),
d AS (SELECT *, atan2(t, cos(q)) AS xi, atanh(sin(q) / sqrt(1 + t * t)) AS eta FROM c)
SELECT event_id, zone, round(500000 + {scale!r} * ({east}), 3) + 0.0 AS easting, round({scale!r} * ({north}), 3) + 0.0 AS northing FROM d"""


@query("lla_to_utm", _utm_sql())
def lla_to_utm(spark, sf):
    """UTM zone, easting and northing."""
    d = streams(spark, sf).select("event_id", (45 + F.col("value") / 10000).alias("lat"), (9 + F.col("k") / 1000).alias("lon"))
    zone, e, n = geo.utm(F.col("lat"), F.col("lon"))
    return d.select("event_id", zone.alias("zone"), r6(e, "easting", 3), r6(n, "northing", 3))


@query("yaw_matrix", f"WITH {_STREAMS} SELECT event_id, round(cos(radians(value)), 6) AS r00, round(-sin(radians(value)), 6) + 0.0 AS r01, round(sin(radians(value)), 6) + 0.0 AS r10, round(cos(radians(value)), 6) AS r11 FROM streams")
def yaw_matrix(spark, sf):
    """Rotation of a compass track."""
    m = geo.yaw_matrix(F.col("value"))
    return streams(spark, sf).select("event_id", *[r6(c, n) for c, n in zip(m, ("r00", "r01", "r10", "r11"), strict=True)])


@query("gps_tod", f"WITH {_STREAMS} SELECT event_id, round((t - {geo.GPS_EPOCH} - 18) % 86400, 3) AS tod FROM streams")
def gps_tod(spark, sf):
    """GPS time of day."""
    return streams(spark, sf).select("event_id", r6(geo.gps_time_of_day(F.col("t") - geo.GPS_EPOCH), "tod", 3))


# Tiles


def _names(spark, sf):
    c = read(spark, sf, "customer")
    good = F.format_string("tile_x_%d_y_%d.las", F.col("c_custkey") * 50, F.col("c_nationkey") * 50)
    return c.select(F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("x"), good)).otherwise(good).alias("filename"))


_NAMES = "names AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END || 'tile_x_' || c_custkey*50 || '_y_' || c_nationkey*50 || '.las' AS filename FROM customer), cat AS (SELECT filename, regexp_extract(filename, '^tile_x_(\\d+)_y_(\\d+)\\.las$', 1)::INT AS tile_x, regexp_extract(filename, '^tile_x_(\\d+)_y_(\\d+)\\.las$', 2)::INT AS tile_y FROM names WHERE regexp_matches(filename, '^tile_x_(\\d+)_y_(\\d+)\\.las$')), tiles AS (SELECT *, tile_x + 25.0 AS cx, tile_y + 25.0 AS cy FROM cat)"


@query("tile_catalog", f"WITH {_NAMES} SELECT filename, tile_x, tile_y, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM tiles")
def tile_catalog(spark, sf):
    """Tiles by their names; others are skipped."""
    return tl.catalog(_names(spark, sf)).select("filename", "tile_x", "tile_y", "cx", "cy")


@query("tile_names", f"WITH {_NAMES} SELECT filename, 'tile_x_' || (cx - 25)::INT || '_y_' || (cy - 25)::INT || '.las' AS made FROM tiles")
def tile_names(spark, sf):
    """Names from centres."""
    return tl.catalog(_names(spark, sf)).select("filename", tl.file_name().alias("made"))


@query("tile_topk", f"WITH {_NAMES} SELECT filename, round((cx-5000)*(cx-5000) + (cy-600)*(cy-600), 3)::DOUBLE AS d2 FROM tiles WHERE (cx-5000)*(cx-5000) + (cy-600)*(cy-600) < 1000000 ORDER BY (cx-5000)*(cx-5000) + (cy-600)*(cy-600), filename LIMIT 4")
def tile_topk(spark, sf):
    """The four nearest tiles within a distance."""
    return tl.nearest(tl.catalog(_names(spark, sf)), 5000.0, 600.0, 4, 1000.0).select("filename", r6("d2", "d2", 3))


@query("tile_anti", f"WITH {_NAMES} SELECT filename FROM tiles WHERE filename NOT IN (SELECT filename FROM tiles WHERE tile_y < 500)")
def tile_anti(spark, sf):
    """J9, ST14: tiles that were not loaded lately."""
    t = tl.catalog(_names(spark, sf))
    return tl.fresh(t, t.filter("tile_y < 500")).select("filename")


@query("patch_gate", f"WITH {_BULK} SELECT floor(x/10)::BIGINT AS tile_x, floor(y/10)::BIGINT AS tile_y, count(*) AS n FROM bulk GROUP BY 1, 2 HAVING count(*) >= 100")
def patch_gate(spark, sf):
    """Tiles of at least 100 points."""
    return pt.patches(bulk(spark, sf), 10.0, 100)


# The filter, over recordings side by side


@query("trajectory")
def trajectory(spark, sf):
    """ST8, ST9, K1: pose of each scan of each recording; recordings run side by side."""
    from tessera.plans import odometry

    p = points(spark, sf).select((F.col("label") % 4).cast("bigint").alias("rec"), F.col("label").cast("bigint").alias("scan_id"), F.col("label").cast("double").alias("t"), F.lit(0.0).alias("time"), "x", "y", "z")
    schema = "scan_id bigint, t double, px double, py double, pz double, qx double, qy double, qz double, qw double, cov array<double>"
    return p.groupBy("rec").applyInPandas(lambda pdf: odometry.track(pdf), schema)


@query("map_update")
def map_update(spark, sf):
    """ST8, J5, A9, A10: one posterior by four iterations, each an aggregate over tables."""
    import numpy as np

    from tessera.config import EngineConfig
    from tessera.functions.lie import State, quaternion
    from tessera.plans import odometry

    cfg = EngineConfig(neighbour_radius=RADIUS, extrinsic_r=(1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0), extrinsic_t=(0.0, 0, 0))
    scan, cloud = _scan_map(spark, sf)
    x, _ = odometry.map_update(State(), np.eye(24) * 1e-2, lambda s: [odometry.system(scan, cloud, s, cfg)], cfg)
    return spark.range(1).select(*[F.lit(float(v)).alias(n) for v, n in zip((*x.pos, *quaternion(x.rot)), ("px", "py", "pz", "qx", "qy", "qz", "qw"), strict=True)])
