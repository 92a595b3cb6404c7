"""Fusion with a prior tiled map: first registration, and refreshes as the vehicle moves."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import lie
from tessera.operators import calibration as cal
from tessera.operators import neighbours as nb
from tessera.operators import points as pt
from tessera.operators import tiles as tl


def register(source: DataFrame, target: DataFrame, radius: float = 2.0, iterations: int = 30, ceiling: float | None = 10.0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rotation and translation that move source (q, x, y, z) onto target (m, x, y, z), and whether it settled.

    Point-to-point registration: nearest neighbours within a radius by the cell join, then moments
    in the same job; only means and covariances reach the driver.  Points above `ceiling` are left
    out.
    """
    if ceiling is not None:
        source, target = source.filter(F.col("z") < ceiling), target.filter(F.col("z") < ceiling)
    rot, move = np.eye(3), np.zeros(3)
    for _ in range(iterations):
        moved = pt.transform(source, tuple(rot.ravel()), tuple(move))
        row = cal.alignment_moments(nb.knn(moved, target, 1, radius), ("qx", "qy", "qz"), ("x", "y", "z")).first()
        if row["n"] < 3:
            return rot, move, False
        a, b = ("qx", "qy", "qz"), ("x", "y", "z")
        cov = np.array([[row[f"cov_{p}_{q}"] for q in b] for p in a])
        r, t = cal.kabsch(np.array([row[f"mean_{p}"] for p in a]), np.array([row[f"mean_{q}"] for q in b]), cov)
        rot, move = r @ rot, r @ move + t
        if np.linalg.norm(t) < 1e-4 and np.linalg.norm(lie.log(r)) < 1e-4:
            return rot, move, True
    return rot, move, False


class PriorMap:
    """State of the prior map: tiles loaded lately, the place of the last refresh, the cloud itself."""

    def __init__(self, tiles: DataFrame, points: DataFrame, cfg: EngineConfig | None = None, gate: float = 25.0, keep: int = 4):
        #: tiles: catalogue (filename, tile_x, tile_y, cx, cy); points: tile_x, tile_y, x, y, z, partitioned by tile.
        self.tiles, self.points, self.cfg, self.gate = tiles, points, cfg or EngineConfig(), gate
        self.recent: deque[str] = deque(maxlen=keep)
        self.last: np.ndarray | None = None
        self.cloud: DataFrame | None = None

    def _load(self, rows: list) -> DataFrame:
        """Literal tile numbers, so that only their partitions are read."""
        wanted = F.lit(False)
        for r in rows:
            wanted = wanted | ((F.col("tile_x") == r.tile_x) & (F.col("tile_y") == r.tile_y))
        return self.points.filter(wanted).select("x", "y", "z")

    def start(self, east: float, north: float, within: float = 250.0) -> DataFrame:
        """The nearest tiles around the first position."""
        rows = tl.nearest(self.tiles, east, north, self.cfg.closest_tiles, within).collect()
        if not rows:
            raise LookupError(f"no tile within {within} m of {east}, {north}")
        self.recent.extend(r.filename for r in rows)
        self.last, self.cloud = np.array([east, north, 0.0]), self._load(rows)
        return self.cloud

    def refresh(self, pos: np.ndarray) -> bool:
        """Crops to the box around a position and adds near tiles that were not loaded lately, if it moved enough."""
        if self.last is not None and np.linalg.norm(pos - self.last) <= self.gate:
            return False
        rows = [r for r in tl.nearest(self.tiles, float(pos[0]), float(pos[1]), self.cfg.closest_tiles, float(np.sqrt(100.0**2 + 100))).collect() if r.filename not in self.recent]
        self.recent.extend(r.filename for r in rows)
        kept = pt.crop_box(self.cloud, (float(pos[0]), float(pos[1]), float(pos[2])), (self.cfg.box_half,) * 3) if self.cloud is not None else None
        new = self._load(rows) if rows else None
        self.cloud = kept if new is None else new if kept is None else kept.unionByName(new)
        self.last = pos
        return self.cloud is not None and len(self.cloud.take(6)) > 5
