"""Explicit schemas of the sensor tables; nothing is inferred."""

from __future__ import annotations

RAW_POINT = "struct<x:float,y:float,z:float,intensity:float,timestamp:double,ring:int>"
LIDAR = f"bag_time double, t double, points array<{RAW_POINT}>"
IMU = "bag_time double, t double, ax double, ay double, az double, gx double, gy double, gz double"
GNSS = "bag_time double, t double, status int, lat double, lon double, alt double, gps_time double, track double, pos_cov array<double>"
POINTS = "scan_id bigint, pt_idx int, x float, y float, z float, intensity float, time float"
TILE_POINTS = "tile_x int, tile_y int, x double, y double, z double"
ODOMETRY = "scan_id bigint, t double, px double, py double, pz double, qx double, qy double, qz double, qw double, cov array<double>"
