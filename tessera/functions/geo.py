"""Geodesy as column expressions: local Cartesian frames, UTM, headings, GPS time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84 (fixed values).
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
LEAP_SECONDS, GPS_EPOCH = 18, 315964800


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (1 - E2) + alt) * F.sin(p)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a position from an origin."""
    a, b = ecef(lat, lon, alt), ecef(lat0, lon0, alt0)
    dx, dy, dz = a[0] - b[0], a[1] - b[1], a[2] - b[2]
    p, q = F.radians(lat0), F.radians(lon0)
    east = -F.sin(q) * dx + F.cos(q) * dy
    north = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    up = F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz
    return east, north, up


def utm(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """zone, easting and northing by Krueger's series in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    # Zones are 6 degrees wide, but for the south-west of Norway and for Svalbard.
    plain = F.floor((lon + 180) / 6).cast("int") + 1
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)
    far_north = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    zone = F.when(norway, F.lit(32)).when(svalbard, far_north).otherwise(plain)
    p, q = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(p)) - c * F.atanh(c * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(q)), F.atanh(F.sin(q) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return zone, 500000 + 0.9996 * radius * east, F.when(lat < 0, 1e7).otherwise(0.0) + 0.9996 * radius * north


def yaw_matrix(track: Column) -> tuple[Column, Column, Column, Column]:
    """cos, -sin, sin and cos of a heading in degrees: the upper left of its rotation about z."""
    r = F.radians(track)
    return F.cos(r), -F.sin(r), F.sin(r), F.cos(r)


def gps_time_of_day(gps: Column, shift: float = 0.0) -> Column:
    return (gps - LEAP_SECONDS) % 86400 - shift
