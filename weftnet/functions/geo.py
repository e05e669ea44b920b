"""Plane and sphere geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
# fixed values of the projection: meters per degree of longitude at the equator, and of latitude
EAST_M, NORTH_M = 111320.0, 110540.0
LATITUDE = 37.77


def project(lon: Column, lat: Column, latitude: float = LATITUDE) -> tuple[Column, Column]:
    """Meters east and north in an equirectangular projection that is true at ``latitude``."""
    return lon * (EAST_M * math.cos(math.radians(latitude))), lat * NORTH_M


def unproject(x: Column, y: Column, latitude: float = LATITUDE) -> tuple[Column, Column]:
    return x / (EAST_M * math.cos(math.radians(latitude))), y / NORTH_M


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle meters."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) ** 2
    return F.asin(F.sqrt(a)) * (2 * EARTH_M)


def polyline_length(points: Column) -> Column:
    """Meters along an array of struct(lon, lat)."""
    n = F.size(points)
    legs = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda k: haversine(F.get(points, k)["lon"], F.get(points, k)["lat"], F.get(points, k + 1)["lon"], F.get(points, k + 1)["lat"]),
    )
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda a, b: a + b))


def along(px: Column, py: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Place of a point's foot on a segment, 0 at u to 1 at v."""
    dx, dy = vx - ux, vy - uy
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((px - ux) * dx + (py - uy) * dy) / square).otherwise(0.0)
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) ** 2 + (ay - by) ** 2)


def side(px: Column, py: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """1 to the left of u -> v (or on it), -1 to the right."""
    return F.when((vx - ux) * (py - uy) - (vy - uy) * (px - ux) >= 0, 1).otherwise(-1)
