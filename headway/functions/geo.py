"""Distances on the sphere as columns; coordinates in degrees, distances in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_010.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = map(F.radians, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    # a null stays null, which least() would pass over
    return 2 * RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def chord_angle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Through unit vectors, which is exact for near and for opposite points alike."""
    x1, y1, z1 = unit_vector(lat1, lon1)
    x2, y2, z2 = unit_vector(lat2, lon2)
    cross = F.pow(y1 * z2 - z1 * y2, 2) + F.pow(z1 * x2 - x1 * z2, 2) + F.pow(x1 * y2 - y1 * x2, 2)
    return RADIUS * F.atan2(F.sqrt(cross), x1 * x2 + y1 * y2 + z1 * z2)


def metres(c: Column) -> Column:
    return F.round(c).cast("long")
