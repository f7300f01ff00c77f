"""Geometry on the sphere and on a local plane, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371.0, 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; NULL if a coordinate is NULL."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from north, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def turn_deg(before: Column, after: Column) -> Column:
    """Angle between two bearings, 0 to 180."""
    d = F.abs(after - before)
    return F.least(d, 360 - d)


def turn_deg_wrapped(before: Column, after: Column) -> Column:
    """The same angle by wrapping the difference to -180..180 first (floor modulo)."""
    return F.abs(F.pmod(after - before + 180, F.lit(360.0)) - 180)


def arrow_deg(dlat: Column, dlon: Column) -> Column:
    """Planar direction of a step, -180 to 180."""
    return F.degrees(F.atan2(dlon, dlat))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within lo..hi; NULL stays NULL."""
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def coordinate_label(x: Column, positive: str, negative: str) -> Column:
    return F.concat(F.format_string("%.2f°", F.abs(x)), F.when(x >= 0, positive).otherwise(negative))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point to a segment, in the coordinates' unit."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, clip(((x - x1) * dx + (y - y1) * dy) / F.when(size > 0, size), 0, 1)).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(x - (x1 + t * dx), 2) + F.pow(y - (y1 + t * dy), 2))


def stars(p: Column) -> Column:
    """Significance marks."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
