"""Positions and bearings as column functions: degrees, metres or feet, 0 is north, 90 east."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import params as P


def rounded(c: Column, places: int) -> Column:
    """F.round of doubles, to the same values: by arithmetic where that is sure of the digit, as F.round makes a decimal text of each number."""
    scaled = c * F.lit(10.0**places)
    whole = F.rint(scaled)
    return F.when((F.abs(scaled) < 1e11) & (F.abs(scaled - whole) < 0.499), whole / F.lit(10.0**places) + 0.0).otherwise(F.round(c, places))


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s = F.sin(F.radians(lat2 - lat1) / 2)
    t = F.sin(F.radians(lon2 - lon1) / 2)
    return s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t


def haversine_ft(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * P.EARTH_FT * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * P.EARTH_MERGE_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def azimuth_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    p, q = F.radians(lat1), F.radians(lat2)
    return F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.pmod(F.degrees(azimuth_rad(lat1, lon1, lat2, lon2)) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing_rad: Column, distance_m: Column, earth_m: float) -> tuple[Column, Column]:
    """Latitude and longitude at a distance along a great circle."""
    s, p = distance_m / earth_m, F.radians(lat)
    sin_q = F.sin(p) * F.cos(s) + F.cos(p) * F.sin(s) * F.cos(bearing_rad)
    q = F.asin(sin_q)
    step = F.atan2(F.sin(bearing_rad) * F.sin(s) * F.cos(p), F.cos(s) - F.sin(p) * F.sin(q))
    return F.degrees(q), F.degrees(F.radians(lon) + step)


def mono_distance_m(height_m: Column, box_h_px: Column, image_h_px: Column, vfov_deg: float = P.VFOV_DEG) -> Column:
    """Distance of an object of known height by its height in the image; null without a height or a box."""
    d = height_m * image_h_px / (2 * box_h_px * F.tan(F.radians(F.lit(vfov_deg / 2))))
    return F.when((height_m > 0) & (box_h_px > 0) & (image_h_px > 0), d)


def object_bearing_deg(cam_bearing: Column, cx_norm: Column, hfov_deg: float = P.HFOV_DEG) -> Column:
    return F.pmod(cam_bearing + (cx_norm - 0.5) * hfov_deg, F.lit(360.0))


def circular_gap_deg(a: Column, b: Column) -> Column:
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


def dms_decimal(deg: Column, minutes: Column, seconds: Column, direction: Column) -> Column:
    v = deg + minutes / 60 + seconds / 3600
    return F.when(F.upper(direction).isin("S", "W"), -v).otherwise(v)


def valid_coords(lat: Column, lng: Column) -> Column:
    return lat.between(-90, 90) & lng.between(-180, 180)
