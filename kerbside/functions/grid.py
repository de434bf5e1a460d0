"""A grid over the globe as column functions: bands of latitude, each cut into columns of its own number; sides in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import params as P

#: Feet of a degree along a great circle.
DEGREE_FT = P.EARTH_FT * math.pi / 180


def band(lat: Column, side: Column) -> Column:
    return F.floor(lat / side).cast("long")


def farthest(b: Column, side: Column) -> Column:
    """The largest distance from the equator in a band."""
    return F.least(F.greatest(F.abs(b), F.abs(b + 1)) * side, F.lit(90.0))


def wide_columns(b: Column, side: Column) -> Column:
    """Columns of a band, none narrower than side anywhere in it or in the bands next to it; one where fewer than three fit."""
    n = F.floor(F.cos(F.radians(F.least(farthest(b, side) + side, F.lit(90.0)))) * 360.0 / side).cast("long")
    return F.when(n >= 3, n).otherwise(F.lit(1).cast("long"))


def narrow_columns(b: Column, side: Column) -> Column:
    """Columns of a band, none wider than side anywhere in it."""
    near = F.least(F.least(F.abs(b), F.abs(b + 1)) * side, F.lit(90.0))
    return F.greatest(F.ceil(F.cos(F.radians(near)) * 360.0 / side), F.lit(1)).cast("long")


def column(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)


def reach(lat: Column, radius_ft: Column) -> Column:
    """Degrees of longitude that two points so near each other can be apart, both at most lat from the equator."""
    x = F.sin(radius_ft / (2 * P.EARTH_FT)) / F.cos(F.radians(lat))
    return F.when(x < 1, F.degrees(2 * F.asin(x))).otherwise(180.0) * (1 + 1e-9)


def first_last(lo: Column, hi: Column, n: Column) -> tuple[Column, Column]:
    """The columns that longitudes from lo to hi meet, as a range of numbers to take modulo n; each once."""
    first = F.floor((lo + 180.0) / 360.0 * n).cast("long")
    return first, F.least(F.floor((hi + 180.0) / 360.0 * n).cast("long"), first + n - 1)
