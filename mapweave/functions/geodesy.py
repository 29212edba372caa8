"""Projections between degrees, Web Mercator metres and local metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp
from .fixed_values import EARTH_RADIUS, MAX_MERCATOR_LAT, METRES_PER_DEGREE

_RAD = 3.141592653589793 / 180.0
_QUARTER = 3.141592653589793 / 4.0
_HALF = 3.141592653589793 / 2.0


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS) * lon * F.lit(_RAD)


def mercator_y(lat: Column) -> Column:
    inside = clamp(lat, F.lit(-MAX_MERCATOR_LAT), F.lit(MAX_MERCATOR_LAT))
    return F.lit(EARTH_RADIUS) * F.ln(F.tan(F.lit(_QUARTER) + inside * F.lit(_RAD) / F.lit(2.0)))


def lon_of(x: Column) -> Column:
    return x / F.lit(EARTH_RADIUS) / F.lit(_RAD)


def lat_of(y: Column) -> Column:
    return (F.lit(2.0) * F.atan(F.exp(y / F.lit(EARTH_RADIUS))) - F.lit(_HALF)) / F.lit(_RAD)


def local_x(lon: Column, origin: Column) -> Column:
    """Metres east of the origin; plain Mercator when there is no origin."""
    return mercator_x(lon) - F.coalesce(origin["origin_x"], F.lit(0.0))


def local_y(lat: Column, origin: Column) -> Column:
    """Metres north of the origin; plain Mercator when there is no origin."""
    return mercator_y(lat) - F.coalesce(origin["origin_y"], F.lit(0.0))


def lon_of_local(x: Column, origin: Column) -> Column:
    return lon_of(x + F.coalesce(origin["origin_x"], F.lit(0.0)))


def lat_of_local(y: Column, origin: Column) -> Column:
    return lat_of(y + F.coalesce(origin["origin_y"], F.lit(0.0)))


def metres_per_degree_lat() -> Column:
    return F.lit(METRES_PER_DEGREE)


def metres_per_degree_lon(lat: Column) -> Column:
    return F.lit(METRES_PER_DEGREE) * F.cos(lat * F.lit(_RAD))
