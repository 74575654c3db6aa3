"""Distances and grids on the sphere; degrees in, kilometres out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The sphere's radius in other units.
EARTH_NM, EARTH_MI = 3440.065, 3958.7613


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = b - a, F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h))))  # least passes nulls over


def bearing(lat1, lon1, lat2, lon2) -> Column:
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bearing_change(a, b) -> Column:
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(d, 360 - d)


def mercator_to_degrees(x, y) -> tuple[Column, Column]:
    """Latitude and longitude of EPSG:3857 metres."""
    r = 6378137.0
    return F.degrees(2 * F.atan(F.exp(_c(y) / r)) - F.lit(3.141592653589793) / 2), F.degrees(_c(x) / r)


def grid_cell(lat, lon, miles: float = 100.0) -> tuple[Column, Column]:
    """Row and column of a grid of about that spacing; columns widen with the row's latitude."""
    step = miles / 69.0
    row = F.floor(_c(lat) / step).cast("long")
    middle = (row + 0.5) * step
    return row, F.floor(_c(lon) / (step / F.greatest(F.cos(F.radians(middle)), F.lit(0.05)))).cast("long")


def tight_cell(lat, lon, km: float) -> tuple[Column, Column]:
    """Row and column of cells so small that no two points of one are farther apart than km."""
    x = min(km / (2 * EARTH_KM), math.pi / 2)
    step = math.degrees(0.99 * math.sqrt(2) * math.sin(x))  # both sides; the chord over a cell stays under that of km
    row = F.floor(_c(lat) / step).cast("long")
    nearest = F.least(F.least(F.abs(row * step), F.abs((row + 1) * step)), F.lit(90.0))  # of the row's latitudes, to the equator
    return row, F.floor(_c(lon) / (step / F.greatest(F.cos(F.radians(nearest)), F.lit(1e-9)))).cast("long")


def centroid(lat, lon) -> tuple[Column, Column]:
    """Aggregates: the direction of the mean of unit vectors."""
    a, o = F.radians(_c(lat)), F.radians(_c(lon))
    x, y, z = F.avg(F.cos(a) * F.cos(o)), F.avg(F.cos(a) * F.sin(o)), F.avg(F.sin(a))
    return F.degrees(F.atan2(z, F.hypot(x, y))), F.degrees(F.atan2(y, x))
