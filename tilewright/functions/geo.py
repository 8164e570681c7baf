"""Column expressions for angles, Web-Mercator tiles and rounding, shared by the operators. All stay in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The latitude at which the projected world is square, radii in kilometres, and the anchored block of finest tiles.
MAX_LATITUDE = 85.05112878
EARTH_RADIUS_KM = 6371.0088
WGS84_A_KM = 6378.137
WGS84_B_KM = 6356.752314245
BLOCK, STRIDE, MARGIN = 8, 4, 2

NAUTICAL_MILE_KM = 1.852


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def finite(c: Column | str) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def half_up(c: Column | str) -> Column:
    """Rounding of halves toward positive infinity, also below zero."""
    return F.floor(col(c) + 0.5)


def clamp(c: Column | str, low: Column | float, high: Column | float) -> Column:
    c, low, high = col(c), low if isinstance(low, Column) else F.lit(low), high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, c))


def wrap_longitude(lon: Column | str) -> Column:
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def width(z: Column | str) -> Column:
    """Tiles in a row of a zoom, as long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), col(z).cast("int"))


def mercator_x(lon: Column | str, z: Column | str) -> Column:
    return (wrap_longitude(lon) + 180.0) / 360.0 * width(z)


def mercator_y(lat: Column | str, z: Column | str) -> Column:
    rad = F.radians(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))
    return (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * width(z)


def tile_x(lon: Column | str, z: Column | str) -> Column:
    return F.pmod(F.floor(mercator_x(lon, z)).cast("long"), width(z))


def tile_y(lat: Column | str, z: Column | str) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(width(z) - 1, F.floor(mercator_y(lat, z)).cast("long")))


def north_edge(y: Column, z: Column | str) -> Column:
    """Latitude of the upper edge of row y, in radians."""
    return F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / width(z))))


def ancestor(v: Column | str, levels: Column) -> Column:
    return F.call_function("shiftright", col(v), levels.cast("int"))


def short_arc(a: Column, b: Column, turn: float = 360.0) -> Column:
    """The signed difference b - a along the shorter way, in [-turn / 2, turn / 2)."""
    return F.pmod(b - a + turn / 2, F.lit(turn)) - turn / 2


def haversine(angle: Column) -> Column:
    """sin(angle / 2) ** 2, which grows with the angle and is exact for small ones."""
    return F.pow(F.sin(angle / 2), 2)


def central_angle(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Of two points in degrees, in radians."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
