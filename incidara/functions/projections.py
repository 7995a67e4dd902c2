"""Map coordinates back to longitude and latitude, as column expressions.

Both projections go by way of the conformal latitude, whose series in the third flattening gives the latitude itself
without iterating; terms to the fourth power leave errors far below a millimetre.  Datums are not shifted: North American and world
systems agree to about two metres.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    axis: float
    inverse_flattening: float

    @property
    def third(self) -> float:
        """The third flattening."""
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def eccentricity(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def conformal(self, latitude: float) -> float:
        """The conformal latitude of a latitude, both in radians."""
        e, sine = self.eccentricity, math.sin(latitude)
        return math.asin(math.tanh(math.atanh(sine) - e * math.atanh(e * sine)))

    def latitude(self, conformal: Column) -> Column:
        n = self.third
        terms = (
            2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4,
            7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4,
            56 / 15 * n**3 - 136 / 35 * n**4,
            4279 / 630 * n**4,
        )
        return sum((F.lit(t) * F.sin(conformal * (2 * k)) for k, t in enumerate(terms, 1)), conformal)


def _degrees(longitude: Column, latitude: Column) -> Column:
    return F.struct(F.degrees(longitude).alias("x"), F.degrees(latitude).alias("y"))


@dataclass(frozen=True)
class TransverseMercator:
    """Origin in degrees, scale there, false easting and northing and ``unit`` in metres."""

    ellipsoid: Ellipsoid
    latitude: float
    longitude: float
    scale: float
    easting: float
    northing: float
    unit: float = 1.0

    def degrees(self, x: Column, y: Column) -> Column:
        """``x`` (longitude) and ``y`` (latitude) in degrees."""
        n = self.ellipsoid.third
        radius = self.ellipsoid.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * self.scale
        forward = (
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
            13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
            61 / 240 * n**3 - 103 / 140 * n**4,
            49561 / 161280 * n**4,
        )
        back = (
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4,
            1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4,
            4397 / 161280 * n**4,
        )
        at = self.ellipsoid.conformal(math.radians(self.latitude))
        origin = at + sum(t * math.sin(2 * k * at) for k, t in enumerate(forward, 1))
        north = (y * F.lit(self.unit) - F.lit(self.northing)) / F.lit(radius) + F.lit(origin)
        east = (x * F.lit(self.unit) - F.lit(self.easting)) / F.lit(radius)
        up = sum((F.lit(-t) * F.sin(north * (2 * k)) * F.cosh(east * (2 * k)) for k, t in enumerate(back, 1)), north)
        right = sum((F.lit(-t) * F.cos(north * (2 * k)) * F.sinh(east * (2 * k)) for k, t in enumerate(back, 1)), east)
        conformal = F.asin(F.sin(up) / F.cosh(right))
        return _degrees(F.atan2(F.sinh(right), F.cos(up)) + F.lit(math.radians(self.longitude)), self.ellipsoid.latitude(conformal))


@dataclass(frozen=True)
class LambertConic:
    """Conformal conic of two parallels; degrees, and false easting and northing and ``unit`` in metres."""

    ellipsoid: Ellipsoid
    latitude: float
    longitude: float
    first: float
    second: float
    easting: float
    northing: float
    unit: float = 1.0

    def degrees(self, x: Column, y: Column) -> Column:
        """``x`` (longitude) and ``y`` (latitude) in degrees."""
        e = self.ellipsoid.eccentricity
        width = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (e * math.sin(math.radians(d))) ** 2)
        cone = lambda d: math.tan(math.pi / 4 - self.ellipsoid.conformal(math.radians(d)) / 2)
        power = math.log(width(self.first) / width(self.second)) / math.log(cone(self.first) / cone(self.second))
        factor = self.ellipsoid.axis * width(self.first) / (power * cone(self.first) ** power)
        top = factor * cone(self.latitude) ** power
        east = x * F.lit(self.unit) - F.lit(self.easting)
        south = F.lit(top) - (y * F.lit(self.unit) - F.lit(self.northing))
        sign = math.copysign(1.0, power)
        radius = F.sqrt(east * east + south * south)
        conformal = F.lit(math.pi / 2) - F.atan(F.pow(radius / F.lit(abs(factor)), F.lit(1 / power))) * 2
        turned = F.atan2(east * F.lit(sign), south * F.lit(sign)) / F.lit(power)
        return _degrees(turned + F.lit(math.radians(self.longitude)), self.ellipsoid.latitude(conformal))


@dataclass(frozen=True)
class WebMercator:
    """The sphere of web maps."""

    radius: float = 6378137.0

    def degrees(self, x: Column, y: Column) -> Column:
        return _degrees(x / F.lit(self.radius), F.atan(F.sinh(y / F.lit(self.radius))))


#: Ellipsoids, the US survey foot in metres, and parameters of systems by their EPSG number.
GRS80, WGS84 = Ellipsoid(6378137.0, 298.257222101), Ellipsoid(6378137.0, 298.257223563)
AIRY, CLARKE_1866 = Ellipsoid(6377563.396, 299.3249646), Ellipsoid(6378206.4, 294.978698214)
US_FOOT = 1200 / 3937
SYSTEMS = {
    2285: LambertConic(GRS80, 47.0, -(120 + 50 / 60), 48 + 44 / 60, 47.5, 500000.0, 0.0, US_FOOT),
    2286: LambertConic(GRS80, 45 + 20 / 60, -120.5, 47 + 20 / 60, 45 + 50 / 60, 500000.0, 0.0, US_FOOT),
    2926: LambertConic(GRS80, 47.0, -(120 + 50 / 60), 48 + 44 / 60, 47.5, 500000.0, 0.0, US_FOOT),
    32148: LambertConic(GRS80, 47.0, -(120 + 50 / 60), 48 + 44 / 60, 47.5, 500000.0, 0.0),
    27700: TransverseMercator(AIRY, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0),
    3857: WebMercator(),
}


def system(number: int):
    """The projection of an EPSG number; None for longitude and latitude; an error for one that is not known."""
    if number in (4326, 4269, 4979):
        return None
    if number in SYSTEMS:
        return SYSTEMS[number]
    family, zone = divmod(number, 100)
    if family in (326, 327) and 1 <= zone <= 60:
        return TransverseMercator(WGS84, 0.0, zone * 6 - 183.0, 0.9996, 500000.0, 10_000_000.0 * (family == 327))
    if family == 269 and 1 <= zone <= 23:
        return TransverseMercator(GRS80, 0.0, zone * 6 - 183.0, 0.9996, 500000.0, 0.0)
    raise ValueError(f"coordinates of EPSG:{number} cannot be reprojected")


def named(name: str | None):
    """The projection that a GeoJSON file's ``crs`` names; None if it names none, or longitude and latitude."""
    if name is None or re.search(r"CRS:?:?(84|83)$", name):
        return None
    found = re.search(r"EPSG:{1,2}(?:[\d.]*:)?(\d+)$", name)
    if found is None:
        raise ValueError(f"coordinates of {name!r} cannot be reprojected")
    return system(int(found[1]))
