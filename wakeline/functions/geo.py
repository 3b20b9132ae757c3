"""Geometry on the sphere as column expressions: everything stays in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
NM_M = 1852.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null where a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a <= 1, a).when(a > 1, 1.0)))  # least() would pass over a null


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / NM_M


def circular_difference(a: Column, b: Column) -> Column:
    """b - a on the circle of degrees, in [-180, 180)."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def project_xy_m(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Local equirectangular coordinates in metres."""
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(F.lit(float(lat0)))), F.radians(lat - lat0) * EARTH_M


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, distance_m: Column, radius: float = EARTH_M) -> tuple[Column, Column]:
    """The point at a distance along a bearing."""
    d, p, b = distance_m / radius, F.radians(lat), F.radians(bearing)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 180.0, F.lit(360.0)) - 180.0


def dead_reckoned(lat: Column, lon: Column, sog: Column, cog: Column, age_s: Column) -> tuple[Column, Column]:
    """Position after age_s (at most 120 s) along the course; the fix itself where it is slow or has no course."""
    ahead = F.least(F.greatest(age_s, F.lit(0.0)), F.lit(120.0)) * sog * (NM_M / 3600)
    lat2, lon2 = destination(lat, lon, cog, ahead, 6_371_000.0)
    moves = (sog > 0.1) & cog.isNotNull()
    return F.when(moves, lat2).otherwise(lat), F.when(moves, lon2).otherwise(lon)


def cell(value: Column, size: float) -> Column:
    """Grid cell by floor."""
    return F.floor(value / size).cast("int")


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive bounding box (west, south, east, north); false for missing coordinates."""
    west, south, east, north = box
    return F.coalesce(lon.between(west, east) & lat.between(south, north), F.lit(False))


def valid_coordinate(lon: Column, lat: Column) -> Column:
    ok = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    return F.coalesce(ok, F.lit(False))


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule for a ring: an array of structs (lat, lon), open or closed."""
    n = F.size(ring)

    def crosses(i):
        a, b = ring[i], ring[(i + 1) % n]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda s, i: F.when(crosses(i), ~s).otherwise(s))
