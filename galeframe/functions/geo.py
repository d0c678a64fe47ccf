"""WGS84 distances and bearings, local coordinates, longitudes, wind quadrants."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

A_KM = 6378.137
FLAT = 1 / 298.257223563
B_KM = A_KM * (1 - FLAT)
SPHERE_KM = 6371.0
#: The least radius of curvature of the ellipsoid; no degree of latitude is shorter.
LEAST_RADIUS_KM = B_KM * B_KM / A_KM
QUADRANTS = ("NE", "SE", "SW", "NW")
NMI_KM = 1.852


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def wrap_longitude(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def round_longitude(lon: Column | str, digits: int) -> Column:
    """A longitude in [-180, 180) rounded, still below 180: just west of the date line it becomes -180."""
    at = F.round(_c(lon), digits)
    return F.when(at >= 180.0, at - 360.0).otherwise(at)


def unwrap_longitude(lon: Column | str, center: Column | str) -> Column:
    """Longitude within 180 degrees of center."""
    return _c(center) + F.pmod(_c(lon) - _c(center) + 180.0, F.lit(360.0)) - 180.0


def valid_position(lat: Column | str, lon: Column | str) -> Column:
    """Whether a position is there, finite and in range (longitudes up to 360 either way); never null."""
    fine = lambda x, most: _c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) <= most)
    return F.coalesce(fine(lat, 90.0) & fine(lon, 360.0), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    Formulas that use a part many times would else grow with every nesting, and Catalyst shares
    equal parts in projections only, not in filters and join conditions.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _betas(lat1: Column | str | float, lon1: Column | str | float, lat2: Column | str | float, lon2: Column | str | float) -> Column:
    """Reduced latitudes a and b, half the longitude difference."""
    beta = lambda x: F.atan(F.lit(1 - FLAT) * F.tan(F.radians(_c(x))))
    return F.struct(beta(lat1).alias("a"), beta(lat2).alias("b"), (F.radians(_c(lon2) - _c(lon1)) / 2.0).alias("half"))


def _haversine(v: Column) -> Column:
    q = (v["b"] - v["a"]) / 2.0
    h = F.sin(q) * F.sin(q) + F.cos(v["a"]) * F.cos(v["b"]) * F.sin(v["half"]) * F.sin(v["half"])
    return F.struct(((v["a"] + v["b"]) / 2.0).alias("p"), q.alias("q"), F.least(F.lit(1.0), h).alias("h"))


def _lambert(v: Column) -> Column:
    s = F.asin(F.sqrt(v["h"])) * 2.0
    x = (s - F.sin(s)) * F.pow(F.sin(v["p"]) * F.cos(v["q"]), F.lit(2)) / F.greatest(F.lit(1e-12), F.lit(1.0) - v["h"])
    y = (s + F.sin(s)) * F.pow(F.cos(v["p"]) * F.sin(v["q"]), F.lit(2)) / v["h"]
    return F.when(v["h"] <= 0.0, 0.0).otherwise(F.lit(A_KM) * (s - F.lit(FLAT / 2) * (x + y)))


def distance_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Ellipsoidal distance by Lambert's formula over reduced latitudes, within a metre up to 600 km; built-in functions only."""
    return let(let(_betas(lat1, lon1, lat2, lon2), _haversine), _lambert)


def unit_xyz(lat: Column | str, lon: Column | str) -> Column:
    """Place on the unit sphere, struct<x, y, z>."""
    p, l = F.radians(_c(lat)), F.radians(_c(lon))  # noqa: E741
    return F.struct((F.cos(p) * F.cos(l)).alias("x"), (F.cos(p) * F.sin(l)).alias("y"), F.sin(p).alias("z"))


def _bearing(v: Column) -> Column:
    d = v["half"] * 2.0
    return F.pmod(F.degrees(F.atan2(F.cos(v["b"]) * F.sin(d), F.cos(v["a"]) * F.sin(v["b"]) - F.sin(v["a"]) * F.cos(v["b"]) * F.cos(d))), F.lit(360.0))


def bearing_deg(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Bearing of the second place from the first over reduced latitudes, in [0, 360)."""
    return let(_betas(lat1, lon1, lat2, lon2), _bearing)


def local_xy(lat: Column | str, lon: Column | str, lat0: Column | str, lon0: Column | str) -> Column:
    """Azimuthal coordinates around (lat0, lon0) in km: east x and north y with the distance kept."""
    both = lambda v: F.struct(let(_haversine(v), _lambert).alias("d"), F.radians(_bearing(v)).alias("b"))
    polar = let(_betas(lat0, lon0, lat, lon), both)
    return let(polar, lambda v: F.struct((v["d"] * F.sin(v["b"])).alias("x"), (v["d"] * F.cos(v["b"])).alias("y")))


def plane_xy(lat, lon, lat0, lon0):
    """local_xy() element by element, as (x, y)."""
    a, b = (np.arctan((1 - FLAT) * np.tan(np.radians(np.asarray(v, float)))) for v in (lat0, lat))
    turn = np.radians(np.asarray(lon, float) - lon0)
    p, q = (a + b) / 2.0, (b - a) / 2.0
    h = np.minimum(1.0, np.sin(q) ** 2 + np.cos(a) * np.cos(b) * np.sin(turn / 2.0) ** 2)
    s = np.arcsin(np.sqrt(h)) * 2.0
    x = (s - np.sin(s)) * (np.sin(p) * np.cos(q)) ** 2 / np.maximum(1e-12, 1.0 - h)
    y = (s + np.sin(s)) * (np.cos(p) * np.sin(q)) ** 2 / np.where(h > 0, h, 1.0)
    d = np.where(h <= 0, 0.0, A_KM * (s - FLAT / 2 * (x + y)))
    w = np.arctan2(np.cos(b) * np.sin(turn), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(turn))
    return d * np.sin(w), d * np.cos(w)


def quadrant(bearing: Column | str) -> Column:
    """NE, SE, SW or NW: half-open quarters of the circle from north."""
    at = F.floor(F.pmod(_c(bearing), F.lit(360.0)) / 90.0).cast("int")
    return F.element_at(F.array(*[F.lit(q) for q in QUADRANTS]), at + 1)


def quadrant_radius_km(bearing: Column | str, ne: Column | str, se: Column | str, sw: Column | str, nw: Column | str) -> Column:
    """The wind radius of the bearing's quarter, from nautical miles to km; null stays null."""
    q = quadrant(bearing)
    picked = F.when(q == "NE", _c(ne)).when(q == "SE", _c(se)).when(q == "SW", _c(sw)).when(q == "NW", _c(nw))
    return picked * NMI_KM


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point from a segment: struct<distance, fraction>."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(0.0)
    return F.struct(F.hypot(px - (ax + t * dx), py - (ay + t * dy)).alias("distance"), t.alias("fraction"))


# -- exact forms, for limits of a metre and less ------------------------------------------------


def inverse(lat1, lon1, lat2, lon2, flat=FLAT):
    """(km, bearing in degrees) on WGS84 by Vincenty's iteration, element by element; near antipodes the last iterate. flat=0 gives a sphere of the same equator."""
    f, b, lat1, lon1, lat2, lon2 = flat, A_KM * (1 - flat), *(np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    span = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    lam = span.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            east = np.cos(u2) * np.sin(lam)
            north = np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
            sin_s = np.hypot(east, north)
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a, 0.0)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = span + (1 - c) * f * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-13
            lam = new
            if done:
                break
    k = cos2_a * (A_KM**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    ds = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return np.where(sin_s > 0, b * big * (s - ds), 0.0), np.degrees(np.arctan2(east, north)) % 360


def direct(lat, lon, bearing, km, flat=FLAT, final=False):
    """(lat, lon) reached from a place on a bearing after km, on WGS84 by Vincenty's iteration; final: and the bearing there."""
    f, b, lat, lon, alpha = flat, A_KM * (1 - flat), *(np.radians(np.asarray(x, float)) for x in (lat, lon, bearing))
    km = np.asarray(km, float)
    u1 = np.arctan((1 - f) * np.tan(lat))
    s1 = np.arctan2(np.tan(u1), np.cos(alpha))
    sin_a = np.cos(u1) * np.sin(alpha)
    cos2_a = 1 - sin_a**2
    k = cos2_a * (A_KM**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    s = first = km / (b * big)
    for _ in range(40):
        mid = np.cos(2 * s1 + s)
        ds = small * np.sin(s) * (mid + small / 4 * (np.cos(s) * (2 * mid**2 - 1) - small / 6 * mid * (4 * np.sin(s) ** 2 - 3) * (4 * mid**2 - 3)))
        new = first + ds
        done = np.nanmax(np.abs(new - s), initial=0.0) < 1e-14
        s = new
        if done:
            break
    mid = np.cos(2 * s1 + s)
    turn = np.sin(u1) * np.sin(s) - np.cos(u1) * np.cos(s) * np.cos(alpha)
    to = np.arctan2(np.sin(u1) * np.cos(s) + np.cos(u1) * np.sin(s) * np.cos(alpha), (1 - f) * np.hypot(sin_a, turn))
    lam = np.arctan2(np.sin(s) * np.sin(alpha), np.cos(u1) * np.cos(s) - np.sin(u1) * np.sin(s) * np.cos(alpha))
    c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
    gone = lam - (1 - c) * f * sin_a * (s + c * np.sin(s) * (mid + c * np.cos(s) * (2 * mid**2 - 1)))
    place = np.degrees(to), (np.degrees(lon + gone) + 180) % 360 - 180
    return (*place, np.degrees(np.arctan2(sin_a, -turn)) % 360) if final else place


@pandas_udf(DoubleType())
def exact_distance_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Vincenty distance; null where a coordinate is null."""
    out = pd.Series(inverse(lat1, lon1, lat2, lon2)[0], index=lat1.index)
    return out.where(lat1.notna() & lon1.notna() & lat2.notna() & lon2.notna(), None)


@pandas_udf(DoubleType())
def exact_bearing_deg(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Vincenty's bearing of the second place from the first, in [0, 360)."""
    return pd.Series(inverse(lat1, lon1, lat2, lon2)[1], index=lat1.index)


@pandas_udf(StructType([StructField("latitude", DoubleType()), StructField("longitude", DoubleType())]))
def destination(lat: pd.Series, lon: pd.Series, bearing: pd.Series, km: pd.Series) -> pd.DataFrame:
    """Place reached on the ellipsoid."""
    to, at = direct(lat, lon, bearing, km)
    return pd.DataFrame({"latitude": to, "longitude": at})


def within_km(lat1, lon1, lat2, lon2, limit: float, slack_km: float = 0.002) -> tuple[Column, Column]:
    """(surely within by the column formula, to be settled by the exact one): pairs near the limit are few."""
    d = distance_km(lat1, lon1, lat2, lon2)
    return d <= limit - slack_km, (d > limit - slack_km) & (d <= limit + slack_km)
