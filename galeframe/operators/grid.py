"""Gridded fields: windows, vorticity, local minima, disks around a center.

A grid is a long table with one row a cell: keys (model, case, lead), iy, ix, latitude, longitude,
msl, u850, v850, u10, v10. Neighbours come from windows or equi-joins on cell numbers, so a grid is
never gathered in one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar

EARTH_M = 6_371_000.0


def window_cells(grid: DataFrame, lat: float, lon: float, radius_km: float, halo_deg: float = 0.5) -> DataFrame:
    """Cells in the box that holds the disk, with a halo; near a pole all longitudes. Bounds are constants, so they reach the scan."""
    dlat = math.degrees(radius_km / geo.LEAST_RADIUS_KM) + halo_deg
    rows = grid.where(F.col("latitude").between(lat - dlat, lat + dlat))
    top = abs(lat) + dlat
    if top < 89.9:
        span = math.sin(min(math.pi / 2, radius_km / geo.LEAST_RADIUS_KM)) / math.cos(math.radians(abs(lat)))
        dlon = math.degrees(math.asin(min(1.0, span))) + halo_deg
        if dlon < 180:
            rows = rows.where(F.abs(geo.unwrap_longitude("longitude", F.lit(lon)) - lon) <= dlon)
    return rows.withColumn("longitude", geo.unwrap_longitude("longitude", F.lit(lon)))


def _slope(value: str, at: str, w: Window) -> Column:
    """Second-order derivative on uneven spacing, one-sided at the ends."""
    v = lambda k: F.lag(value, -k).over(w) if k else F.col(value)
    x = lambda k: F.lag(at, -k).over(w) if k else F.col(at)

    def through(i: int, j: int, k: int) -> Column:
        """Slope at offset 0 of the parabola through three offsets."""
        a, b, c = x(i), x(j), x(k)
        p = F.col(at)
        term = lambda f, s, t, u: f * ((p - t) + (p - u)) / ((s - t) * (s - u))
        return term(v(i), a, b, c) + term(v(j), b, a, c) + term(v(k), c, a, b)

    return F.when(x(-1).isNull(), through(0, 1, 2)).when(x(1).isNull(), through(0, -1, -2)).otherwise(through(-1, 0, 1))


def vorticity(grid: DataFrame, keys: Sequence[str], u: str = "u850", v: str = "v850", name: str = "zeta") -> DataFrame:
    """grid with the relative vorticity on the sphere, (dv/dlon - d(u cos lat)/dlat) / (a cos lat), second order to the edges; null at poles."""
    east = Window.partitionBy(*keys, "iy").orderBy("longitude")
    north = Window.partitionBy(*keys, "ix").orderBy("latitude")
    cosine = F.cos(F.radians("latitude"))
    rows = grid.withColumn("_u", F.col(u) * cosine)
    turn = _slope(v, "longitude", east) - _slope("_u", "latitude", north)
    return rows.withColumn(name, F.when(F.abs(cosine) > 1e-10, turn / F.radians(F.lit(1.0)) / (F.lit(EARTH_M) * cosine))).drop("_u")


def local_minima(grid: DataFrame, keys: Sequence[str], value: str = "msl") -> DataFrame:
    """Cells that are lowest of a complete, finite 3 x 3 neighbourhood that is not flat.

    Each cell is sent to its nine neighbours and the neighbourhoods are aggregated: one shuffle, with
    partial sums, and no join.
    """
    rows = grid.withColumn("_v", scalar.finite(value))
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sent = rows.withColumn("_m", F.explode(moves))
    sent = sent.select(*keys, (F.col("iy") + F.col("_m.a")).alias("iy"), (F.col("ix") + F.col("_m.b")).alias("ix"), "_v", ((F.col("_m.a") == 0) & (F.col("_m.b") == 0)).alias("_own"), "latitude", "longitude")
    around = sent.groupBy(*keys, "iy", "ix").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max(F.when(F.col("_own"), F.struct("_v", "latitude", "longitude"))).alias("c"))
    return around.where("n = 9 AND c._v = lo AND lo < hi").select(*keys, "iy", "ix", F.col("c.latitude").alias("latitude"), F.col("c.longitude").alias("longitude"), F.col("c._v").alias(value))


def _longitude_reach(lat: Column, angle: float) -> Column:
    """Degrees of longitude that a disk of an angle (radians) around a latitude reaches; all of them where it holds a pole."""
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(math.pi / 2, angle))) / F.cos(F.radians(lat)))))
    return F.when(F.abs(lat) + math.degrees(angle) >= 90.0, 180.0).otherwise(side)


def windows(centers: DataFrame, grid: DataFrame, keys: Sequence[str], radius_km: float, halo_lat: Column | float = 0.0, halo_lon: Column | float = 0.0) -> DataFrame:
    """centers (keys, c_lat, c_lon, ...) with the cells of their own field in the box around their disk and a halo, longitudes unwrapped around the center.

    A center goes to the tiles its box touches and meets the cells there by an equi-join on keys and
    tile, so the rows made are linear in what the boxes hold, however many centers a field has. The
    halo (degrees; two steps of the field's axes, say) may be columns of centers. Boxes wrap at the date line and take all longitudes at a pole.
    """
    angle = min(radius_km / geo.LEAST_RADIUS_KM, math.pi)
    reach = math.degrees(angle)
    tile = max(reach / 2, 0.05)
    wide = max(1, math.ceil(360 / tile))
    across = 360 / wide
    c = centers.withColumns({"_dy": F.lit(reach + 1e-8) + halo_lat, "_dx": F.least(F.lit(180.0), _longitude_reach(F.col("c_lat"), angle) + halo_lon + 1e-8)})
    row = lambda y: F.floor(y / tile).cast("int")
    column = lambda x: F.floor((x + 180.0) / across).cast("int")
    west, east = column(F.col("c_lon") - F.col("_dx")), column(F.col("c_lon") + F.col("_dx"))
    over = F.array_distinct(F.transform(F.sequence(west, F.least(east, west + wide)), lambda t: F.pmod(t, F.lit(wide))))
    c = c.where("c_lat IS NOT NULL AND c_lon IS NOT NULL AND NOT isnan(c_lat + c_lon)").withColumn("_ty", F.explode(F.sequence(row(F.col("c_lat") - F.col("_dy")), row(F.col("c_lat") + F.col("_dy"))))).withColumn("_tx", F.explode(over))
    cell = grid.withColumns({"_ty": row(F.col("latitude")), "_tx": F.pmod(column(F.col("longitude")), F.lit(wide))})
    near = c.join(cell, [*keys, "_ty", "_tx"]).withColumn("longitude", geo.unwrap_longitude("longitude", "c_lon"))
    inside = (F.abs(F.col("latitude") - F.col("c_lat")) <= F.col("_dy")) & (F.abs(F.col("longitude") - F.col("c_lon")) <= F.col("_dx"))
    return near.where(inside).drop("_ty", "_tx", "_dy", "_dx")


def disk_stats(centers: DataFrame, grid: DataFrame, keys: Sequence[str], radius_km: float, zeta: str = "zeta") -> DataFrame:
    """centers (keys, center_id, c_lat, c_lon, hemisphere) with the disk's largest wind, its largest and least vorticity by hemisphere, and missing if any value in it is.

    A center meets the cells of its own field in the tiles its disk touches, then those within the
    distance.
    """
    g = grid.select(*keys, "latitude", "longitude", "u10", "v10", zeta)
    near = windows(centers, g, keys, radius_km).where(geo.distance_km("c_lat", "c_lon", "latitude", "longitude") <= radius_km)
    wind, turn = scalar.finite(scalar.wind_speed("u10", "v10")), scalar.finite(F.col(zeta))
    return near.groupBy(*keys, "center_id").agg(F.max(wind).alias("vmax10_ms"), F.max(F.col("hemisphere") * turn).alias("cyclonic_vorticity_s"), F.min(F.col("hemisphere") * turn).alias("least_vorticity_s"), F.bool_or(wind.isNull() | turn.isNull()).alias("missing"))


def first_qualifying(candidates: DataFrame, keys: Sequence[str], threshold: float, order: Sequence[str] = ("msl", "distance_km", "latitude", "longitude")) -> DataFrame:
    """keys, center, reason: the first candidate in order without missing data whose vorticity is above threshold.

    Without one the reason is missing_diagnostic_data if any candidate lacked data, else
    vorticity_below_threshold.
    """
    good = ~F.coalesce("missing", F.lit(True)) & (F.col("cyclonic_vorticity_s") > threshold)
    picked = candidates.groupBy(*keys).agg(F.min(F.when(good, F.struct(*order, "vmax10_ms", "cyclonic_vorticity_s"))).alias("center"), F.bool_or(F.coalesce("missing", F.lit(True))).alias("_m"))
    reason = F.when(F.col("center").isNotNull(), "").when(F.col("_m"), "missing_diagnostic_data").otherwise("vorticity_below_threshold")
    return picked.select(*keys, "center", reason.alias("reason"))
