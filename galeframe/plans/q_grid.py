"""Queries over grids and the tracker (A10, H09 to H13, F04, E05)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import grid as g
from galeframe.operators import lineage, tracking
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.views import lambert
from galeframe.sources import adapters, forecast_files, netcdf, zarr

MINIMA = """SELECT a.field_id, a.iy, a.ix, any_value(a.msl) AS msl FROM grid a JOIN grid b ON a.field_id = b.field_id AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1
 GROUP BY 1, 2, 3 HAVING count(*) = 9 AND any_value(a.msl) = min(b.msl) AND min(b.msl) < max(b.msl)"""


@query("SELECT field_id, iy, ix FROM grid WHERE latitude BETWEEN 12e0 - (degrees(150e0 / 6335.439327292814e0) + 0.5e0) AND 12e0 + (degrees(150e0 / 6335.439327292814e0) + 0.5e0) AND abs(longitude - 131e0) <= degrees(asin(sin(150e0 / 6335.439327292814e0) / cos(radians(12e0)))) + 0.5e0", ("grid",))
def a10_window(spark: SparkSession, d: str) -> DataFrame:
    return g.window_cells(views.grid(spark, d), 12.0, 131.0, 150.0).select("field_id", "iy", "ix")


@query(MINIMA, ("grid",))
def h10_local_minima(spark: SparkSession, d: str) -> DataFrame:
    return g.local_minima(views.grid(spark, d), ["field_id"]).select("field_id", "iy", "ix", "msl")


SLOPE = """CASE WHEN {i} = 0 THEN -1.5e0 * {c} + 2e0 * lead({c}, 1) OVER {w} - 0.5e0 * lead({c}, 2) OVER {w} WHEN {i} = 7 THEN 1.5e0 * {c} - 2e0 * lag({c}, 1) OVER {w} + 0.5e0 * lag({c}, 2) OVER {w}
   ELSE (lead({c}, 1) OVER {w} - lag({c}, 1) OVER {w}) / 2e0 END / 0.5e0 / radians(1e0)"""


@query(f"""SELECT field_id, iy, ix, round((dv - du) / (6371000e0 * cos(radians(latitude))) * 1e5, 5) AS zeta FROM (
 SELECT *, {SLOPE.format(i="ix", c="v850", w="east")} AS dv, {SLOPE.format(i="iy", c="uc", w="north")} AS du
 FROM (SELECT *, u850 * cos(radians(latitude)) AS uc FROM grid) WINDOW east AS (PARTITION BY field_id, iy ORDER BY ix), north AS (PARTITION BY field_id, ix ORDER BY iy))""", ("grid",))
def h09_vorticity(spark: SparkSession, d: str) -> DataFrame:
    z = g.vorticity(views.grid(spark, d), ["field_id"])
    return z.select("field_id", "iy", "ix", F.round(F.col("zeta") * 1e5, 5).alias("zeta"))


@query("SELECT field_id, iy, ix, round(sqrt(u10 * u10 + v10 * v10), 6) AS wind FROM grid", ("grid",))
def h13_wind(spark: SparkSession, d: str) -> DataFrame:
    return views.grid(spark, d).select("field_id", "iy", "ix", F.round(scalar.wind_speed("u10", "v10"), 6).alias("wind"))


CANDIDATES = f"""
WITH m AS ({MINIMA}),
c AS (SELECT m.*, 10e0 + m.iy * 0.5e0 AS c_lat, 130e0 + m.ix * 0.5e0 AS c_lon FROM m),
s AS (SELECT c.field_id, c.iy, c.ix, max(c.msl) AS msl, max(c_lat) AS c_lat, max(c_lon) AS c_lon, max(sqrt(u10 * u10 + v10 * v10)) AS wind, max(u850) AS turn, bool_or(v850 > 40) AS missing
  FROM c JOIN grid g ON g.field_id = c.field_id WHERE round({lambert("c_lat", "c_lon", "g.latitude", "g.longitude")}, 6) <= 100 GROUP BY 1, 2, 3)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    cells = views.grid(spark, d)
    low = g.local_minima(cells, ["field_id"]).withColumn("center_id", F.col("iy") * 8 + F.col("ix"))
    centers = low.select("field_id", "center_id", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"), F.lit(1.0).alias("hemisphere"))
    zeta = cells.withColumn("zeta", F.when(F.col("v850") <= 40, F.col("u850")))
    stats = g.disk_stats(centers, zeta, ["field_id"], 100.0)
    return low.join(stats, ["field_id", "center_id"]).withColumn("distance_km", geo.distance_km("latitude", "longitude", F.lit(11.75), F.lit(131.75)))


@query(CANDIDATES + "SELECT field_id, iy, ix, round(wind, 6) AS wind, missing FROM s", ("grid",))
def h11_h12_disks(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("field_id", "iy", "ix", F.round("vmax10_ms", 6).alias("wind"), "missing")


@query(CANDIDATES + f"""SELECT field_id, first(msl ORDER BY msl, round({lambert("c_lat", "c_lon", "11.75e0", "131.75e0")}, 9), c_lat, c_lon) FILTER (WHERE NOT missing AND turn > 12) AS msl,
 CASE WHEN bool_or(NOT missing AND turn > 12) THEN '' WHEN bool_or(missing) THEN 'missing_diagnostic_data' ELSE 'vorticity_below_threshold' END AS reason
 FROM (SELECT field_id, msl, c_lat, c_lon, missing, (SELECT max(u850) FROM grid g WHERE g.field_id = s.field_id AND g.v850 <= 40 AND round({lambert("s.c_lat", "s.c_lon", "g.latitude", "g.longitude")}, 6) <= 100) AS turn FROM s) GROUP BY field_id""", ("grid",))
def f04_first_qualifying(spark: SparkSession, d: str) -> DataFrame:
    picked = g.first_qualifying(_candidates(spark, d), ["field_id"], 12.0)
    return picked.select("field_id", F.col("center.msl").alias("msl"), "reason")


def tracking_grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cases of two leads and their fields: field 2k is 6 h, field 2k+1 12 h of case k."""
    cells = views.grid(spark, d)
    cells = cells.select(F.lit("demo").alias("model"), F.concat(F.lit("F"), F.floor(F.col("field_id") / 2).cast("string")).alias("forecast_case_id"), ((F.col("field_id") % 2 + 1) * 6).cast("int").alias("lead_hours"), "latitude", "longitude", "msl", "u850", "v850", "u10", "v10")
    cases = cells.select("model", "forecast_case_id").distinct().withColumn("k", F.substring("forecast_case_id", 2, 9).cast("int"))
    return cases.select("model", "forecast_case_id", F.lit(12).alias("forecast_hours"), F.when(F.col("k") % 7 != 0, F.lit(11.5)).alias("seed_lat"), F.when(F.col("k") % 7 != 0, F.lit(131.5)).alias("seed_lon")), cells


def _round_trip_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    return f"{lineage.shared_folder(spark)}/netcdf/{uuid.uuid4().hex}"


FIELDS_OF_CASES = """SELECT 'pangu' AS model, 'F' || (field_id // 2)::VARCHAR AS forecast_case_id, (field_id % 2 + 1)::DOUBLE * 6 AS lead_time, latitude, longitude, msl, u10, v10 FROM grid"""


@query(FIELDS_OF_CASES, ("grid",))
def a09_netcdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All fields as a NetCDF file a case, and the cells read back from the files."""
    _, cells = tracking_grid(spark, d)
    cells = cells.withColumn("model", F.lit("pangu"))
    inits = cells.select("model", "forecast_case_id").distinct().withColumn("init_time", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    files = lineage.kept(forecast_files.write_cases(cells, inits, _round_trip_folder(spark)))
    read = netcdf.cells(files.select("model", "forecast_case_id", F.concat("path", F.lit("/surface.nc")).alias("path")), ["msl", "u10", "v10"], ["lead_time", "latitude", "longitude", "msl", "u10", "v10"])
    case = F.element_at(F.split("path", "/"), -2)
    return read.select(F.lit("pangu").alias("model"), case.alias("forecast_case_id"), "lead_time", "latitude", "longitude", "msl", "u10", "v10")


@query("""SELECT field_id::DOUBLE AS init_time, 0e0 AS lead_time, latitude, longitude, msl / 100e0 AS msl, u10, v10, u10 AS z500, u850, v850, v10 AS u200, msl AS v200 FROM grid WHERE latitude > 10.5e0 AND latitude < 13e0""", ("grid",))
def a11_j02_zarr_adapter(spark: SparkSession, d: str) -> DataFrame:
    """All fields as a chunked store, opened and normalised by an adapter; bounds of latitude leave chunks unopened."""
    cells = views.grid(spark, d).withColumn("lead", F.lit(0))
    n = cells.agg(F.max("field_id")).first()[0]
    path = f"{lineage.shared_folder(spark)}/zarr/{uuid.uuid4().hex}"
    names = {"MSLP": "msl", "U10": "u10", "V10": "v10", "U850": "u850", "V850": "v850"}
    dims = ["case", "lead", "lat", "lon"]
    of = lambda name, shape, chunks, own: zarr.Array(name, shape, chunks, np.dtype("<f8"), fill=float("nan"), compressor={"id": "zlib", "level": 1}, filters=({"id": "shuffle", "elementsize": 8},), attributes={"_ARRAY_DIMENSIONS": own})
    fields = [of(k, ((n or 0) + 1, 1, 8, 8), (512, 1, 3, 8), dims) for k in names]
    zarr.write(cells.select("field_id", "lead", "iy", "ix", *[F.col(v).alias(k) for k, v in names.items()]), path, fields, ["field_id", "lead", "iy", "ix"])
    for axis, at, value in (("lat", "iy", "latitude"), ("lon", "ix", "longitude")):
        zarr.write(cells.groupBy(at).agg(F.first(value).alias(axis)), path, [of(axis, (8,), (8,), [axis])], [at])
    fields_of = {"msl": "MSLP", "u10": "U10", "v10": "V10", "u850": "U850", "v850": "V850"}
    demo = adapters.Adapter("demo", "zarr", dict(zip(adapters.DIMENSIONS, dims, strict=True)), fields_of | {"z500": "U10", "u200": "V10", "v200": "MSLP"}, {"msl": lambda c: c / 100.0})
    read = demo.normalize(demo.open_forecast(spark, path, {"latitude": (11.0, 12.5)}))
    return read.where("msl IS NOT NULL")


@query("SELECT model, forecast_case_id, count(*)::BIGINT AS problems FROM (SELECT DISTINCT 'pangu' AS model, 'F' || (field_id // 2)::VARCHAR AS forecast_case_id FROM grid) GROUP BY ALL", ("grid",))
def k07_file_contract(spark: SparkSession, d: str) -> DataFrame:
    """All cases' files against a plan whose horizon is a step too long: a finding about lead_time and about valid_time in each of a case's two files, so four, over four."""
    _, cells = tracking_grid(spark, d)
    cells = cells.withColumn("model", F.lit("pangu"))
    inits = cells.groupBy("model", "forecast_case_id").agg(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("init_time"), F.max("lead_hours").alias("hours"))
    files = lineage.kept(forecast_files.write_cases(cells, inits.drop("hours"), _round_trip_folder(spark)))
    plan = files.join(inits, ["model", "forecast_case_id"]).withColumn("forecast_hours", F.col("hours") + 6)
    found = forecast_files.violations(plan)
    return found.groupBy(F.split("key", "[|]")[0].alias("model"), F.split("key", "[|]")[1].alias("forecast_case_id")).agg((F.count("*") / 4).cast("long").alias("problems"))


@query()
def e05_tracks_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The points of e05_j01_tracker, followed over NetCDF files of the same fields."""
    cases, cells = tracking_grid(spark, d)
    cases, cells = cases.withColumn("model", F.lit("pangu")), cells.withColumn("model", F.lit("pangu"))
    start = cells.select("model", "forecast_case_id").distinct().withColumn("init_time", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    files = lineage.kept(forecast_files.write_cases(cells, start, _round_trip_folder(spark)))
    plan = files.join(cases, ["model", "forecast_case_id"]).join(start, ["model", "forecast_case_id"])
    points = forecast_files.track_files(plan, tracking.TrackerConfig(300.0, 100.0, 1e-5))
    return points.select("forecast_case_id", "lead_hours", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("vmax10_ms", 6).alias("vmax10_ms"), "status", "reason")


@query()
def e05_j01_tracker(spark: SparkSession, d: str) -> DataFrame:
    points = tracking.track(*tracking_grid(spark, d), tracking.TrackerConfig(300.0, 100.0, 1e-5))
    return points.select("model", "forecast_case_id", "lead_hours", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("vmax10_ms", 6).alias("vmax10_ms"), "status", "reason")


@query()
def e08_d12_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return tracking.outcomes(tracking.track(*tracking_grid(spark, d), tracking.TrackerConfig(300.0, 100.0, 1e-5)))
