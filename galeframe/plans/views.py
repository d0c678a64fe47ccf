"""Domain tables over the test tables, each as a DataFrame and as the same thing in SQL.

fixes and contact points come from events, messages and forecast points from orders and lineitem,
ensembles and grids from embeddings, the coast from nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lambert(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL of geo.distance_km."""
    f = repr(geo.FLAT)
    beta = lambda x: f"atan({1 - geo.FLAT!r}::DOUBLE * tan(radians({x})))"
    return f"""(SELECT CASE WHEN h <= 0 THEN 0e0 ELSE {geo.A_KM!r}::DOUBLE * (s - {geo.FLAT / 2!r}::DOUBLE * ((s - sin(s)) * pow(sin(p) * cos(q), 2) / greatest(1e-12, 1e0 - h) + (s + sin(s)) * pow(cos(p) * sin(q), 2) / h)) END
  FROM (SELECT *, asin(sqrt(h)) * 2e0 AS s FROM (SELECT *, least(1e0, sin(q) * sin(q) + cos(b1) * cos(b2) * sin(hl) * sin(hl)) AS h
  FROM (SELECT *, (b1 + b2) / 2e0 AS p, (b2 - b1) / 2e0 AS q FROM (SELECT {beta(lat1)} AS b1, {beta(lat2)} AS b2, radians(({lon2}) - ({lon1})) / 2e0 AS hl)))))""".replace(f, f)


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL of geo.bearing_deg before it is brought into [0, 360)."""
    beta = lambda x: f"atan({1 - geo.FLAT!r}::DOUBLE * tan(radians({x})))"
    return f"""(SELECT degrees(atan2(cos(b2) * sin(dl), cos(b1) * sin(b2) - sin(b1) * cos(b2) * cos(dl)))
  FROM (SELECT {beta(lat1)} AS b1, {beta(lat2)} AS b2, radians(({lon2}) - ({lon1})) AS dl))"""


SQL: dict[str, str] = {
    "fixes": """
  SELECT event_id AS fix_id, user_id AS storm_id, ts AS iso_time,
    (-60 + (user_id * 37) % 120)::DOUBLE + value / 100e0 AS lat,
    ((-180 + (user_id * 53) % 360)::DOUBLE + value / 50e0 + 180e0) % 360e0 - 180e0 AS lon,
    value AS wind_kt, 1010e0 - value / 2e0 AS pressure_hpa,
    CASE WHEN event_type <> 'error' THEN value * 1.5e0 END AS r34_ne, CASE WHEN event_type <> 'error' THEN value * 1.2e0 END AS r34_se,
    CASE WHEN event_type <> 'error' THEN value * 0.8e0 END AS r34_sw, CASE WHEN event_type <> 'error' THEN value * 1e0 END AS r34_nw,
    CASE WHEN user_id % 10 = 0 THEN 'PROVISIONAL' ELSE 'main' END AS track_type, event_type AS nature,
    CASE user_id % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'EP' WHEN 2 THEN 'WP' ELSE 'SI' END AS basin,
    CASE user_id % 4 WHEN 0 THEN 'AL' WHEN 1 THEN 'EP' WHEN 2 THEN 'WP' ELSE 'SH' END || lpad((user_id % 50)::VARCHAR, 2, '0') || '2024' AS atcf_id
  FROM events""",
    "contact_points": f"""
  SELECT *, coalesce(distance_km <= r34_km, false) AS r34, coalesce(distance_km <= r34_km * 0.5e0, false) AS r50,
    coalesce(distance_km <= r34_km * 0.25e0, false) AS r64, r34_km IS NULL AND distance_km <= 100e0 AS proxy,
    distance_km <= 20e0 AS landfall, r34_km IS NOT NULL AS r34_any
  FROM (SELECT *, CASE WHEN coast_lon >= lon THEN r34_se ELSE r34_nw END * 1.852e0 AS r34_km, round({lambert("lat", "lon", "lat", "coast_lon")}, 6) AS distance_km
    FROM (SELECT *, floor((lon + 180e0) / 14.4e0 + 0.5e0) * 14.4e0 - 180e0 AS coast_lon FROM fixes))""",
    "contacts": """
  SELECT * FROM contact_points WHERE r34 OR proxy OR landfall""",
    "messages": """
  SELECT o_orderkey AS message_id, o_custkey AS storm_id, o_orderdate AS init_time, (o_custkey % 120 - 60)::DOUBLE AS lat,
    (o_custkey * 7 % 360 - 180)::DOUBLE AS lon, o_orderpriority AS source_file FROM orders""",
    "points": """
  SELECT l_orderkey AS message_id, (6 * l_linenumber)::INTEGER AS lead_hours, l_quantity AS latitude, l_discount * 100e0 AS longitude,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE 900e0 + l_quantity END AS pressure_hpa,
    CASE WHEN l_linestatus = 'F' AND l_tax > 0.07 THEN NULL ELSE l_extendedprice / 1000e0 END AS max_wind_ms FROM lineitem""",
    "schedule_events": """
  SELECT 'E' || event_id::VARCHAR AS case_id, user_id AS storm_id, ts AS reference_time FROM events WHERE event_type = 'purchase'""",
    "members": """
  SELECT vec_id AS forecast_id, label, i - 1 AS member, embedding[i]::DOUBLE * 100e0 AS value, label::DOUBLE AS truth
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""",
    "grid": """
  SELECT vec_id AS field_id, ((i - 1) // 8)::INTEGER AS iy, ((i - 1) % 8)::INTEGER AS ix, 10e0 + ((i - 1) // 8) * 0.5e0 AS latitude,
    130e0 + ((i - 1) % 8) * 0.5e0 AS longitude, 100000e0 + embedding[i]::DOUBLE * 1000e0 AS msl, embedding[65 - i]::DOUBLE * 100e0 AS u850,
    embedding[(i * 7) % 64 + 1]::DOUBLE * 100e0 AS v850, embedding[(i * 5) % 64 + 1]::DOUBLE * 50e0 AS u10, embedding[(i * 3) % 64 + 1]::DOUBLE * 50e0 AS v10
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""",
    "coast": """
  SELECT n_nationkey::BIGINT AS segment_id, -180e0 + 14.4e0 * n_nationkey AS lon_a, -60e0 AS lat_a, -180e0 + 14.4e0 * n_nationkey AS lon_b, 60e0 AS lat_b FROM nation""",
}


def with_views(uses: tuple[str, ...], sql: str) -> str:
    """sql behind the definitions of the views it uses, and of those that they use."""
    needs = {"contact_points": ("fixes",), "contacts": ("fixes", "contact_points")}
    wanted = {v for u in uses for v in (*needs.get(u, ()), u)}
    heads = [f"{name} AS ({text})" for name, text in SQL.items() if name in wanted]
    if not heads:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(heads) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(heads) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(heads) + "\n" + body


def fixes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    u, v = F.col("user_id"), F.col("value")
    seen = lambda k: F.when(F.col("event_type") != "error", v * F.lit(k))
    east = (F.lit(-180) + (u * 53) % 360).cast("double") + v / 50.0
    basin = F.when(u % 4 == 0, "NA").when(u % 4 == 1, "EP").when(u % 4 == 2, "WP").otherwise("SI")
    letters = F.when(u % 4 == 0, "AL").when(u % 4 == 1, "EP").when(u % 4 == 2, "WP").otherwise("SH")
    return e.select(
        F.col("event_id").alias("fix_id"), u.alias("storm_id"), F.col("ts").alias("iso_time"), ((F.lit(-60) + (u * 37) % 120).cast("double") + v / 100.0).alias("lat"), geo.wrap_longitude(east).alias("lon"),
        v.alias("wind_kt"), (F.lit(1010.0) - v / 2.0).alias("pressure_hpa"), seen(1.5).alias("r34_ne"), seen(1.2).alias("r34_se"), seen(0.8).alias("r34_sw"), seen(1.0).alias("r34_nw"),
        F.when(u % 10 == 0, "PROVISIONAL").otherwise("main").alias("track_type"), F.col("event_type").alias("nature"), basin.alias("basin"), F.concat(letters, F.lpad((u % 50).cast("string"), 2, "0"), F.lit("2024")).alias("atcf_id"),
    )


def contact_points(spark: SparkSession, d: str) -> DataFrame:
    """fixes with the distance from the nearest coast meridian and the contact flags."""
    f = fixes(spark, d).withColumn("coast_lon", F.floor((F.col("lon") + 180.0) / 14.4 + 0.5).cast("double") * 14.4 - 180.0)
    east = F.when(F.col("coast_lon") >= F.col("lon"), 90.0).otherwise(270.0)
    f = f.withColumn("r34_km", geo.quadrant_radius_km(east, "r34_ne", "r34_se", "r34_sw", "r34_nw")).withColumn("distance_km", F.round(geo.distance_km("lat", "lon", "lat", "coast_lon"), 6))
    within = lambda k: F.coalesce(F.col("distance_km") <= F.col("r34_km") * k, F.lit(False))
    return f.withColumns({"r34": F.coalesce(F.col("distance_km") <= F.col("r34_km"), F.lit(False)), "r50": within(0.5), "r64": within(0.25), "proxy": F.col("r34_km").isNull() & (F.col("distance_km") <= 100.0), "landfall": F.col("distance_km") <= 20.0, "r34_any": F.col("r34_km").isNotNull()})


def contacts(spark: SparkSession, d: str) -> DataFrame:
    return contact_points(spark, d).where("r34 OR proxy OR landfall")


def messages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), k.alias("storm_id"), F.col("o_orderdate").alias("init_time"), (k % 120 - 60).cast("double").alias("lat"), (k * 7 % 360 - 180).cast("double").alias("lon"), F.col("o_orderpriority").alias("source_file"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("message_id"), (F.col("l_linenumber") * 6).alias("lead_hours"), F.col("l_quantity").alias("latitude"), (F.col("l_discount") * 100.0).alias("longitude"),
        F.when(F.col("l_returnflag") == "R", None).otherwise(F.lit(900.0) + F.col("l_quantity")).alias("pressure_hpa"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.07), None).otherwise(F.col("l_extendedprice") / 1000.0).alias("max_wind_ms"),
    )


def schedule_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("case_id"), F.col("user_id").alias("storm_id"), F.col("ts").alias("reference_time"))


def members(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("member", "x"))
    return e.select(F.col("vec_id").alias("forecast_id"), "label", F.col("member").cast("long").alias("member"), (F.col("x").cast("double") * 100.0).alias("value"), F.col("label").cast("double").alias("truth"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("p", "x"))
    i = F.col("p") + 1
    at = lambda k: F.get("embedding", k).cast("double")
    iy, ix = F.floor(F.col("p") / 8).cast("int"), F.col("p") % 8
    return e.select(
        F.col("vec_id").alias("field_id"), iy.alias("iy"), ix.cast("int").alias("ix"), (F.lit(10.0) + iy * 0.5).alias("latitude"), (F.lit(130.0) + ix * 0.5).alias("longitude"), (F.lit(100000.0) + F.col("x").cast("double") * 1000.0).alias("msl"),
        (at(64 - i) * 100.0).alias("u850"), (at(i * 7 % 64) * 100.0).alias("v850"), (at(i * 5 % 64) * 50.0).alias("u10"), (at(i * 3 % 64) * 50.0).alias("v10"),
    )


def coast(spark: SparkSession, d: str) -> DataFrame:
    k = F.lit(-180.0) + F.lit(14.4) * F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("segment_id"), k.alias("lon_a"), F.lit(-60.0).alias("lat_a"), k.alias("lon_b"), F.lit(60.0).alias("lat_b"))


def micros_sql(x: str) -> str:
    return f"epoch_us({x})"


__all__ = ["SQL", "scalar", "with_views"]
