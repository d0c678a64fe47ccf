"""Queries over scans of typed text (A of the inventory); file formats have tests of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import scalar
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.sources import bufr, bufr_bodies, tables


@query("""SELECT event_id, TRY_CAST(t AS DOUBLE) AS wind, lower(event_type) AS kind FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'kts' WHEN event_id % 4 = 1 THEN '' ELSE value::VARCHAR END AS t FROM events)""")
def a01_parse_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    e = views.table(spark, d, "events").withColumn("t", F.when(k == 0, "kts").when(k == 1, "").otherwise(F.col("value").cast("string")))
    return e.select("event_id", F.expr("try_cast(nullif(trim(t), '') AS DOUBLE)").alias("wind"), F.lower("event_type").alias("kind"))


@query("""SELECT fix_id, upper(atcf_id) AS atcf_id FROM fixes WHERE track_type = 'main' AND nature IN ('view', 'click') AND iso_time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09'""", ("fixes",))
def a02_truth_filter(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d)
    span = F.col("iso_time").between(F.to_timestamp_ntz(F.lit("2024-01-02")), F.to_timestamp_ntz(F.lit("2024-01-09")))
    return f.where(span & (F.lower("track_type") == "main") & F.col("nature").isin("view", "click")).select("fix_id", F.upper("atcf_id").alias("atcf_id"))


@query("""SELECT 'S' || o_orderkey::VARCHAR || '-L' || lpad((o_orderkey % 5 * 24 + 24)::VARCHAR, 3, '0') AS forecast_case_id, 'S' || o_orderkey::VARCHAR AS case_id, (o_orderkey % 5 * 24 + 24)::INTEGER AS lead FROM orders WHERE (o_orderkey % 40) % 6 = 0""")
def a05_case_scan(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").withColumn("forecast_case_id", scalar.forecast_case_id(F.concat(F.lit("S"), F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 5 * 24 + 24))
    return o.where((F.col("o_orderkey") % 40) % 6 == 0).withColumn("s", scalar.split_case_id("forecast_case_id")).select("forecast_case_id", "s.case_id", "s.lead")


@query("SELECT p_partkey, p_retailprice AS listed, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS found FROM part WHERE p_partkey % 5 = 0 OR p_retailprice <> p_size")
def a20_size_differences(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part")
    listed = p.select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("length"))
    found = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("double").alias("length"))
    return tables.size_differences(listed, found).withColumnRenamed("path", "p_partkey")


@query("""WITH e AS (SELECT vec_id, unnest(range(0, vec_id % 5 + 1)) AS k, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::INTEGER) AS c FROM embeddings),
l AS (SELECT vec_id::VARCHAR AS message_id, (6 * k)::INTEGER AS lead_hours, CASE WHEN (vec_id + k) % 7 <> 0 THEN c[k + 1] * 5 END AS y, CASE WHEN (vec_id + k) % 7 <> 0 THEN c[k + 11] * 17 END AS x, abs(c[k + 21]) % 1000 AS p, abs(c[k + 31]) % 600 AS w, abs(c[k + 41]) AS r, abs(c[k + 1]) AS s FROM e)
SELECT message_id, lead_hours, y / 100e0 AS latitude, (x / 100e0 + 180e0) % 360e0 + CASE WHEN (x / 100e0 + 180e0) % 360e0 < 0 THEN 360e0 ELSE 0e0 END - 180e0 AS longitude, (90000 + 10 * p) / 100e0 AS pressure_hpa, w / 10e0 AS max_wind_ms,
 CASE WHEN r % 11 <> 0 THEN (r % 500)::DOUBLE END AS radius_18ms_ne_km, CASE WHEN s % 11 <> 0 THEN (s % 500)::DOUBLE END AS radius_33ms_nw_km FROM l""")
def a14_bufr_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a track message, encoded, decoded and reshaped to one row a lead."""
    c = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    e = views.table(spark, d, "embeddings").select("vec_id", c.alias("c"), F.sequence(F.lit(0), (F.col("vec_id") % 5).cast("int")).alias("k"))
    at = lambda k, n: F.get("c", k + F.lit(n))
    each = lambda f: F.transform("k", f)
    there = lambda k, v: F.when((F.col("vec_id") + k) % 7 != 0, v)
    radius = lambda v: F.when(v % 11 != 0, (v % 500) * F.lit(1000.0))
    t = e.select(
        F.col("vec_id").cast("string").alias("message_id"), F.to_timestamp_ntz(F.lit("2024-01-02 06:00:00")).alias("init_time"), F.lit("01L").alias("storm_identifier"), F.lit("ONE").alias("storm_name"), F.lit(52).alias("member_number"),
        F.lit(10.0).alias("observed_latitude"), F.lit(-50.0).alias("observed_longitude"), each(lambda k: k * 6).alias("lead_hours"),
        each(lambda k: there(k, at(k, 0) * 5 / 100.0)).alias("latitude"), each(lambda k: there(k, at(k, 10) * 17 / 100.0)).alias("longitude"),
        each(lambda k: F.lit(90000.0) + F.abs(at(k, 20)) % 1000 * 10).alias("pressure_pa"), each(lambda k: F.abs(at(k, 30)) % 600 / 10.0).alias("wind_ms"),
        F.flatten(each(lambda k: F.concat(F.array(radius(F.abs(at(k, 40)))), F.array_repeat(F.lit(None).cast("double"), 10), F.array(radius(F.abs(at(k, 0))))))).alias("radii_m"),
    )
    points = bufr.reshape_points(bufr_bodies.readable(bufr_bodies.tracks(bufr_bodies.encode_tracks(t))))
    return points.select("message_id", "lead_hours", "latitude", "longitude", "pressure_hpa", "max_wind_ms", "radius_18ms_ne_km", "radius_33ms_nw_km")
