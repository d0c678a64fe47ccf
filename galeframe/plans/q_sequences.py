"""Queries over ordered sequences (E of the inventory) and the flagship episodes query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import aggregates, sequences
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.views import lambert

EPISODES = """
WITH s AS (
  SELECT *, sum(new) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS episode_group FROM (
    SELECT *, CASE WHEN epoch_us(iso_time) - lag(epoch_us(iso_time)) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) > 21600000000 THEN 1 ELSE 0 END AS new FROM contacts)
), e AS (
  SELECT storm_id, episode_group, min(iso_time) AS episode_start, max(iso_time) AS episode_end, count(*) AS contact_rows,
    first(iso_time ORDER BY distance_km, iso_time, fix_id) AS closest_time, min(distance_km) AS closest_km,
    bool_or(r34) AS r34_contact, bool_or(r50) AS r50_contact, bool_or(r64) AS r64_contact, bool_or(proxy) AS proxy_contact, bool_or(landfall) AS landfall_contact
  FROM s GROUP BY ALL
), w AS (
  SELECT e.storm_id, e.episode_group, max(p.wind_kt) AS episode_vmax_kt, avg((p.wind_kt IS NOT NULL)::INTEGER::DOUBLE) AS wind_coverage, avg(p.r34_any::INTEGER::DOUBLE) AS r34_coverage
  FROM e JOIN contact_points p ON p.storm_id = e.storm_id AND p.iso_time BETWEEN e.episode_start - INTERVAL 6 HOUR AND e.episode_end + INTERVAL 6 HOUR GROUP BY ALL
), q AS (
  SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY episode_start, episode_group) AS n FROM e JOIN w USING (storm_id, episode_group) WHERE episode_vmax_kt >= 64
)
SELECT storm_id, storm_id::VARCHAR || '-CE' || lpad(n::VARCHAR, 2, '0') AS case_id, n::INTEGER AS episode_index, episode_start, episode_end, contact_rows, closest_time, closest_km,
  episode_vmax_kt, round(wind_coverage, 6) AS wind_coverage, round(r34_coverage, 6) AS r34_coverage, r34_contact, r50_contact, r64_contact,
  round((epoch_us(episode_end) - epoch_us(episode_start)) / 3600000000e0, 6) AS span_hours,
  concat_ws('+', CASE WHEN landfall_contact THEN 'landfall_crossing' END, CASE WHEN r34_contact THEN 'wind_radius' END, CASE WHEN proxy_contact THEN 'distance_proxy' END) AS selection_method,
  CASE WHEN r64_contact THEN 'A' WHEN r50_contact OR landfall_contact THEN 'B' WHEN r34_contact THEN 'C' ELSE 'D' END AS tier
FROM q"""


def episode_table(spark: SparkSession, d: str) -> DataFrame:
    grouped = sequences.sessions(views.contacts(spark, d), "storm_id", "iso_time", "fix_id")
    return aggregates.episodes(grouped, views.contact_points(spark, d))


@query(EPISODES, ("contacts",))
def episodes(spark: SparkSession, d: str) -> DataFrame:
    """For each storm: which contact episodes occurred, when, how close, how strong, which tier."""
    e = episode_table(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return e.select("storm_id", "case_id", "episode_index", "episode_start", "episode_end", "contact_rows", "closest_time", "closest_km", "episode_vmax_kt", r("wind_coverage"), r("r34_coverage"), "r34_contact", "r50_contact", "r64_contact", r("span_hours"), "selection_method", "tier")


@query("""SELECT storm_id, fix_id, sum(new) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id)::INTEGER AS episode_group FROM (
 SELECT *, CASE WHEN epoch_us(iso_time) - lag(epoch_us(iso_time)) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) > 21600000000 THEN 1 ELSE 0 END AS new FROM contacts)""", ("contacts",))
def e01_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sessions(views.contacts(spark, d), "storm_id", "iso_time", "fix_id").select("storm_id", "fix_id", "episode_group")


@query(f"""SELECT a_fix AS fix_id, b_fix AS next_fix, segment, round(hours, 6) AS hours, hours > 6 AS gap, round({lambert("a_lat", "a_lon", "b_lat", "b_lon")}, 6) AS km FROM (
 SELECT fix_id AS a_fix, lat AS a_lat, lon AS a_lon, lead(fix_id) OVER w AS b_fix, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon,
  row_number() OVER w - 1 AS segment, (lead(epoch_us(iso_time)) OVER w - epoch_us(iso_time)) / 3600000000e0 AS hours FROM fixes WINDOW w AS (PARTITION BY storm_id ORDER BY iso_time, fix_id)) WHERE hours > 0""", ("fixes",))
def e02_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = sequences.consecutive_pairs(views.fixes(spark, d), "storm_id", "iso_time", "fix_id", ["lat", "lon"])
    return p.select(F.col("a_fix_id").alias("fix_id"), F.col("b_fix_id").alias("next_fix"), F.col("segment").cast("long").alias("segment"), F.round("hours", 6).alias("hours"), "gap", F.round(geo.distance_km("a_lat", "a_lon", "b_lat", "b_lon"), 6).alias("km"))


@query(f"""SELECT a_fix AS fix_id, step, round(step / n::DOUBLE, 6) AS fraction, round(a_w + step / n::DOUBLE * (b_w - a_w), 6) AS wind FROM (SELECT *, unnest(range(1, n + 1)) AS step FROM (
 SELECT *, greatest(1, ceil(round({lambert("a_lat", "a_lon", "b_lat", "b_lon")}, 6) / 100e0)::BIGINT, ceil(hours)::BIGINT) AS n FROM (
 SELECT fix_id AS a_fix, wind_kt AS a_w, lat AS a_lat, lon AS a_lon, lead(wind_kt) OVER w AS b_w, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon,
  (lead(epoch_us(iso_time)) OVER w - epoch_us(iso_time)) / 3600000000e0 AS hours FROM fixes WINDOW w AS (PARTITION BY storm_id ORDER BY iso_time, fix_id)) WHERE hours > 0 AND hours <= 6))""", ("fixes",))
def e03_densify_linear(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a densified track with linear values; positions by the column formula, so that SQL can follow."""
    p = sequences.consecutive_pairs(views.fixes(spark, d), "storm_id", "iso_time", "fix_id", ["lat", "lon", "wind_kt"])
    s = sequences.steps_between(p, 100.0, 1.0, length=F.round(geo.distance_km("a_lat", "a_lon", "b_lat", "b_lon"), 6))
    return s.select(F.col("a_fix_id").alias("fix_id"), F.col("step").cast("long").alias("step"), F.round("fraction", 6).alias("fraction"), F.round(scalar.interpolate("a_wind_kt", "b_wind_kt", "fraction"), 6).alias("wind"))


@query()
def e03_densify_exact(spark: SparkSession, d: str) -> DataFrame:
    """The whole densified track along ellipsoidal geodesics."""
    f = views.fixes(spark, d)
    dense = sequences.densify(f, ["wind_kt", "r34_ne"], ["nature", "basin"], spacing_km=50.0)
    return dense.select("storm_id", "iso_time", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("wind_kt", 6).alias("wind_kt"), "nature", "source_row", "source_segment", "is_original", "segment_break_before")


@query("""SELECT storm_id, n::INTEGER AS qualifying, fix_id FROM (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS n FROM fixes WHERE wind_kt >= 64 AND iso_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25')""", ("fixes",))
def e04_qualifying_ordinal(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    f = views.fixes(spark, d).where(F.col("wind_kt") >= 64).where(F.col("iso_time").between(F.to_timestamp_ntz(F.lit("2024-01-05")), F.to_timestamp_ntz(F.lit("2024-01-25"))))
    return f.select("storm_id", F.row_number().over(Window.partitionBy("storm_id").orderBy("iso_time", "fix_id")).alias("qualifying"), "fix_id")


@query("""
WITH RECURSIVE x AS (
  SELECT storm_id, row_number() OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS n, wind_kt FROM fixes
), f AS (
  SELECT storm_id, n, wind_kt AS held, true AS ok FROM x WHERE n = 1
  UNION ALL
  SELECT x.storm_id, x.n, CASE WHEN f.ok AND abs(x.wind_kt - f.held) <= 120 THEN x.wind_kt ELSE f.held END, f.ok AND abs(x.wind_kt - f.held) <= 120
  FROM f JOIN x ON x.storm_id = f.storm_id AND x.n = f.n + 1
)
SELECT storm_id, n::INTEGER AS step, held, CASE WHEN ok THEN 'ok' ELSE 'lost' END AS status FROM f""", ("fixes",))
def e05_fold_1d(spark: SparkSession, d: str) -> DataFrame:
    """The tracker's fold in one dimension: each step is judged against the last one kept, and a loss is final."""
    return sequences.hold_or_lose(views.fixes(spark, d), "storm_id", ["iso_time", "fix_id"], "wind_kt", 120.0)


@query("""SELECT storm_id, max(CASE WHEN ok THEN n END)::INTEGER AS last_ok, min(CASE WHEN NOT ok THEN n END)::INTEGER AS first_bad,
 first(nature ORDER BY n) FILTER (WHERE NOT ok) AS first_bad_status FROM (SELECT *, nature NOT IN ('error', 'signup') AS ok, row_number() OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS n FROM fixes) GROUP BY storm_id""", ("fixes",))
def e08_first_last(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    f = views.fixes(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("storm_id").orderBy("iso_time", "fix_id")))
    f = f.withColumn("status", F.when(F.col("nature").isin("error", "signup"), F.col("nature")).otherwise("ok"))
    return sequences.first_and_last(f, ["storm_id"], "n")


@query("""SELECT storm_id, fix_id, sum(CASE WHEN h > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id)::INTEGER AS line FROM (
 SELECT *, (epoch_us(iso_time) - lag(epoch_us(iso_time)) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id)) / 3600000000e0 AS h FROM fixes)""", ("fixes",))
def e09_line_splits(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sessions(views.fixes(spark, d), "storm_id", "iso_time", "fix_id", 12.0, "line").select("storm_id", "fix_id", "line")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS n, CASE WHEN nature <> 'click' THEN wind_kt END AS v FROM fixes),
b AS (SELECT *, last(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY storm_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bn,
  first(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY storm_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fn FROM a)
SELECT b.fix_id, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN l.v IS NOT NULL AND r.v IS NOT NULL THEN l.v + (r.v - l.v) * (b.n - b.bn) / (b.fn - b.bn) ELSE coalesce(l.v, r.v) END, 6) AS filled
FROM b LEFT JOIN a l ON l.storm_id = b.storm_id AND l.n = b.bn LEFT JOIN a r ON r.storm_id = b.storm_id AND r.n = b.fn""", ("fixes",))
def e10_fill(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumn("v", F.when(F.col("nature") != "click", F.col("wind_kt")))
    return sequences.fill_both_ways(f, "storm_id", ["iso_time", "fix_id"], "v", "filled").select("fix_id", F.round("filled", 6).alias("filled"))


@query("""SELECT message_id, lead_hours, CASE WHEN coalesce(bool_or(bad) OVER (PARTITION BY message_id ORDER BY lead_hours ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'terminated' WHEN bad THEN 'lost' ELSE 'ok' END AS status
 FROM (SELECT message_id, lead_hours, bool_or(pressure_hpa IS NULL) AS bad FROM points GROUP BY ALL)""", ("points",))
def e12_terminated(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d).groupBy("message_id", "lead_hours").agg(F.bool_or(F.col("pressure_hpa").isNull()).alias("bad"))
    p = p.withColumn("status", F.when(F.col("bad"), "lost").otherwise("ok"))
    return sequences.terminated_after_failure(p, ["message_id"], "lead_hours", F.col("bad")).select("message_id", "lead_hours", "status")


@query("""SELECT storm_id, init_time, message_id FROM (SELECT *, row_number() OVER (PARTITION BY storm_id, init_time ORDER BY message_id) AS n FROM messages) WHERE n = 1""", ("messages",))
def e11_first_message(spark: SparkSession, d: str) -> DataFrame:
    return views.messages(spark, d).groupBy("storm_id", "init_time").agg(F.min("message_id").alias("message_id"))


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS n, CASE WHEN nature <> 'click' THEN wind_kt END AS v FROM fixes),
b AS (SELECT *, last(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY storm_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bn,
  first(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY storm_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fn FROM a),
f AS (SELECT b.*, CASE WHEN b.v IS NOT NULL THEN b.v WHEN l.v IS NOT NULL AND r.v IS NOT NULL THEN l.v + (r.v - l.v) * (b.n - b.bn) / (b.fn - b.bn) ELSE coalesce(l.v, r.v) END AS filled
  FROM b LEFT JOIN a l ON l.storm_id = b.storm_id AND l.n = b.bn LEFT JOIN a r ON r.storm_id = b.storm_id AND r.n = b.fn)
SELECT x.fix_id, y.fix_id AS next_fix, round(x.lat, 6) AS start_lat, round(x.lon, 6) AS start_lon, round(y.lat, 6) AS end_lat,
  round(CASE WHEN y.lon - x.lon > 180 THEN y.lon - 360e0 WHEN y.lon - x.lon < -180 THEN y.lon + 360e0 ELSE y.lon END, 6) AS end_lon, round((coalesce(x.filled, y.filled) + coalesce(y.filled, x.filled)) / 2e0, 6) AS value
FROM f x JOIN f y ON y.storm_id = x.storm_id AND y.n = x.n + 1 WHERE coalesce(x.filled, y.filled) IS NOT NULL""", ("fixes",))
def a27_h19_line_segments(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumn("v", F.when(F.col("nature") != "click", F.col("wind_kt")))
    r = lambda c: F.round(c, 6).alias(c)
    return sequences.line_segments(f, "storm_id", ["iso_time", "fix_id"], "fix_id", "v").select(F.col("from_id").alias("fix_id"), F.col("to_id").alias("next_fix"), r("start_lat"), r("start_lon"), r("end_lat"), r("end_lon"), r("value"))
