"""Queries over coasts (C05 to C07, E06, E07, A08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators import crossings, sequences, spatial
from galeframe.plans import views
from galeframe.plans.registry import query


def _coast_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = views.table(spark, d, "nation").select(k.cast("long").alias("segment_id"), (F.lit(-180.0) + F.lit(14.4) * k).alias("s_lon"))
    return n.withColumn("s_lat", F.explode(F.sequence(F.lit(-60), F.lit(60), F.lit(2)).cast("array<double>")))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return views.fixes(spark, d).select(F.col("fix_id").alias("point_id"), "lat", "lon")


@query("""
WITH s AS (SELECT n_nationkey::BIGINT AS segment_id, -180e0 + 14.4e0 * n_nationkey AS s_lon, y::DOUBLE AS s_lat FROM nation, (SELECT unnest(range(-60, 61, 2)) AS y)),
u AS (SELECT segment_id, cos(radians(s_lat)) * cos(radians(s_lon)) AS x, cos(radians(s_lat)) * sin(radians(s_lon)) AS y, sin(radians(s_lat)) AS z FROM s),
p AS (SELECT fix_id AS point_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM fixes),
c AS (SELECT point_id, segment_id, round(min((p.x - u.x) * (p.x - u.x) + (p.y - u.y) * (p.y - u.y) + (p.z - u.z) * (p.z - u.z)), 9) AS chord2 FROM p, u GROUP BY 1, 2)
SELECT point_id, rank::INTEGER AS rank, segment_id, chord2 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY chord2, segment_id) AS rank FROM c) WHERE rank <= 3""", ("fixes",))
def c05_nearest_segments(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.nearest_segments(_points(spark, d), _coast_samples(spark, d), 3, digits=9)
    return found.select("point_id", "rank", "segment_id", F.round("chord2", 9).alias("chord2"))


@query()
def c05_h05_distance_to_segments(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest_place(_points(spark, d), _coast_samples(spark, d), views.coast(spark, d), 3)
    return out.select("point_id", "segment_id", F.round("distance_km", 6).alias("distance_km"), F.round("fraction", 6).alias("fraction"))


EDGES = """edges AS (SELECT n_nationkey AS ring_id, x0 AS lon_a, y0 AS lat_a, x1 AS lon_b, y1 AS lat_b FROM (SELECT n_nationkey, -180e0 + 14.4e0 * n_nationkey AS a, -30e0 + n_nationkey AS b FROM nation),
 LATERAL (SELECT unnest([a, a + 6e0, a + 6e0, a]) AS x0, unnest([b, b, b + 25e0, b + 25e0]) AS y0, unnest([a + 6e0, a + 6e0, a, a]) AS x1, unnest([b, b + 25e0, b + 25e0, b]) AS y1))"""


def land_edges(spark: SparkSession, d: str) -> DataFrame:
    """One square of land east of each coast meridian."""
    n = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("ring_id"), (F.lit(-180.0) + F.lit(14.4) * F.col("n_nationkey")).alias("a"), (F.lit(-30.0) + F.col("n_nationkey")).alias("b"))
    a, b = F.col("a"), F.col("b")
    e = lambda x0, y0, x1, y1: F.struct(x0.alias("lon_a"), y0.alias("lat_a"), x1.alias("lon_b"), y1.alias("lat_b"))
    sides = F.array(e(a, b, a + 6.0, b), e(a + 6.0, b, a + 6.0, b + 25.0), e(a + 6.0, b + 25.0, a, b + 25.0), e(a, b + 25.0, a, b))
    return n.select("ring_id", F.explode(sides).alias("e")).select("ring_id", "e.*")


@query("WITH " + EDGES + """ SELECT fix_id AS point_id, EXISTS (SELECT 1 FROM (SELECT ring_id, sum(((lat_a > lat) <> (lat_b > lat) AND lon_a + (lat - lat_a) * (lon_b - lon_a) / (lat_b - lat_a) > lon)::INTEGER) AS n,
  bool_or(abs((lon_b - lon_a) * (lat - lat_a) - (lat_b - lat_a) * (lon - lon_a)) < 1e-12 AND lon BETWEEN least(lon_a, lon_b) AND greatest(lon_a, lon_b) AND lat BETWEEN least(lat_a, lat_b) AND greatest(lat_a, lat_b)) AS on_edge
  FROM edges GROUP BY ring_id) WHERE n % 2 = 1 OR on_edge) AS is_land FROM fixes""", ("fixes",))
def c06_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.covered_by(_points(spark, d), land_edges(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = sequences.consecutive_pairs(views.fixes(spark, d), "storm_id", "iso_time", "fix_id", ["lat", "lon"]).where("NOT gap")
    return p.select(F.col("a_fix_id").alias("pair_id"), "a_lat", "a_lon", "b_lat", "b_lon")


@query()
def c07_e06_e07_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Track pairs that cross a square's sides, near ones merged, as landfall, exit or tangent."""
    edges = land_edges(spark, d).withColumn("segment_id", F.xxhash64("ring_id", "lon_a", "lat_a"))
    pairs = _pairs(spark, d)
    found = crossings.merge_close(crossings.crossings(pairs, edges))
    kinds = crossings.classify(found, pairs, edges)
    return kinds.select("pair_id", F.round("fraction", 6).alias("fraction"), F.round("lat", 6).alias("lat"), geo.round_longitude("lon", 6).alias("lon"), "crossing_type")


def _unit_sql(lat: str, lon: str) -> str:
    return f"{{'x': cos(radians({lat})) * cos(radians({lon})), 'y': cos(radians({lat})) * sin(radians({lon})), 'z': sin(radians({lat}))}}"


def _cross_sql(a: str, b: str) -> str:
    return "{" + ", ".join(f"'{k}': {a}.{i} * {b}.{j} - {a}.{j} * {b}.{i}" for k, i, j in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))) + "}"


def _dot_sql(a: str, b: str) -> str:
    return f"({a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)"


INSIDE = 1e-9  # both sides leave out crossings at a pair's very ends, which rounding decides


@query(f"""WITH sides AS (SELECT n_nationkey * 4 + k AS segment_id, x0, y0, x1, y1 FROM (SELECT n_nationkey, -180e0 + 14.4e0 * n_nationkey AS a, -30e0 + n_nationkey AS b FROM nation),
 LATERAL (SELECT unnest([0, 1, 2, 3]) AS k, unnest([a, a + 6e0, a + 6e0, a]) AS x0, unnest([b, b, b + 25e0, b + 25e0]) AS y0, unnest([a + 6e0, a + 6e0, a, a]) AS x1, unnest([b, b + 25e0, b + 25e0, b]) AS y1)),
e AS (SELECT *, {_cross_sql("c", "d")} AS m FROM (SELECT segment_id, {_unit_sql("y0", "x0")} AS c, {_unit_sql("y1", "x1")} AS d FROM sides)),
p AS (SELECT *, {_cross_sql("a", "b")} AS n FROM (SELECT pair_id, {_unit_sql("a_lat", "a_lon")} AS a, {_unit_sql("b_lat", "b_lon")} AS b FROM (
 SELECT fix_id AS pair_id, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon, (lead(epoch_us(iso_time)) OVER w - epoch_us(iso_time)) / 3600000000e0 AS hours
 FROM fixes WINDOW w AS (PARTITION BY storm_id ORDER BY iso_time, fix_id)) WHERE hours > 0 AND hours <= 6)),
q AS (SELECT *, {_cross_sql("n", "m")} AS v FROM p, e),
g AS (SELECT *, sign({_dot_sql("v", "a")} + {_dot_sql("v", "b")}) / sqrt({_dot_sql("v", "v")}) AS s FROM q WHERE {_dot_sql("v", "v")} > 0),
r AS (SELECT *, {{'x': v.x * s, 'y': v.y * s, 'z': v.z * s}} AS u FROM g),
t AS (SELECT *, {_cross_sql("a", "u")} AS au, {_cross_sql("c", "u")} AS cu, {_cross_sql("u", "d")} AS ud FROM r),
f AS (SELECT *, atan2({_dot_sql("au", "n")} / sqrt({_dot_sql("n", "n")}), {_dot_sql("a", "u")}) / atan2(sqrt({_dot_sql("n", "n")}), {_dot_sql("a", "b")}) AS fraction FROM t WHERE {_dot_sql("cu", "m")} >= 0 AND {_dot_sql("ud", "m")} >= 0)
SELECT pair_id, segment_id::BIGINT AS segment_id, round(fraction, 6) AS fraction, round(degrees(asin(u.z)), 6) AS lat, round(degrees(atan2(u.y, u.x)), 6) AS lon FROM f WHERE fraction BETWEEN {INSIDE} AND 1 - {INSIDE}""", ("fixes",))
def c07_sphere_crossings(spark: SparkSession, d: str) -> DataFrame:
    """The crossings of track pairs and the sides of all squares, on a sphere."""
    a, b = F.col("_a"), F.col("_b")
    n = views.table(spark, d, "nation").select("n_nationkey", (F.lit(-180.0) + F.lit(14.4) * F.col("n_nationkey")).alias("_a"), (F.lit(-30.0) + F.col("n_nationkey")).alias("_b"))
    side = lambda k, x0, y0, x1, y1: F.struct((F.col("n_nationkey") * 4 + k).cast("long").alias("segment_id"), x0.alias("lon_a"), y0.alias("lat_a"), x1.alias("lon_b"), y1.alias("lat_b"))
    sides = n.select(F.inline(F.array(side(0, a, b, a + 6.0, b), side(1, a + 6.0, b, a + 6.0, b + 25.0), side(2, a + 6.0, b + 25.0, a, b + 25.0), side(3, a, b + 25.0, a, b))))
    found = crossings.crossings(_pairs(spark, d), sides, flattening=0.0).where(F.col("fraction").between(INSIDE, 1 - INSIDE))
    return found.select("pair_id", "segment_id", F.round("fraction", 6).alias("fraction"), F.round("lat", 6).alias("lat"), geo.round_longitude("lon", 6).alias("lon"))


@query("SELECT segment_id, lon_a, lat_a, lon_b, lat_b FROM coast", ("coast",))
def a08_segment_source(spark: SparkSession, d: str) -> DataFrame:
    return views.coast(spark, d).select("segment_id", "lon_a", "lat_a", "lon_b", "lat_b")
