"""Queries over joins (C of the inventory) and set operations (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators import joins, validation
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.views import lambert


def _cases(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d)
    return f.select(F.concat(F.lit("C"), F.col("fix_id").cast("string")).alias("forecast_case_id"), "storm_id", F.col("iso_time").alias("init_time"))


@query("""SELECT 'C' || a.fix_id::VARCHAR AS forecast_case_id, b.lat AS seed_lat, b.fix_id IS NOT NULL AS has_seed FROM fixes a LEFT JOIN fixes b ON b.storm_id = a.storm_id AND b.iso_time = a.iso_time AND b.track_type = 'main'""", ("fixes",))
def c01_seed_lookup(spark: SparkSession, d: str) -> DataFrame:
    return joins.with_seed(_cases(spark, d), views.fixes(spark, d)).select("forecast_case_id", "seed_lat", "has_seed")


@query("""WITH t AS (SELECT DISTINCT user_id AS storm_id, date_trunc('hour', ts)::TIMESTAMP AS iso_time FROM events)
SELECT a.storm_id, a.iso_time AS init_time, l AS lead_hours, b.iso_time AS valid_time FROM t a, (SELECT unnest([6, 12, 24]) AS l) JOIN t b ON b.storm_id = a.storm_id AND b.iso_time = a.iso_time + l * INTERVAL 1 HOUR""")
def c02_lead_opportunities(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "events").select(F.col("user_id").alias("storm_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("iso_time")).distinct()
    return joins.lead_opportunities(t, [6, 12, 24])


IDENTITY = f"""
WITH t AS (SELECT storm_id AS sid, init_time, lat AS t_lat, lon AS t_lon FROM (SELECT DISTINCT storm_id, init_time, lat + 0.3e0 AS lat, lon + 0.2e0 AS lon FROM messages WHERE storm_id % 3 <> 0)),
c AS (SELECT message_id, sid, km FROM (SELECT m.message_id, t.sid, round({lambert("m.lat", "m.lon", "t.t_lat", "t.t_lon")}, 6) AS km FROM messages m JOIN t USING (init_time)) WHERE km <= 2000),
r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY km, sid) AS n, count(*) OVER (PARTITION BY message_id) AS k FROM c),
b AS (SELECT message_id, max(sid) FILTER (WHERE n = 1) AS sid, max(km) FILTER (WHERE n = 1) AS km1, max(km) FILTER (WHERE n = 2) AS km2, max(k) AS k FROM r WHERE n <= 2 GROUP BY message_id),
s AS (SELECT m.message_id, b.sid, b.km1, b.km2, coalesce(b.k, 0) AS candidates, CASE WHEN m.init_time NOT IN (SELECT init_time FROM t) THEN 'no_truth_at_init' WHEN b.k IS NULL THEN 'no_position_match'
  WHEN b.km2 - b.km1 < 75 THEN 'ambiguous_position' WHEN b.sid % 2 = 0 THEN 'matched_cohort' ELSE 'matched_outside_cohort' END AS identity_status FROM messages m LEFT JOIN b USING (message_id))
SELECT message_id, candidates, km1 AS nearest_km, km2 AS second_km, identity_status, CASE WHEN identity_status LIKE 'matched%' THEN sid END AS storm_id FROM s"""


@query(IDENTITY, ("messages",))
def c03_f03_identity(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages(spark, d)
    t = m.where("storm_id % 3 <> 0").select("storm_id", F.col("init_time").alias("iso_time"), (F.col("lat") + 0.3).alias("lat"), (F.col("lon") + 0.2).alias("lon")).distinct()
    cohort = m.select("storm_id").distinct().where("storm_id % 2 = 0")
    out = joins.identify(m.select("message_id", "init_time", "lat", "lon"), t, cohort, limit_km=2000.0)
    return out.select("message_id", "candidates", F.round("nearest_km", 6).alias("nearest_km"), F.round("second_km", 6).alias("second_km"), "identity_status", "storm_id")


LINKS = f"""
WITH t AS (SELECT DISTINCT (CASE storm_id % 3 WHEN 0 THEN 'WP' WHEN 1 THEN 'SH' ELSE 'EP' END || lpad((storm_id % 100)::VARCHAR, 2, '0') || (CASE WHEN storm_id % 5 = 0 THEN '2025' ELSE '2024' END)) AS truth_id, init_time, lat AS t_lat, lon AS t_lon FROM messages),
u AS (SELECT truth_id, init_time, min(t_lat) AS t_lat, min(t_lon) AS t_lon FROM t GROUP BY 1, 2),
m AS (SELECT truth_id AS own, init_time, CASE WHEN truth_id LIKE 'SH%' THEN 'IO' || substr(truth_id, 3) ELSE truth_id END || '' AS track_id, t_lat + 0.4e0 AS lat, t_lon + 0.3e0 AS lon FROM u WHERE t_lat < 50),
n AS (SELECT CASE WHEN track_id LIKE '%2025' THEN substr(track_id, 1, 4) || '2024' ELSE track_id END || CASE WHEN own LIKE '%2025' THEN 'X' ELSE '' END AS track_id, init_time, lat, lon FROM m),
c AS (SELECT n.track_id, n.init_time, u.truth_id, round({lambert("n.lat", "n.lon", "u.t_lat", "u.t_lon")}, 9) AS km FROM n JOIN u USING (init_time)),
r AS (SELECT *, row_number() OVER (PARTITION BY init_time, track_id ORDER BY km, truth_id) AS k, lead(km) OVER (PARTITION BY init_time, track_id ORDER BY km, truth_id) AS next FROM c WHERE km <= 150)
SELECT init_time, track_id, truth_id, CASE WHEN track_id = truth_id THEN 'exact' WHEN right(track_id, 6) = right(truth_id, 6) THEN 'position_suffix' ELSE 'position_only' END AS method, round(km, 6) AS km
FROM r WHERE k = 1 AND (next IS NULL OR next - km >= 75)"""


@query(LINKS, ("messages",))
def c04_one_to_one_links(spark: SparkSession, d: str) -> DataFrame:
    """Forecast tracks at lead 0 against storms of the same time; some names differ in basin, some in year."""
    k = F.col("storm_id")
    name = F.concat(F.when(k % 3 == 0, "WP").when(k % 3 == 1, "SH").otherwise("EP"), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 5 == 0, "2025").otherwise("2024"))
    u = views.messages(spark, d).select(name.alias("truth_id"), F.col("init_time").alias("iso_time"), "lat", "lon").groupBy("truth_id", "iso_time").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    named = F.when(F.col("truth_id").startswith("SH"), F.concat(F.lit("IO"), F.substring("truth_id", 3, 6))).otherwise(F.col("truth_id"))
    late = F.col("truth_id").endswith("2025")
    named = F.when(late, F.concat(F.substring(named, 1, 4), F.lit("2024X"))).otherwise(named)
    means = u.where("lat < 50").select(F.col("iso_time").alias("init_time"), named.alias("track_id"), (F.col("lat") + 0.4).alias("lat"), (F.col("lon") + 0.3).alias("lon"))
    return joins.link_at_start(means, u).select("init_time", "track_id", "truth_id", "method", F.round("init_match_distance_km", 6).alias("km"))


def _crossings(spark: SparkSession, d: str) -> DataFrame:
    c = views.schedule_events(spark, d)
    return c.withColumnRenamed("reference_time", "t")


@query("""SELECT case_id, fix_id AS nearest FROM (SELECT c.case_id, f.fix_id, row_number() OVER (PARTITION BY c.case_id ORDER BY abs(epoch_us(f.iso_time) - epoch_us(c.reference_time)), f.fix_id) AS n
 FROM schedule_events c JOIN fixes f ON f.storm_id = c.storm_id AND f.nature <> 'purchase') WHERE n = 1""", ("fixes", "schedule_events"))
def c08_f06_nearest_time(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).where("nature <> 'purchase'").select("storm_id", "iso_time", "fix_id")
    return joins.nearest_in_time(_crossings(spark, d), f, "storm_id", "t", "iso_time", "fix_id").where("nearest IS NOT NULL").select("case_id", "nearest")


@query("""SELECT case_id, fix_id FROM schedule_events c JOIN fixes f ON f.storm_id = c.storm_id AND f.iso_time BETWEEN c.reference_time - INTERVAL 6 HOUR AND c.reference_time + INTERVAL 6 HOUR""", ("fixes", "schedule_events"))
def c09_interval_join(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).select("storm_id", "iso_time", "fix_id")
    return joins.in_interval(f, views.schedule_events(spark, d), "storm_id", "iso_time", "reference_time", "reference_time", 6.0).select("case_id", "fix_id")


BRACKET = """
WITH o AS (SELECT * FROM fixes WHERE nature <> 'purchase'),
b AS (SELECT c.case_id, c.reference_time, (SELECT max(iso_time) FROM o WHERE o.storm_id = c.storm_id AND o.iso_time {lo} c.reference_time) AS lo, (SELECT min(iso_time) FROM o WHERE o.storm_id = c.storm_id AND o.iso_time {hi} c.reference_time) AS hi FROM schedule_events c)
SELECT case_id, CASE WHEN epoch_us(hi) - epoch_us(lo) <= 21600000000 THEN lo END AS previous_time, CASE WHEN epoch_us(hi) - epoch_us(lo) <= 21600000000 THEN hi END AS next_time,
  coalesce(epoch_us(hi) - epoch_us(lo) <= 21600000000, false) AS forecast_available, CASE WHEN coalesce(epoch_us(hi) - epoch_us(lo) <= 21600000000, false) THEN 'interpolated' ELSE 'unavailable' END AS coverage_method FROM b"""


def _bracketed(spark: SparkSession, d: str, inclusive: bool) -> DataFrame:
    f = views.fixes(spark, d).where("nature <> 'purchase'").select("storm_id", "iso_time", F.col("wind_kt").alias("w"), F.col("pressure_hpa").alias("p"))
    b = joins.coverage_flags(joins.bracket(views.schedule_events(spark, d), f, "storm_id", "reference_time", "iso_time", ["w", "p"], inclusive=inclusive), "w", "p")
    return b.select("case_id", F.col("before.time").alias("previous_time"), F.col("after.time").alias("next_time"), "forecast_available", "coverage_method")


@query(BRACKET.format(lo="<", hi=">"), ("fixes", "schedule_events"))
def c10_bracket(spark: SparkSession, d: str) -> DataFrame:
    return _bracketed(spark, d, False)


@query(BRACKET.format(lo="<=", hi=">="), ("fixes", "schedule_events"))
def c11_bracket_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _bracketed(spark, d, True)


@query("""SELECT 'orphan' AS rule, l_orderkey::VARCHAR AS key, '' AS detail FROM (SELECT DISTINCT l_orderkey + 14000 AS l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'attribute', o_orderkey::VARCHAR, 'o_orderstatus' FROM orders WHERE o_orderstatus <> 'F'""")
def c12_referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    child = views.table(spark, d, "lineitem").select((F.col("l_orderkey") + 14000).alias("o_orderkey"))
    claimed = o.select("o_orderkey", F.lit("F").alias("o_orderstatus"))
    return validation.violations(validation.foreign_key(child, o, ["o_orderkey"], "orphan"), validation.agreement(o, claimed, ["o_orderkey"], ["o_orderstatus"], "attribute"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def c13_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return joins.join_checked(views.table(spark, d, "orders"), c, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_name, revenue FROM part JOIN (SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def c14_one_to_one_status(spark: SparkSession, d: str) -> DataFrame:
    sold = views.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return joins.join_checked(views.table(spark, d, "part").select("p_partkey", "p_name"), sold, ["p_partkey"], "one_to_one").select("p_partkey", "p_name", "revenue")


@query("""SELECT m.message_id, p.lead_hours, p.latitude FROM messages m JOIN points p ON p.message_id = m.message_id AND p.lead_hours IN (6, 42)""", ("messages", "points"))
def c15_endpoints(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages(spark, d).select("message_id")
    return m.join(views.points(spark, d).where(F.col("lead_hours").isin(6, 42)), "message_id").select("message_id", "lead_hours", "latitude")


@query("""SELECT r_name AS model, n_nationkey AS case_key, l AS lead FROM region, nation, (SELECT unnest([24, 48]) AS l)""")
def c16_cross_tasks(spark: SparkSession, d: str) -> DataFrame:
    r, n = views.table(spark, d, "region").select(F.col("r_name").alias("model")), views.table(spark, d, "nation").select(F.col("n_nationkey").alias("case_key"))
    return r.crossJoin(n).withColumn("lead", F.explode(F.array(F.lit(24), F.lit(48))))


@query("""
WITH f AS (SELECT message_id, storm_id, init_time, message_id % 4 <> 0 AS usable, message_id % 9 = 0 AS conflict FROM messages),
p AS (SELECT (message_id * 2)::BIGINT AS case_id, message_id * 2 AS planned FROM messages)
SELECT p.case_id, CASE WHEN f.conflict THEN 'conflicting_duplicate_forecasts' WHEN f.message_id IS NULL THEN 'planned_init_absent' WHEN NOT f.usable THEN 'no_positive_position_points'
 WHEN NOT (f.message_id % 5 <> 0) THEN 'initialization_not_before_event' WHEN NOT (f.message_id % 7 <> 0) THEN 'reference_time_not_covered' ELSE '' END AS unavailable_reason FROM p LEFT JOIN f ON f.message_id = p.planned""", ("messages",))
def c17_unavailable_reason(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages(spark, d)
    k = F.col("message_id")
    f = m.select("message_id", (k % 4 != 0).alias("usable"), (k % 9 == 0).alias("conflict"))
    p = m.select((k * 2).alias("case_id")).join(f, F.col("case_id") == k, "left")
    return p.select("case_id", joins.unavailable_reason(F.col("conflict"), k.isNotNull(), F.col("usable"), k % 5 != 0, k % 7 != 0).alias("unavailable_reason"))


@query("""SELECT c.case_id, count(f.iso_time) FILTER (WHERE f.iso_time < c.reference_time) AS initializations_before, count(f.iso_time) AS initializations, count(f.iso_time) > 0 AS storm_has_forecast
 FROM schedule_events c LEFT JOIN (SELECT storm_id, iso_time FROM fixes WHERE nature = 'view') f ON f.storm_id = c.storm_id GROUP BY c.case_id""", ("fixes", "schedule_events"))
def c18_usable_initializations(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).where("nature = 'view'").select("storm_id", F.col("iso_time").alias("init_time"), F.lit(True).alias("usable"))
    return joins.usable_initializations(views.schedule_events(spark, d), f).select("case_id", "initializations_before", "initializations", "storm_has_forecast")


@query("""SELECT k, 'missing' AS problem FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 5 <> 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT k, 'extra' FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0 EXCEPT SELECT o_custkey FROM orders WHERE o_custkey % 5 <> 0)
UNION ALL SELECT o_custkey, 'duplicate_left' FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1 HAVING count(*) > 1""")
def c19_g02_set_differences(spark: SparkSession, d: str) -> DataFrame:
    left = views.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).where("k % 5 <> 0")
    right = views.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).where("k % 3 <> 0")
    return validation.set_differences(left, right, "k")


@query("""SELECT n_nationkey, 'n_regionkey' AS field, n_regionkey::VARCHAR AS actual, (n_nationkey % 5)::VARCHAR AS expected FROM nation WHERE n_regionkey <> n_nationkey % 5
UNION ALL SELECT n_nationkey, 'n_name', n_name, 'NATION_1' FROM nation WHERE n_name <> 'NATION_1'""")
def c20_field_differences(spark: SparkSession, d: str) -> DataFrame:
    n = views.table(spark, d, "nation")
    want = n.select("n_nationkey", (F.col("n_nationkey") % 5).cast("int").alias("n_regionkey"), F.lit("NATION_1").alias("n_name"))
    return validation.field_differences(n, want, ["n_nationkey"], ["n_regionkey", "n_name"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_quantity <> round(l_quantity) OR o.o_orderkey IS NULL AS differs FROM lineitem LEFT JOIN orders o ON o_orderkey = l_orderkey WHERE l_discount > 0.09""")
def c22_inventory(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey")
    rows = views.table(spark, d, "lineitem").where("l_discount > 0.09").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", ((F.col("l_quantity") != F.round("l_quantity")) | F.col("o_orderkey").isNull()).alias("differs"))


@query("""SELECT storm_id, fix_id, l AS lead, 'M' || m::VARCHAR AS model FROM (SELECT storm_id, fix_id, row_number() OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS n FROM fixes), (SELECT unnest([24, 48, 72, 96, 120]) AS l), (SELECT unnest([1, 2]) AS m) WHERE n = 1""", ("fixes",))
def c23_plot_tasks(spark: SparkSession, d: str) -> DataFrame:
    first = views.fixes(spark, d).groupBy("storm_id").agg(F.min(F.struct("iso_time", "fix_id")).alias("m")).select("storm_id", F.col("m.fix_id").alias("fix_id"))
    leads = first.withColumn("lead", F.explode(F.array(*[F.lit(h) for h in (24, 48, 72, 96, 120)])))
    return leads.withColumn("model", F.explode(F.array(F.lit("M1"), F.lit("M2"))))


@query("SELECT fix_id, lat FROM fixes WHERE nature = 'click' UNION ALL SELECT fix_id, lat FROM fixes WHERE wind_kt > 100", ("fixes",))
def g01_union_all(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d)
    return f.where("nature = 'click'").select("fix_id", "lat").unionByName(f.where("wind_kt > 100").select("fix_id", "lat"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def g02_g03_except_subset(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return o.where("o_orderkey % 2 = 0").select("k").distinct().join(o.where("o_orderkey % 3 = 0").select("k"), "k", "left_anti")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def g05_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return o.where("o_orderkey % 2 = 0").select("k").intersect(o.where("o_orderkey % 3 = 0").select("k"))


@query("""SELECT storm_id, string_agg(DISTINCT nature, '+' ORDER BY nature) AS natures FROM fixes GROUP BY storm_id""", ("fixes",))
def g04_d05_sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    from galeframe.functions.scalar import sorted_join

    return views.fixes(spark, d).groupBy("storm_id").agg(sorted_join("nature").alias("natures"))


__all__ = ["geo"]
