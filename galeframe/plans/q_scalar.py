"""Queries over filters, projections and column functions (B, F and H of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.views import bearing, lambert


@query("SELECT fix_id, storm_id FROM fixes WHERE lower(track_type) IN ('main')", ("fixes",))
def b01_track_types(spark: SparkSession, d: str) -> DataFrame:
    return views.fixes(spark, d).where(F.lower("track_type").isin("main")).select("fix_id", "storm_id")


@query("SELECT fix_id FROM fixes WHERE abs(lat) <= 90 AND abs(lon) <= 360 AND iso_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND nature IN ('click', 'view') AND atcf_id <> ''", ("fixes",))
def b04_b05_b06_eligible(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d)
    inside = F.col("iso_time").between(F.to_timestamp_ntz(F.lit("2024-01-05")), F.to_timestamp_ntz(F.lit("2024-01-20")))
    return f.where(geo.valid_position("lat", "lon") & inside & F.col("nature").isin("click", "view") & (F.col("atcf_id") != "")).select("fix_id")


@query("""SELECT fix_id, landfall AND track_type = 'main' AS main_primary, landfall AS primary_sample, NOT (track_type <> 'main') AS main_track FROM contacts WHERE landfall OR track_type = 'main'""", ("contacts",))
def b07_subset_views(spark: SparkSession, d: str) -> DataFrame:
    main = F.col("track_type") == "main"
    return views.contacts(spark, d).where(F.col("landfall") | main).select("fix_id", (F.col("landfall") & main).alias("main_primary"), F.col("landfall").alias("primary_sample"), main.alias("main_track"))


@query("""SELECT event_id, CASE WHEN v < 1e90 AND v <> 2147483647 THEN v END AS value, round(CASE WHEN v < 1e90 AND v <> 2147483647 THEN v END * 1.852e0, 6) AS km,
 round(CASE WHEN v < 1e90 AND v <> 2147483647 THEN v END * 3600e0 / 1852e0, 6) AS kt, round(CASE WHEN v < 1e90 AND v <> 2147483647 THEN v END / 100e0, 6) AS hpa
 FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1e95 WHEN event_id % 11 = 0 THEN 2147483647e0 ELSE value END AS v FROM events)""")
def b08_b10_b14_sentinels_units(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, 1e95).when(F.col("event_id") % 11 == 0, 2147483647.0).otherwise(F.col("value")))
    v = scalar.sentinel_to_null("v")
    return e.select("event_id", scalar.finite(v).alias("value"), F.round(scalar.nmi_to_km(v), 6).alias("km"), F.round(scalar.ms_to_kt(v), 6).alias("kt"), F.round(scalar.pa_to_hpa(v), 6).alias("hpa"))


@query("""SELECT event_id, ((x + 180e0) % 360e0 + 360e0) % 360e0 - 180e0 AS lon, round(10e0 + ((x - 10e0 + 180e0) % 360e0 + 360e0) % 360e0 - 180e0, 6) AS around_ten
 FROM (SELECT event_id, (event_id % 721 - 360)::DOUBLE AS x FROM events)""")
def b09_h14_longitudes(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").withColumn("x", (F.col("event_id") % 721 - 360).cast("double"))
    return e.select("event_id", geo.wrap_longitude("x").alias("lon"), F.round(geo.unwrap_longitude("x", F.lit(10.0)), 6).alias("around_ten"))


@query("""SELECT n_nationkey::BIGINT AS storm_key, upper(n_name) AS name, coalesce(n_name, '') <> '' AND n_regionkey IS NOT NULL AS contract_met FROM nation""")
def b11_rename_contract(spark: SparkSession, d: str) -> DataFrame:
    n = views.table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "storm_key", "n_name": "name", "n_regionkey": "basin_key"})
    return n.select(F.col("storm_key").cast("long").alias("storm_key"), F.upper("name").alias("name"), ((F.coalesce("name", F.lit("")) != "") & F.col("basin_key").isNotNull()).alias("contract_met"))


@query("""SELECT fix_id, CASE WHEN r64 OR (landfall AND wind_kt >= 64) THEN 'A' WHEN r50 OR landfall THEN 'B' WHEN r34 THEN 'C' ELSE 'D' END AS tier,
 CASE WHEN landfall THEN 'coastline' WHEN distance_km < 200 THEN 'land' ELSE 'sea' END AS label, distance_km, r34, proxy, r34 OR proxy OR landfall AS contact FROM contact_points""", ("contact_points",))
def b12_b13_b15_tier_contact(spark: SparkSession, d: str) -> DataFrame:
    p = views.contact_points(spark, d)
    label = F.when(F.col("landfall"), "coastline").otherwise(scalar.surface(F.col("distance_km") < 200))
    return p.select("fix_id", scalar.tier(F.col("r64"), F.col("r50"), F.col("r34"), F.col("landfall"), F.col("wind_kt")).alias("tier"), label.alias("label"), "distance_km", "r34", "proxy", (F.col("r34") | F.col("proxy") | F.col("landfall")).alias("contact"))


@query("SELECT forecast_id, member, (value >= 10)::INTEGER::DOUBLE AS hit FROM members", ("members",))
def b16_threshold(spark: SparkSession, d: str) -> DataFrame:
    return views.members(spark, d).select("forecast_id", "member", scalar.exceeds("value", 10.0).alias("hit"))


@query(f"""SELECT fix_id, round({lambert("lat", "lon", "lat + 1e0", "lon + 2e0")}, 6) AS km, round({lambert("lat", "lon", "lat", "lon")}, 6) AS zero,
 round(cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(sin(radians(lat)), 6) AS z FROM fixes""", ("fixes",))
def h01_h03_distance_xyz(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumn("p", geo.unit_xyz("lat", "lon"))
    at = geo.distance_km("lat", "lon", F.col("lat") + 1.0, F.col("lon") + 2.0)
    return f.select("fix_id", F.round(at, 6).alias("km"), F.round(geo.distance_km("lat", "lon", "lat", "lon"), 6).alias("zero"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round("p.z", 6).alias("z"))


@query()
def h01_h02_exact_geodesics(spark: SparkSession, d: str) -> DataFrame:
    """Vincenty inverse and direct; a round trip that SQL has no function for."""
    f = views.fixes(spark, d).select("fix_id", "lat", "lon", geo.exact_distance_km("lat", "lon", F.lit(10.0), F.lit(20.0)).alias("km"))
    back = geo.destination("lat", "lon", F.lit(45.0), F.lit(100.0))
    return f.withColumn("to", back).select("fix_id", F.round("km", 6).alias("km"), F.round("to.latitude", 6).alias("lat_to"), F.round("to.longitude", 6).alias("lon_to"))


@query(f"""SELECT fix_id, round(k * sin(radians(b)), 6) AS x, round(k * cos(radians(b)), 6) AS y FROM (SELECT fix_id, {lambert("lat", "lon", "lat + 0.5e0", "lon - 0.25e0")} AS k,
 (({bearing("lat", "lon", "lat + 0.5e0", "lon - 0.25e0")}) + 360e0) % 360e0 AS b FROM fixes)""", ("fixes",))
def h04_local_xy(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumn("p", geo.local_xy(F.col("lat") + 0.5, F.col("lon") - 0.25, "lat", "lon"))
    return f.select("fix_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""SELECT event_id, round(sqrt((px - t * 3e0) * (px - t * 3e0) + (py - t * 4e0) * (py - t * 4e0)), 6) AS distance, round(t, 6) AS fraction FROM
 (SELECT event_id, px, py, greatest(0e0, least(1e0, (px * 3e0 + py * 4e0) / 25e0)) AS t FROM (SELECT event_id, value / 10e0 AS px, (event_id % 9)::DOUBLE AS py FROM events))""")
def h05_segment_distance(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select("event_id", (F.col("value") / 10.0).alias("px"), (F.col("event_id") % 9).cast("double").alias("py"))
    s = geo.segment_distance(F.col("px"), F.col("py"), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))
    return e.withColumn("s", s).select("event_id", F.round("s.distance", 6).alias("distance"), F.round("s.fraction", 6).alias("fraction"))


@query("""SELECT fix_id, q AS quadrant, round(CASE q WHEN 'NE' THEN r34_ne WHEN 'SE' THEN r34_se WHEN 'SW' THEN r34_sw ELSE r34_nw END * 1.852e0, 6) AS radius_km
 FROM (SELECT *, CASE WHEN b < 90 THEN 'NE' WHEN b < 180 THEN 'SE' WHEN b < 270 THEN 'SW' ELSE 'NW' END AS q FROM (SELECT *, (fix_id * 45 % 360)::DOUBLE AS b FROM fixes))""", ("fixes",))
def h06_h07_quadrants(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumn("b", (F.col("fix_id") * 45 % 360).cast("double") - 360.0)
    return f.select("fix_id", geo.quadrant("b").alias("quadrant"), F.round(geo.quadrant_radius_km("b", "r34_ne", "r34_se", "r34_sw", "r34_nw"), 6).alias("radius_km"))


@query("""SELECT fix_id, round(CASE WHEN r34_ne IS NOT NULL AND w IS NOT NULL THEN r34_ne + f * (w - r34_ne) WHEN f <= 1e-12 AND r34_ne IS NOT NULL THEN r34_ne WHEN f >= 1 - 1e-12 AND w IS NOT NULL THEN w END, 6) AS between
 FROM (SELECT fix_id, r34_ne, CASE WHEN fix_id % 5 <> 0 THEN wind_kt END AS w, (fix_id % 5)::DOUBLE / 4e0 AS f FROM fixes)""", ("fixes",))
def h08_interpolate(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumn("w", F.when(F.col("fix_id") % 5 != 0, F.col("wind_kt"))).withColumn("f", (F.col("fix_id") % 5).cast("double") / 4.0)
    return f.select("fix_id", F.round(scalar.interpolate("r34_ne", "w", "f"), 6).alias("between"))


@query("""SELECT fix_id, id AS identifier, regexp_matches(id, '^[0-9]{2}[A-Z]$') AND CASE right(id, 1) WHEN 'L' THEN 'AL' WHEN 'E' THEN 'EP' WHEN 'W' THEN 'WP' WHEN 'S' THEN 'SH' END = left(atcf_id, 2)
  AND left(id, 2) = substr(atcf_id, 3, 2) AS agrees
 FROM (SELECT *, lpad((storm_id % 40)::VARCHAR, 2, '0') || CASE fix_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'E' WHEN 2 THEN 'W' ELSE 'S' END AS id FROM fixes)""", ("fixes",))
def h15_identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("fix_id") % 4
    f = views.fixes(spark, d).withColumn("identifier", F.concat(F.lpad((F.col("storm_id") % 40).cast("string"), 2, "0"), F.when(k == 0, "L").when(k == 1, "E").when(k == 2, "W").otherwise("S")))
    return f.select("fix_id", "identifier", scalar.identifier_agrees(F.concat(F.lit(" "), F.lower("identifier")), "atcf_id").alias("agrees"))


@query("""SELECT event_id, 'S' || user_id::VARCHAR || '-CE' || lpad((event_id % 7)::VARCHAR, 2, '0') AS case_id, 'S' || user_id::VARCHAR || '-CE' || lpad((event_id % 7)::VARCHAR, 2, '0') || '-L' || lpad((event_id % 5 * 24 + 24)::VARCHAR, 3, '0') AS forecast_case_id,
 (event_id % 5 * 24 + 24)::INTEGER AS lead FROM events""")
def h16_identifiers_split(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").withColumn("c", scalar.case_id(F.concat(F.lit("S"), F.col("user_id").cast("string")), F.col("event_id") % 7))
    e = e.withColumn("forecast_case_id", scalar.forecast_case_id("c", F.col("event_id") % 5 * 24 + 24)).withColumn("s", scalar.split_case_id("forecast_case_id"))
    return e.select("event_id", F.col("s.case_id").alias("case_id"), "forecast_case_id", F.col("s.lead").alias("lead"))


@query("""SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, ts + INTERVAL 30 HOUR AS later, year(ts)::INTEGER AS y, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS m, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def h17_times(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    return views.table(spark, d, "events").select("event_id", F.date_trunc("day", t).cast("timestamp_ntz").alias("day"), (t + F.expr("INTERVAL 30 HOURS")).alias("later"), F.year(t).alias("y"), F.hour(t).alias("h"), F.minute(t).alias("m"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("""SELECT event_id, ((epoch_us(ts) - epoch_us(i) + 21599999999) // 21600000000 * 6)::INTEGER AS hours FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY AS i FROM events)""")
def h18_horizon(spark: SparkSession, d: str) -> DataFrame:
    init = F.date_trunc("day", "ts").cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    return views.table(spark, d, "events").select("event_id", scalar.horizon_hours(init, "ts").alias("hours"))


@query("SELECT o_orderkey, sha256(o_orderkey::VARCHAR || '|' || o_orderpriority) AS digest FROM orders")
def h20_digest(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("digest"))


@query("SELECT message_id, lead_hours, init_time + lead_hours * INTERVAL 1 HOUR AS valid_time, lead_hours AS lead FROM points JOIN messages USING (message_id)", ("messages", "points"))
def h21_h22_integral_leads(spark: SparkSession, d: str) -> DataFrame:
    from galeframe.operators.schedule import integral_leads

    p = views.points(spark, d).join(views.messages(spark, d), "message_id").withColumn("valid_time", F.timestamp_add("HOUR", "lead_hours", "init_time")).withColumnRenamed("lead_hours", "lead")
    return integral_leads(p, lead="lead").select("message_id", "lead_hours", "valid_time", "lead")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def h23_json_fields(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("long").alias("k"))


@query("SELECT unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS init_time FROM events")
def h24_cycles(spark: SparkSession, d: str) -> DataFrame:
    """All cycles of the days that events cover."""
    from galeframe.operators.schedule import cycles_of

    return cycles_of(views.table(spark, d, "events"), "ts")


@query("""SELECT vec_id, 18 + 8 * ((i - 1) // 4) AS threshold_ms, CASE (i - 1) % 4 WHEN 0 THEN 'ne' WHEN 1 THEN 'se' WHEN 2 THEN 'sw' ELSE 'nw' END AS quadrant, embedding[i]::DOUBLE AS radius
 FROM embeddings, (SELECT unnest(range(1, 13)) AS i)""")
def a14_h25_radii_reshape(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 12)).alias("p", "x"))
    q = F.element_at(F.array(*[F.lit(x) for x in ("ne", "se", "sw", "nw")]), F.col("p") % 4 + 1)
    return e.select("vec_id", (F.lit(18).cast("long") + F.floor(F.col("p") / 4) * 8).alias("threshold_ms"), q.alias("quadrant"), F.col("x").cast("double").alias("radius"))


@query("""SELECT case_id, nominal_lead_hours, target_time, CASE WHEN off <= 10800000000 THEN make_timestamp(c) END AS init_time, CASE WHEN off <= 10800000000 THEN 'planned' ELSE 'no_cycle_within_tolerance' END AS status,
 round((epoch_us(reference_time) - CASE WHEN off <= 10800000000 THEN c END) / 3600000000e0, 6) AS actual_lead_hours, case_id || '-L' || lpad(nominal_lead_hours::VARCHAR, 3, '0') AS forecast_case_id
 FROM (SELECT *, row_number() OVER (PARTITION BY case_id, nominal_lead_hours ORDER BY off, c) AS n FROM (SELECT *, abs(c - epoch_us(target_time)) AS off FROM (
  SELECT case_id, reference_time, l AS nominal_lead_hours, reference_time - l * INTERVAL 1 HOUR AS target_time,
   (epoch_us(date_trunc('day', reference_time - l * INTERVAL 1 HOUR)::TIMESTAMP) + dd * 86400000000 + hh * 3600000000)::BIGINT AS c
  FROM schedule_events, (SELECT unnest([24, 48, 72, 96, 120]) AS l), (SELECT unnest([-1, 0, 1]) AS dd), (SELECT unnest([0, 6, 12, 18]) AS hh)))) WHERE n = 1""", ("schedule_events",))
def f05_c16_schedule(spark: SparkSession, d: str) -> DataFrame:
    from galeframe.operators.schedule import schedule

    s = schedule(views.schedule_events(spark, d))
    return s.select("case_id", "nominal_lead_hours", "target_time", "init_time", "status", F.round("actual_lead_hours", 6).alias("actual_lead_hours"), "forecast_case_id")


@query("""SELECT fix_id, storm_id, row_number() OVER (ORDER BY iso_time, fix_id) AS place FROM fixes""", ("fixes",))
def f01_f02_stable_sort(spark: SparkSession, d: str) -> DataFrame:
    """Places of all fixes in time."""
    from galeframe.operators.sequences import placed

    return placed(views.fixes(spark, d).select("fix_id", "storm_id", "iso_time"), ["iso_time", "fix_id"], "place").select("fix_id", "storm_id", "place")


@query("""SELECT storm_id, fix_id, wind_kt FROM (SELECT *, row_number() OVER (PARTITION BY basin, lat >= 0 ORDER BY iso_time, fix_id) AS n FROM fixes WHERE lat <> 0) WHERE n = 1""", ("fixes",))
def f08_first_per_stratum(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).where("lat <> 0")
    picked = f.groupBy("basin", (F.col("lat") >= 0).alias("north")).agg(F.min(F.struct("iso_time", "fix_id", "storm_id", "wind_kt")).alias("m"))
    return picked.select("m.storm_id", "m.fix_id", "m.wind_kt")


@query("""SELECT storm_id FROM (SELECT storm_id, row_number() OVER (ORDER BY md5(storm_id::VARCHAR || '-7'), storm_id) AS n FROM (SELECT DISTINCT storm_id FROM fixes)) WHERE n <= 6""", ("fixes",))
def f07_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    storms = views.fixes(spark, d).select("storm_id").distinct()
    return storms.orderBy(F.md5(F.concat(F.col("storm_id").cast("string"), F.lit("-7")).cast("binary")), "storm_id").limit(6)


@query("""SELECT vec_id, (('0x' || left(sha256(vec_id::VARCHAR), 8))::BIGINT % 7)::BIGINT AS tile_y, (('0x' || substr(sha256(vec_id::VARCHAR), 9, 8))::BIGINT % 7)::BIGINT AS tile_x FROM embeddings""")
def f09_tile_choice(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2(F.col("vec_id").cast("string"), 256)
    pick = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("long") % 7)
    return views.table(spark, d, "embeddings").select("vec_id", pick(1).alias("tile_y"), pick(9).alias("tile_x"))
