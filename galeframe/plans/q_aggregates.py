"""Queries over aggregations (D of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import scalar
from galeframe.operators import aggregates, duplicates, rollups, sequences
from galeframe.plans import views
from galeframe.plans.q_sequences import EPISODES, episode_table
from galeframe.plans.registry import query


@query("SELECT storm_id, fix_id, m AS lifetime_vmax FROM (SELECT *, max(wind_kt) OVER (PARTITION BY storm_id) AS m FROM fixes) WHERE m >= 200", ("fixes",))
def b02_d01_lifetime_peak(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.lifetime_peak(views.fixes(spark, d), 200.0).select("storm_id", "fix_id", "lifetime_vmax")


@query("""SELECT storm_id, fix_id FROM fixes WHERE nature = 'view' AND storm_id IN (SELECT storm_id FROM fixes WHERE nature = 'view' GROUP BY 1 HAVING max(iso_time) >= TIMESTAMP '2024-01-28' - INTERVAL 6 HOUR AND min(iso_time) <= TIMESTAMP '2024-01-29' + INTERVAL 6 HOUR)""", ("fixes",))
def b03_period(spark: SparkSession, d: str) -> DataFrame:
    t = lambda x: F.to_timestamp_ntz(F.lit(x))
    return aggregates.within_period(views.fixes(spark, d).where("nature = 'view'"), t("2024-01-28"), t("2024-01-29"), 6.0).select("storm_id", "fix_id")


@query("""SELECT storm_id, round(coalesce(sum(h * (f + g) / 2), 0), 6) AS hours FROM (SELECT storm_id, (lead(epoch_us(iso_time)) OVER w - epoch_us(iso_time)) / 3600000000e0 AS h, r34::INTEGER::DOUBLE AS f, lead(r34::INTEGER::DOUBLE) OVER w AS g
 FROM contact_points WINDOW w AS (PARTITION BY storm_id ORDER BY iso_time, fix_id)) GROUP BY storm_id""", ("contact_points",))
def d03_flag_hours(spark: SparkSession, d: str) -> DataFrame:
    return sequences.flag_hours(views.contact_points(spark, d), ["storm_id"], "iso_time", "fix_id", "r34").select("storm_id", F.round("hours", 6).alias("hours"))


@query("SELECT storm_id, round(avg((r34_ne IS NOT NULL)::INTEGER::DOUBLE), 6) AS any_radius, round(avg((wind_kt IS NOT NULL)::INTEGER::DOUBLE), 6) AS wind FROM fixes GROUP BY storm_id", ("fixes",))
def d04_coverage_fraction(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).groupBy("storm_id").agg(aggregates.coverage_fraction(["r34_ne", "r34_se", "r34_sw", "r34_nw"]).alias("a"), aggregates.coverage_fraction(["wind_kt"]).alias("w"))
    return f.select("storm_id", F.round("a", 6).alias("any_radius"), F.round("w", 6).alias("wind"))


_CASES = EPISODES.rsplit("SELECT storm_id, storm_id::VARCHAR", 1)[0].rstrip() + ", cases AS (SELECT storm_id, storm_id::VARCHAR" + EPISODES.rsplit("SELECT storm_id, storm_id::VARCHAR", 1)[1] + ")\n"


@query(_CASES + """SELECT count(*) AS cases, count(DISTINCT storm_id) AS storms, 0::BIGINT AS landfall_cases, count(*) FILTER (WHERE tier IN ('A', 'B')) AS primary_cases, round(median(episode_vmax_kt), 6) AS median_vmax, round(median(span_hours), 6) AS median_span FROM cases""", ("contacts",))
def d06_catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    s = aggregates.catalog_summary(episode_table(spark, d))
    return s.select("cases", "storms", "landfall_cases", "primary_cases", F.round("median_vmax", 6).alias("median_vmax"), F.round("median_span", 6).alias("median_span"))


@query("SELECT CASE WHEN event_type <> 'error' THEN event_type END AS value, count(*) AS count FROM events GROUP BY 1")
def d06_value_counts(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").withColumn("t", F.when(F.col("event_type") != "error", F.col("event_type")))
    return aggregates.value_counts(e, "t")


@query(_CASES + """SELECT storm_id, min(tier) AS best_tier, count(*) AS cases, max(episode_vmax_kt) AS peak_kt, min(episode_start) AS first_contact, max(episode_end) AS last_contact FROM cases GROUP BY storm_id""", ("contacts",))
def d07_storm_rollup(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.storm_rollup(episode_table(spark, d)).drop("landfalls")


_FULL = _CASES + """, full_cases AS (SELECT *, 'N' || storm_id::VARCHAR AS name, CASE WHEN episode_index % 3 = 0 THEN 'NA' WHEN episode_index % 3 = 1 THEN 'EP' END AS basin, tier IN ('A', 'B') AS primary_sample, storm_id % 10 = 0 AS provisional_track,
 (episode_index % 2)::BIGINT AS landfalls, (episode_index % 5 // 4)::BIGINT AS exits, closest_km AS km, CASE WHEN episode_index % 2 = 1 THEN 'landfall' ELSE 'coastal_approach' END AS event FROM cases)
"""


def full_cases(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with the columns of a catalog's cases; names, basins and crossings follow from storm and number."""
    k = F.col("episode_index")
    return episode_table(spark, d).withColumns({
        "name": F.concat(F.lit("N"), F.col("storm_id").cast("string")), "basin": F.when(k % 3 == 0, "NA").when(k % 3 == 1, "EP"), "primary_sample": F.col("tier").isin("A", "B"), "provisional_track": F.col("storm_id") % 10 == 0,
        "landfall_count": (k % 2).cast("long"), "exit_count": F.floor(k % 5 / 4).cast("long"), "minimum_coast_distance_km": F.col("closest_km"), "reference_event": F.when(k % 2 == 1, "landfall").otherwise("coastal_approach"), "lifetime_vmax_kt": F.col("episode_vmax_kt") + 1.0,
    })


_TEXT = "(SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT coalesce({0}, 'nan') AS v, count(*) AS n FROM full_cases GROUP BY 1))"


@query(_FULL + f"""SELECT count(*) AS case_count, count(*) FILTER (WHERE primary_sample) AS primary_case_count, count(DISTINCT storm_id) AS storm_count, count(DISTINCT storm_id) FILTER (WHERE primary_sample) AS primary_storm_count,
 count(*) FILTER (WHERE provisional_track) AS provisional_case_count, count(*) FILTER (WHERE provisional_track AND primary_sample) AS provisional_primary_case_count, count(*) FILTER (WHERE NOT provisional_track) AS final_main_case_count, count(*) FILTER (WHERE NOT provisional_track AND primary_sample) AS final_main_primary_case_count,
 count(*) FILTER (WHERE landfalls > 0) AS landfall_case_count, count(*) FILTER (WHERE landfalls = 0) AS sea_only_case_count, count(*) FILTER (WHERE exits > 0) AS exit_associated_case_count, count(*) FILTER (WHERE primary_sample AND landfalls > 0) AS primary_landfall_case_count, count(*) FILTER (WHERE primary_sample AND landfalls = 0) AS primary_sea_only_case_count,
 {_TEXT.format("tier")} AS tier_counts, {_TEXT.format("event")} AS reference_event_counts, {_TEXT.format("basin")} AS basin_counts, {_TEXT.format("selection_method")} AS selection_method_counts,
 (SELECT count(*) FROM contacts) AS dense_track_point_count, round(median(km), 6) AS median_minimum_coast_distance_km, round(median(r34_coverage), 6) AS median_r34_coverage_fraction FROM full_cases""", ("contacts",))
def d06_catalog_measures(spark: SparkSession, d: str) -> DataFrame:
    m = rollups.catalog_measures(full_cases(spark, d), views.contacts(spark, d))
    return m.withColumns({**{f"{c}_counts": rollups.as_text(F.col(f"{c}_counts")) for c in rollups.COUNTED}, **{c: F.round(c, 6) for c in ("median_minimum_coast_distance_km", "median_r34_coverage_fraction")}})


@query(_FULL + """SELECT storm_id, min(name) AS name, coalesce(string_agg(DISTINCT basin, '+' ORDER BY basin), '') AS basins, count(*) AS episode_count, count(*) FILTER (WHERE primary_sample) AS primary_episode_count, min(tier) AS highest_tier, bool_or(primary_sample) AS primary_sample,
 min(episode_start) AS first_coastal_contact, max(episode_end) AS last_coastal_contact, min(km) AS minimum_coast_distance_km, max(episode_vmax_kt) + 1e0 AS lifetime_vmax_kt, max(episode_vmax_kt) AS maximum_coastal_episode_vmax_kt, bool_or(landfalls > 0) AS any_coastline_crossing,
 bool_or(exits > 0) AS any_coastline_exit, bool_or(provisional_track) AS provisional_track, 'pending' AS qc_status FROM full_cases GROUP BY storm_id""", ("contacts",))
def d07_storm_catalog(spark: SparkSession, d: str) -> DataFrame:
    return rollups.storm_catalog(full_cases(spark, d))


@query("""SELECT count(*) AS row_count, count(DISTINCT storm_id) AS storm_count, min(iso_time) AS time_start, max(iso_time) AS time_end, (SELECT string_agg(track_type || ':' || n, ',' ORDER BY track_type) FROM (SELECT track_type, count(*) AS n FROM fixes GROUP BY 1)) AS track_type_rows,
 round(avg((w IS NULL)::INTEGER::DOUBLE), 6) AS wind_missing_fraction, round(avg((y IS NULL OR x IS NULL)::INTEGER::DOUBLE), 6) AS position_missing_fraction, round(avg((r34_ne IS NOT NULL)::INTEGER::DOUBLE), 6) AS any_wind_radius_fraction, (count(*) - count(DISTINCT (storm_id, iso_time)))::BIGINT AS duplicate_storm_time_count
 FROM (SELECT *, CASE WHEN nature <> 'view' THEN wind_kt END AS w, CASE WHEN fix_id % 7 > 0 THEN lat END AS y, CASE WHEN fix_id % 11 > 0 THEN lon END AS x FROM fixes)""", ("fixes",))
def d08_source_measures(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumns({"w": F.when(F.col("nature") != "view", F.col("wind_kt")), "y": F.when(F.col("fix_id") % 7 > 0, F.col("lat")), "x": F.when(F.col("fix_id") % 11 > 0, F.col("lon"))})
    m = rollups.source_measures(f, "storm_id", "iso_time", "w", ("y", "x"), ["r34_ne", "r34_se", "r34_sw", "r34_nw"], "track_type")
    return m.withColumns({"track_type_rows": rollups.as_text(F.col("track_type_rows")), **{c: F.round(c, 6) for c in ("wind_missing_fraction", "position_missing_fraction", "any_wind_radius_fraction")}})


@query("""SELECT count(*) AS rows, count(DISTINCT storm_id) AS storms, min(iso_time) AS first_time, max(iso_time) AS last_time, round(avg((w IS NULL)::INTEGER::DOUBLE), 6) AS wind_missing, round(avg((r34_ne IS NOT NULL)::INTEGER::DOUBLE), 6) AS any_radius,
 (count(*) - count(DISTINCT (storm_id, iso_time)))::BIGINT AS duplicates FROM (SELECT *, CASE WHEN nature <> 'view' THEN wind_kt END AS w FROM fixes)""", ("fixes",))
def d08_source_quality(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d).withColumn("w", F.when(F.col("nature") != "view", F.col("wind_kt")))
    q = aggregates.source_quality(f, ["storm_id", "iso_time"], "w", ["r34_ne", "r34_se", "r34_sw", "r34_nw"])
    return q.select("rows", "storms", "first_time", "last_time", F.round("wind_missing", 6).alias("wind_missing"), F.round("any_radius", 6).alias("any_radius"), "duplicates")


def _coverage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = views.table(spark, d, "orders")
    k = F.col("o_orderkey")
    events = o.select(k.alias("case_id"), F.col("o_custkey").alias("storm_id"), F.col("o_orderdate").alias("reference_time"), (k % 3 == 0).alias("storm_has_forecast"), (k % 4 == 0).alias("event_time_covered"), (k % 3).alias("planned_case_count"), (k % 2).alias("available_case_count"))
    cases = o.select(k.alias("case_id"), F.col("o_custkey").alias("storm_id"), F.col("o_orderdate").alias("reference_time"), (k % 5 * 24 + 24).cast("int").alias("nominal_lead_hours"), (k % 2 == 0).alias("strict_init_present"), (k % 3 == 0).alias("forecast_available"), (k % 6 == 0).alias("forecast_wind_available"), (k % 9 == 0).alias("forecast_pressure_available"))
    return events, cases


@query("""SELECT year(o_orderdate)::INTEGER AS year, count(*) AS total_events, count(DISTINCT o_custkey) AS total_storms, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END) AS storms_with_forecast,
 count(*) FILTER (WHERE o_orderkey % 3 = 0) AS events_with_storm_forecast, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS events_with_reference_coverage, count(*) FILTER (WHERE o_orderkey % 2 > 0) AS events_with_any_available_case,
 count(*) FILTER (WHERE o_orderkey % 3 > 0 AND o_orderkey % 2 = o_orderkey % 3) AS events_with_all_planned_cases, count(*) AS total_cases, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS strict_init_present_cases,
 count(*) FILTER (WHERE o_orderkey % 3 = 0) AS available_cases, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS wind_available_cases, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS pressure_available_cases,
 round(avg((o_orderkey % 3 = 0)::INTEGER::DOUBLE), 6) AS available_case_fraction FROM orders GROUP BY 1""")
def d09_coverage_by_year(spark: SparkSession, d: str) -> DataFrame:
    y = aggregates.coverage_by_year(*_coverage(spark, d))
    return y.withColumn("available_case_fraction", F.round("available_case_fraction", 6))


@query("""SELECT (o_orderkey % 5 * 24 + 24)::INTEGER AS nominal_lead_hours, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS available_events, count(DISTINCT o_custkey) FILTER (WHERE o_orderkey % 3 = 0) AS available_storms, count(*) AS total_cases,
 count(*) FILTER (WHERE o_orderkey % 2 = 0) AS strict_init_present_cases, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS available_cases, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS wind_available_cases, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS pressure_available_cases,
 round(avg((o_orderkey % 3 = 0)::INTEGER::DOUBLE), 6) AS available_case_fraction FROM orders GROUP BY 1""")
def d10_coverage_by_lead(spark: SparkSession, d: str) -> DataFrame:
    y = aggregates.coverage_by_lead(_coverage(spark, d)[1])
    return y.withColumn("available_case_fraction", F.round("available_case_fraction", 6))


@query("""SELECT hour(ts)::INTEGER AS hour, year(ts)::INTEGER AS year, count(*) AS messages, count(*) FILTER (WHERE event_type = 'error') AS missing FROM events GROUP BY 1, 2""")
def d11_decode_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").groupBy(F.hour("ts").alias("hour"), F.year("ts").alias("year")).agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") == "error").alias("missing"))


@query("""SELECT basin AS "group", nature AS status, overall, count, round(count / sum(count) OVER (PARTITION BY overall, basin), 6) AS fraction FROM (
 SELECT basin, nature, grouping(basin)::INTEGER AS overall, count(*) AS count FROM fixes GROUP BY GROUPING SETS ((basin, nature), (nature)))""", ("fixes",))
def d12_status_summary(spark: SparkSession, d: str) -> DataFrame:
    s = aggregates.status_summary(views.fixes(spark, d), "basin", "nature")
    return s.select(F.col("basin").alias("group"), F.col("nature").alias("status"), F.col("overall").cast("int").alias("overall"), "count", F.round("fraction", 6).alias("fraction"))


@query("""SELECT w AS workers, median, w = min(CASE WHEN median <= best * 1.05e0 THEN w END) OVER () AS chosen FROM (SELECT *, min(median) OVER () AS best FROM (SELECT user_id % 8 AS w, median(value) AS median FROM events GROUP BY 1))""")
def d19_fewest_workers(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select((F.col("user_id") % 8).alias("workers"), "value")
    return aggregates.fewest_within(e, "workers", "value")


@query("""SELECT event_type, count(*) AS values, count(*) FILTER (WHERE v IS NULL) AS masked, count(*) FILTER (WHERE NOT isfinite(v)) AS nonfinite, min(v) FILTER (WHERE isfinite(v)) AS least, max(v) FILTER (WHERE isfinite(v)) AS largest
 FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS v FROM events) GROUP BY 1""")
def d20_payload_stats(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    return e.groupBy("event_type").agg(*aggregates.payload_stats(e, "v"))


@query("SELECT basin, count(DISTINCT storm_id) AS storms, count(*) AS fixes FROM fixes GROUP BY basin ORDER BY fixes DESC, basin", ("fixes",))
def d21_basin_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.fixes(spark, d).groupBy("basin").agg(F.countDistinct("storm_id").alias("storms"), F.count("*").alias("fixes")).orderBy(F.desc("fixes"), "basin")


@query("SELECT message_id, lead_hours, count(*) AS rows FROM points GROUP BY 1, 2 HAVING count(*) > 1", ("points",))
def d22_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicated(views.points(spark, d), ["message_id", "lead_hours"])


RECONCILE = """
WITH u AS (SELECT DISTINCT message_id // 4 AS g, message_id, lead_hours, (pressure_hpa * 10)::BIGINT % 2 AS p FROM points),
s AS (SELECT message_id, string_agg(lead_hours::VARCHAR || ':' || coalesce(p::VARCHAR, ''), ',' ORDER BY lead_hours, p NULLS FIRST) AS sig, count(*) > count(DISTINCT lead_hours) AS conflict FROM u GROUP BY message_id),
m AS (SELECT message_id, message_id // 4 AS g, coalesce(sig, '') AS sig, coalesce(conflict, false) AS conflict FROM messages LEFT JOIN s USING (message_id)),
w AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, min(sig) OVER (PARTITION BY g) AS lo, max(sig) OVER (PARTITION BY g) AS hi, bool_or(conflict) OVER (PARTITION BY g) AS bad, min(message_id) OVER (PARTITION BY g) AS f FROM m)
SELECT message_id, CASE WHEN bad OR lo <> hi THEN 'conflicting_duplicate_forecasts' WHEN message_id = f THEN 'unique' ELSE 'equivalent_duplicate' END AS duplicate_status, CASE WHEN NOT (bad OR lo <> hi) THEN f END AS canonical_message_id FROM w"""


@query(RECONCILE, ("messages", "points"))
def d23_reconcile(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d).withColumn("p", (F.col("pressure_hpa") * 10).cast("long") % 2)
    sig = duplicates.signatures(p, "message_id", ["lead_hours"], ["p"])
    m = views.messages(spark, d).select("message_id", F.floor(F.col("message_id") / 4).alias("g")).join(sig, "message_id", "left")
    return duplicates.reconcile(m, ["g"]).select("message_id", "duplicate_status", "canonical_message_id")


@query("SELECT storm_id, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) AS mean_lon FROM fixes GROUP BY storm_id", ("fixes",))
def d24_circular_mean(spark: SparkSession, d: str) -> DataFrame:
    return views.fixes(spark, d).groupBy("storm_id").agg(scalar.mean_longitude("lon").alias("m")).select("storm_id", F.round("m", 6).alias("mean_lon"))


@query("SELECT (floor(wind_kt / 25e0) * 25)::BIGINT AS bin, count(*) AS n, min(wind_kt) AS least, max(wind_kt) AS largest FROM fixes GROUP BY 1", ("fixes",))
def d25_histogram(spark: SparkSession, d: str) -> DataFrame:
    return views.fixes(spark, d).groupBy((F.floor(F.col("wind_kt") / 25.0) * 25).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("wind_kt").alias("least"), F.max("wind_kt").alias("largest"))


@query("""SELECT failure, count(*) AS count FROM (SELECT unnest(string_split(CASE WHEN value > 100 THEN 'strong;' || event_type ELSE event_type END, ';')) AS failure FROM events) GROUP BY 1""")
def d26_failure_counts(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").withColumn("failures", F.when(F.col("value") > 100, F.concat(F.lit("strong;"), "event_type")).otherwise(F.col("event_type")))
    return aggregates.failure_counts(e, "failures")


@query("""SELECT round(avg(abs(value - 50)), 6) AS mae, round(median(abs(value - 50)), 6) AS median_error, round(avg(value - 50), 6) AS bias, count(*) AS eligible, count(CASE WHEN event_type <> 'error' THEN 1 END) AS matched, (user_id % 5)::BIGINT AS lead
 FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v0 FROM (SELECT user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)) GROUP BY user_id % 5""")
def d13_verification_summary(spark: SparkSession, d: str) -> DataFrame:
    from galeframe.operators.ensemble import verification_summary

    e = views.table(spark, d, "events").select((F.col("user_id") % 5).alias("lead"), F.col("user_id").alias("storm_id"), F.when(F.col("event_type") != "error", F.col("value") - 50.0).alias("error"))
    s = verification_summary(e.withColumn("bias", F.col("error")), ["lead"], scores=())
    return s.select(F.round("mae", 6).alias("mae"), F.round("median_error", 6).alias("median_error"), F.round("mean_bias", 6).alias("bias"), "eligible", "matched", "lead")
