"""Whole evaluations (P1, P3, P6, P7 of the inventory) over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators import schedule
from galeframe.operators.lineage import kept
from galeframe.pipelines import catalog, matching, quality, verification
from galeframe.plans import views
from galeframe.plans.registry import query


PERIOD = catalog.CatalogConfig("2024-01-02 00:00:00", "2024-01-28 00:00:00", spacing_km=100.0, sample_km=100.0, candidates=8)


def catalog_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fixes with all radii and names, and one square of land for each nation, its sides cut short."""
    from galeframe.operators.crossings import plane_edges
    from galeframe.plans.q_spatial import land_edges

    inner = {f"r{kt}_{q}": F.col(f"r34_{q}") * k for kt, k in ((50, 0.5), (64, 0.25)) for q in catalog.QUADRANTS}
    f = views.fixes(spark, d).withColumns(inner).withColumn("name", F.concat(F.lit("N"), F.col("storm_id").cast("string")))
    return f, plane_edges(land_edges(spark, d).withColumn("segment_id", F.xxhash64("ring_id", "lon_a", "lat_a")))


@query()
def p1_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of coastal contact from tracks and land."""
    cases = catalog.build(*catalog_inputs(spark, d), PERIOD, radii=False)["cases"]
    r = lambda c: F.round(c, 4).alias(c)
    return cases.select("case_id", "storm_id", "name", "basin", "episode_start", "episode_end", "reference_time", "reference_event", r("latitude"), r("longitude"), r("minimum_coast_distance_km"), r("episode_vmax_kt"), "landfall_count", "tier", "selection_method", "provisional_track")


@query()
def p3_event_qc(spark: SparkSession, d: str) -> DataFrame:
    """All named checks of the catalog's primary cases on main tracks."""
    fixes, edges = catalog_inputs(spark, d)
    made = catalog.build(fixes, edges, PERIOD, radii=False)
    cases = kept(made["cases"].where("primary_sample AND NOT provisional_track"))  # the plan and the checks read them
    plan = schedule.schedule(cases.select("case_id", "storm_id", "reference_time"))
    checks = quality.event_qc(cases, fixes, made["points"], plan, edges, PERIOD)
    return checks.select("case_id", F.round("coast_distance_km_at_anchor", 4).alias("coast_distance_km_at_anchor"), "qc_status", "failures", "review_notes")


def matching_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """messages, points, truth, events, cases: two of three storms are observed, every storm has an event nine hours behind its first message and two cases."""
    m = views.messages(spark, d)
    messages = m.select("message_id", "source_file", "init_time", F.format_string("%02dL", F.col("storm_id") % 100).alias("storm_identifier"), F.col("lat").alias("observed_latitude"), F.col("lon").alias("observed_longitude"), F.lit(0).alias("member_number"))
    points = views.points(spark, d).join(m.select("message_id", "init_time"), "message_id").withColumns({"valid_time": F.timestamp_add("HOUR", "lead_hours", "init_time"), "member_number": F.lit(0)})
    atcf = F.format_string("AL%02d2024", F.col("storm_id") % 100)
    truth = m.where("storm_id % 3 <> 0").select("storm_id", atcf.alias("atcf_id"), F.lit("N").alias("name"), F.col("init_time").alias("iso_time"), F.lit("main").alias("track_type"), (F.col("lat") + 0.3).alias("lat"), (F.col("lon") + 0.2).alias("lon")).distinct()
    first = m.groupBy("storm_id").agg(F.min("init_time").alias("init_time"))
    events = first.select(F.concat(F.lit("E"), F.col("storm_id").cast("string")).alias("case_id"), "storm_id", F.timestamp_add("HOUR", F.lit(9), "init_time").alias("reference_time"))
    cases = events.withColumn("nominal_lead_hours", F.explode(F.array(F.lit(6), F.lit(24))))
    init = F.timestamp_add("HOUR", F.when(F.col("nominal_lead_hours") == 6, F.lit(-9)).otherwise(F.lit(-33)), "reference_time")
    return messages, points, truth, events, cases.withColumns({"init_time": init, "forecast_case_id": F.format_string("%s-L%03d", "case_id", "nominal_lead_hours")})


@query()
def p6_case_overlap(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(*matching_inputs(spark, d))["case_overlap"].select("forecast_case_id", "storm_has_forecast", "strict_init_present", "strict_init_usable", "matched_message_id", "unavailable_reason", "forecast_available", "forecast_wind_available", "coverage_method", "previous_valid_time", "next_valid_time")


@query()
def p6_event_overlap(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(*matching_inputs(spark, d))["event_overlap"]


def verification_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """means, members (five a forecast) and truth: storms by the hour, forecasts that drift and weaken."""
    u = F.col("storm_id")
    e = views.fixes(spark, d).withColumn("iso_time", F.date_trunc("hour", "iso_time").cast("timestamp_ntz"))
    held = e.groupBy("storm_id", "iso_time").agg(F.max("wind_kt").alias("wind_kt"))
    lat, lon = (F.lit(-60) + (u * 37) % 120).cast("double"), (F.lit(-180) + (u * 53) % 360).cast("double")
    truth = held.select(F.format_string("WP%03d2024", u).alias("truth_id"), "storm_id", F.lit("WP").alias("basin"), "iso_time", lat.alias("lat"), lon.alias("lon"), "wind_kt", (F.lit(1010.0) - F.col("wind_kt") / 2.0).alias("pressure_hpa"))
    means = truth.withColumn("lead_hours", F.explode(F.array(*[F.lit(h) for h in (0, 6, 12, 24)])))
    means = means.select(F.col("iso_time").alias("init_time"), F.col("truth_id").alias("track_id"), "lead_hours", (F.col("lat") + 0.05 * (F.col("lead_hours") + 2)).alias("lat"), (F.col("lon") + 0.1).alias("lon"), (F.col("wind_kt") * 0.9).alias("wind_kt"), (F.col("pressure_hpa") + 1.0).alias("pressure_hpa")).where("NOT (track_id LIKE '%72024' AND lead_hours = 12)")
    members = means.where("lead_hours > 0").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("NOT (track_id LIKE '%32024' AND sample = 2)")
    members = members.withColumns({"lat": F.col("lat") + F.col("sample") * 0.1, "wind_kt": F.col("wind_kt") + F.col("sample") * 3.0})
    return means, members.select("init_time", "track_id", "lead_hours", "sample", "lat", "lon", "wind_kt"), truth


@query()
def p7_verification_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = verification.verification_cases(*verification_inputs(spark, d), [6, 12, 24], size=5)
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("init_time", "truth_id", "lead_hours", "forecast_present", "id_mapping_method", r("init_match_distance_km"), "member_count", r("track_error_km"), r("vmax_error_kt"), r("pressure_error_hpa"), r("vmax_crps_kt"), r("vmax_brier_64"), r("track_energy_score_km"))


@query()
def p7_verification_summary(spark: SparkSession, d: str) -> DataFrame:
    return verification.summary(verification.verification_cases(*verification_inputs(spark, d), [6, 12, 24], size=5))
