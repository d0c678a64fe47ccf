"""Checks of a catalog's cases against the tracks, the coast and the forecast plan they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import joins, spatial, validation
from galeframe.operators.lineage import kept
from galeframe.pipelines.catalog import CatalogConfig, coast_distance

#: The basins of best tracks.
BASINS = ("NA", "EP", "WP", "NI", "SI", "SP", "SA")
PROBE_KM = 0.5


def _sources(cases: DataFrame, fixes: DataFrame) -> DataFrame:
    """case_id with the track types, basins and names of its storm's fixes."""
    held = fixes.groupBy("storm_id").agg(F.collect_set(F.lower("track_type")).alias("kinds"), F.collect_set("basin").alias("basins"), F.collect_set("name").alias("names"))
    return cases.select("case_id", "storm_id").join(held, "storm_id", "left").drop("storm_id")


def _anchor(cases: DataFrame, fixes: DataFrame, edges: DataFrame) -> DataFrame:
    """case_id with the source segment around a landfall: whether it exists, its hours, how far the anchor lies from it, and the ground just before and behind."""
    b = joins.bracket(cases.select("case_id", "storm_id", "reference_time", "latitude", "longitude"), fixes.select("storm_id", "iso_time", "lat", "lon"), "storm_id", "reference_time", "iso_time", ["lat", "lon"], gap_hours=1e9, inclusive=True)
    b = b.withColumns({"outside": F.col("before").isNull() | F.col("after").isNull(), "hours": scalar.hours_between("before.time", "after.time")})
    s = b.where("hours > 0").select("case_id", "latitude", "longitude", F.col("before.lat").alias("y"), F.col("before.lon").alias("x"), F.col("after.lat").alias("y2"), F.col("after.lon").alias("x2"), (scalar.hours_between("before.time", "reference_time") / F.col("hours")).alias("f"))
    s = s.withColumns({"km": geo.exact_distance_km("y", "x", "y2", "x2"), "way": geo.exact_bearing_deg("y", "x", "y2", "x2")})
    # half a kilometre either way, and no farther than half of what is left of the segment
    off = F.least(F.lit(PROBE_KM) / F.greatest(F.col("km"), F.lit(1e-3)), F.col("f") / 2.0, (1.0 - F.col("f")) / 2.0)
    probes = F.array(*[F.struct(F.lit(side).alias("side"), (F.col("f") + k * off).alias("t")) for side, k in (("at", 0), ("before", -1), ("behind", 1))])
    p = s.withColumn("p", F.explode(probes)).withColumn("place", geo.destination("y", "x", "way", F.col("km") * F.col("p.t")))
    p = p.select("case_id", "latitude", "longitude", F.col("p.side").alias("side"), F.col("place.latitude").alias("lat"), F.col("place.longitude").alias("lon")).withColumn("point_id", F.struct("case_id", "side"))
    ground = spatial.covered_by(p, edges).select("point_id.case_id", "point_id.side", "is_land")
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("is_land")))
    off_km = p.where("side = 'at'").select("case_id", geo.distance_km("lat", "lon", "latitude", "longitude").alias("off_segment_km"))
    out = ground.groupBy("case_id").agg(side("before").alias("land_before"), side("behind").alias("land_behind")).join(off_km, "case_id")
    return b.select("case_id", "outside", "hours").join(out, "case_id", "left")


def _plan_failure(plan: DataFrame, leads: Sequence[int], tolerance_hours: float) -> DataFrame:
    """case_id with whether its leads are exactly the expected ones, and the first failure of its first failing row."""
    us = scalar.micros
    target = us("case_reference") - F.col("nominal_lead_hours") * F.lit(scalar.HOUR_US)
    actual, offset = scalar.hours_between("init_time", "case_reference"), (us("init_time") - target) / float(scalar.HOUR_US)
    near = lambda a, b: F.coalesce(F.abs(a - F.col(b)) <= 1e-6, F.lit(False))
    failed = (
        F.when(F.col("status") != "planned", "forecast_cycle_unmatched").when(~F.col("reference_time").eqNullSafe(F.col("case_reference")), "forecast_reference_time_mismatch").when(~us("target_time").eqNullSafe(target), "forecast_target_time_mismatch")
        .when(us("init_time") % F.lit(6 * scalar.HOUR_US) != 0, "forecast_nonstandard_cycle").when(~near(actual, "actual_lead_hours"), "forecast_actual_lead_mismatch")
        .when(F.abs(actual - F.col("nominal_lead_hours")) > tolerance_hours + 1e-6, "forecast_cycle_offset_exceeded").when(~near(offset, "offset_hours"), "forecast_cycle_offset_mismatch")
    )
    held = plan.withColumn("failed", failed).groupBy("case_id").agg(F.array_sort(F.collect_list("nominal_lead_hours")).alias("leads"), F.min(F.when(F.col("failed").isNotNull(), F.struct("nominal_lead_hours", "failed")))["failed"].alias("plan_failure"))
    return held.select("case_id", F.lit(True).alias("planned"), (F.col("leads") == F.array(*[F.lit(h).cast("int") for h in sorted(leads)])).alias("leads_fit"), "plan_failure")


def event_qc(cases: DataFrame, fixes: DataFrame, dense: DataFrame, plan: DataFrame, edges: DataFrame, cfg: CatalogConfig, leads: Sequence[int] = (24, 48, 72, 96, 120), tolerance_hours: float = 3.0, candidates: int = 64) -> DataFrame:
    """case_id, storm_id, coast_distance_km_at_anchor, qc_status, failures, review_notes: one row a case.

    cases, dense: tables of catalog.build(); plan: schedule.schedule() of the cases. Geometry is
    computed anew, with more candidate segments than the catalog took. Failures are joined in order
    of their names, notes in the order of their rules.
    """
    start, end = cfg.period()
    pad = int(cfg.padding_hours * scalar.HOUR_US)
    c = kept(cases.withColumn("point_id", F.col("case_id")))
    positioned = c.where(geo.valid_position("latitude", "longitude")).select("point_id", "latitude", "longitude")
    far = coast_distance(positioned, edges, spatial.samples(edges, cfg.sample_km), candidates, "point_id", "latitude", "longitude").select(F.col("point_id").alias("case_id"), F.col("distance_km").alias("coast_distance_km_at_anchor"))
    ground = spatial.covered_by(positioned, edges, "point_id", "latitude", "longitude").select(F.col("point_id").alias("case_id"), F.col("is_land").alias("anchor_on_land"))
    peak = joins.in_interval(dense.select("storm_id", "iso_time", "wind_kt"), c.select("case_id", "storm_id", "episode_start", "episode_end"), "storm_id", "iso_time", "episode_start", "episode_end", cfg.padding_hours).groupBy("case_id").agg(F.max("wind_kt").alias("window_peak"))
    beside = joins.in_interval(dense.select("storm_id", "iso_time", "lat", "lon"), c.select("case_id", "storm_id", "reference_time", "latitude", "longitude"), "storm_id", "iso_time", "reference_time", "reference_time", 1 / 3600)
    beside = beside.groupBy("case_id").agg(F.min(geo.distance_km("lat", "lon", "latitude", "longitude")).alias("off_track_km"))
    in_dense = dense.select("storm_id", F.lit(True).alias("has_points")).distinct()
    plan = plan.join(c.select("case_id", F.col("reference_time").alias("case_reference")), "case_id")
    tables = (_sources(c, fixes), far, ground, peak, beside, _anchor(c, fixes, edges), _plan_failure(plan, leads, tolerance_hours))
    for t in tables:
        c = c.join(kept(t), "case_id", "left")
    c = c.join(in_dense, "storm_id", "left")
    us, col = scalar.micros, F.col
    landfall, approach = col("reference_event") == "landfall", col("reference_event") == "coastal_approach"
    within = lambda a, b, x: a.isNotNull() & (a >= b) & (a <= x)
    if_land = lambda ok: ~landfall | F.coalesce(ok, F.lit(False))
    if_near = lambda ok: ~approach | F.coalesce(ok, F.lit(False))
    strong = F.coalesce(col("r64_contact"), F.lit(False)) | F.coalesce(col("landfall_vmax_kt") >= 64, F.lit(False))
    contact = F.coalesce(col("r50_contact"), F.lit(False)) | (col("landfall_count") > 0)
    shore = geo.distance_km("latitude", "longitude", "nearest_coast_latitude", "nearest_coast_longitude")
    # a segment is looked at where it exists, and its place and direction where it is no gap
    in_track = ~F.coalesce(col("outside"), F.lit(True))
    no_gap = in_track & F.coalesce((col("hours") > 0) & (col("hours") <= 6), F.lit(False))
    there = col("latitude").isNotNull() & col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude")
    rules: dict[str, Column] = {
        "non_main_track": col("kinds") == F.array(F.lit("main")), "basin_not_in_source_track": F.array_contains("basins", col("basin")), "name_not_in_source_track": F.array_contains("names", col("name")),
        "sample_definition": col("primary_sample") & ~col("provisional_track") & col("tier").isin("A", "B"), "reference_outside_period": col("reference_time").between(start, end), "reversed_episode": col("episode_start") <= col("episode_end"),
        "reference_outside_contact_window": within(us("reference_time"), us("episode_start") - pad, us("episode_end") + pad), "missing_coordinate": there, "invalid_coordinate": ~there | (F.abs("latitude") <= 90) & (F.abs("longitude") <= 180),
        "invalid_basin": col("basin").isin(*BASINS), "below_intensity_threshold": col("episode_vmax_kt") >= cfg.threshold_kt, "invalid_coverage_fraction": col("r34_coverage").between(0, 1) & col("wind_coverage").between(0, 1),
        "episode_wind_mismatch": F.abs(col("window_peak") - col("episode_vmax_kt")) <= 1e-6, "tier_a_unsupported": (col("tier") != "A") | strong, "tier_b_should_be_a": (col("tier") != "B") | ~strong, "tier_b_unsupported": (col("tier") != "B") | contact,
        "landfall_flag_mismatch": if_land(col("landfall_count") >= 1), "landfall_not_on_coast": if_land(col("coast_distance_km_at_anchor") <= 0.5), "landfall_nearest_coast_mismatch": if_land(shore <= 1e-6), "landfall_outside_source_track": if_land(in_track),
        "landfall_source_segment_gap": if_land(~in_track | no_gap), "landfall_not_on_source_segment": if_land(~no_gap | (col("off_segment_km") <= 0.5)), "landfall_direction_not_sea_to_land": if_land(~no_gap | ~col("land_before") & col("land_behind")),
        "approach_has_landfall": if_near(col("landfall_count") == 0), "approach_center_on_land": if_near(~col("anchor_on_land")), "approach_distance_mismatch": if_near(F.abs(col("coast_distance_km_at_anchor") - col("minimum_coast_distance_km")) <= 2),
        "approach_nearest_coast_mismatch": if_near(F.abs(shore - col("minimum_coast_distance_km")) <= 2), "approach_not_on_dense_track": if_near(col("off_track_km") <= 0.1), "invalid_reference_event": landfall | approach,
        "forecast_lead_coverage": col("leads_fit"),
    }
    plan_rules = ("forecast_cycle_unmatched", "forecast_reference_time_mismatch", "forecast_target_time_mismatch", "forecast_nonstandard_cycle", "forecast_actual_lead_mismatch", "forecast_cycle_offset_exceeded", "forecast_cycle_offset_mismatch")
    rules |= {name: ~col("plan_failure").eqNullSafe(F.lit(name)) for name in plan_rules}
    lacking = col("kinds").isNull() | col("has_points").isNull() | col("planned").isNull()
    failures = F.when(lacking, "missing_source_or_plan").otherwise(validation.named_failures(rules))
    inside = col("reference_time").between(col("episode_start"), col("episode_end"))
    noted = {"source_qc_status_already_changed": col("qc_status") != "pending", "multiple_landfalls": col("landfall_count") >= 5, "limited_r34_coverage": col("r34_coverage") < 0.8, "limited_wind_coverage": col("wind_coverage") < 0.8, "anchor_within_six_hour_padding": ~inside, "distant_wind_radius_contact": approach & (col("minimum_coast_distance_km") > 100)}
    out = c.select("case_id", "storm_id", "coast_distance_km_at_anchor", failures.alias("failures"), F.when(lacking, "").otherwise(validation.notes(noted)).alias("review_notes"))
    return out.withColumn("qc_status", F.when(F.col("failures") == "", "passed").otherwise("failed"))


def approved(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """cases with the status of their check; raises if a case has not exactly one."""
    return joins.join_checked(cases.drop("qc_status"), checks.select("case_id", "qc_status"), ["case_id"], "one_to_one")
