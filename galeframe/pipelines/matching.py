"""Deterministic forecasts against a cohort of events: whose storm a message is, which initializations can be used, which cases and events they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import aggregates, duplicates, joins, validation
from galeframe.operators.lineage import kept

VALUES = ("valid_time", "latitude", "longitude", "pressure_hpa", "max_wind_ms")


def check_inputs(messages: DataFrame, points: DataFrame, truth: DataFrame, events: DataFrame, cases: DataFrame) -> None:
    """Raise IntegrityError unless ids are unique, references hold, and times agree with leads."""
    of_message = points.join(messages.select("message_id", F.col("init_time").alias("_init"), F.col("member_number").alias("_member")), "message_id")
    lead = F.col("lead_hours") >= 0
    time = (scalar.micros("valid_time") == scalar.micros("_init") + F.col("lead_hours") * F.lit(scalar.HOUR_US)) & (F.col("init_time") == F.col("_init"))
    main = _main(truth)
    validation.require(
        validation.unique_key(messages, ["message_id"]), validation.unique_key(events, ["case_id"]), validation.unique_key(cases, ["forecast_case_id"]), validation.not_null(messages, ["init_time"], ["message_id"]),
        validation.foreign_key(cases, events, ["case_id"], "unknown_event"), validation.agreement(cases, events, ["case_id"], ["storm_id", "reference_time"]), validation.foreign_key(points, messages, ["message_id"], "unknown_message"),
        validation.check(of_message, lead & time, ["message_id", "lead_hours"], "lead_or_time"), validation.check(of_message, F.col("member_number").eqNullSafe(F.col("_member")), ["message_id"], "member"), validation.unique_key(main, ["storm_id", "iso_time"], "conflicting_positions"),
    )


def _main(truth: DataFrame) -> DataFrame:
    """Main-track positions of every nature, each once."""
    t = truth.where((F.lower(F.trim("track_type")) == "main") & geo.valid_position("lat", "lon"))
    return t.select("storm_id", F.upper(F.trim("atcf_id")).alias("atcf_id"), "name", "iso_time", "lat", "lon").dropDuplicates(["storm_id", "iso_time", "lat", "lon", "atcf_id"])


def links(messages: DataFrame, points: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """messages with storm, how it was found, duplicate status, canonical message and whether that is usable (any position after the start)."""
    # dealt by message once: distinct rows, counts and signatures of messages then need no shuffle of their own
    main, own = _main(truth), points.repartition("message_id").distinct()
    m = messages.withColumns({"lat": F.col("observed_latitude"), "lon": F.col("observed_longitude")})
    found = joins.identify(m, main, events.select("storm_id").distinct()).drop("lat", "lon")
    names = main.select("storm_id", F.col("iso_time").alias("init_time"), F.col("atcf_id").alias("truth_atcf_id"), F.col("name").alias("truth_name"))
    found = found.join(names, ["storm_id", "init_time"], "left").withColumn("identifier_agrees", scalar.identifier_agrees("storm_identifier", "truth_atcf_id"))
    method = F.when(F.col("storm_id").isNull(), "").when(F.col("identifier_agrees"), "identifier_and_position").otherwise("position_identifier_mismatch")
    later = (F.col("lead_hours") > 0) & geo.valid_position("latitude", "longitude")
    positive = own.groupBy("message_id").agg(F.count_if(later).alias("positive_positions"), F.max(F.when(later, F.col("lead_hours"))).alias("max_valid_lead_hours"))
    signed = duplicates.signatures(own, "message_id", ["member_number", "lead_hours"], VALUES)
    found = found.withColumn("id_mapping_method", method).join(positive, "message_id", "left").join(signed.select("message_id", "signature", "conflict"), "message_id", "left")
    found = found.withColumn("positive_positions", F.coalesce("positive_positions", F.lit(0).cast("long")))
    known = duplicates.reconcile(found.where("storm_id IS NOT NULL"), ["storm_id", "init_time"])
    alone = found.where("storm_id IS NULL").withColumns({"duplicate_status": F.when(F.coalesce("conflict", F.lit(False)), "within_message_conflict").otherwise("unique"), "canonical_message_id": F.lit(None).cast(dict(messages.dtypes)["message_id"])})
    both = known.unionByName(alone)
    return both.withColumn("usable_forecast", F.col("canonical_message_id").isNotNull() & (F.col("positive_positions") > 0)).drop("signature", "conflict")


def _covered(rows: DataFrame, points: DataFrame) -> DataFrame:
    """rows (matched_message_id, reference_time) with coverage of the reference time by the message's positions; repeated positions change nothing."""
    placed = points.where(geo.valid_position("latitude", "longitude")).select(F.col("message_id").alias("matched_message_id"), "valid_time", "max_wind_ms", "pressure_hpa")
    return joins.coverage_flags(joins.bracket(rows, placed, "matched_message_id", "reference_time", "valid_time", ["max_wind_ms", "pressure_hpa"]), "max_wind_ms", "pressure_hpa")


def case_overlap(linked: DataFrame, points: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case with its exact initialization, whether it covers the reference time, and the first reason if not."""
    group = linked.where("storm_id IS NOT NULL").groupBy("storm_id", "init_time").agg(F.max("canonical_message_id").alias("matched_message_id"), F.bool_or("usable_forecast").alias("strict_init_usable"), F.lit(True).alias("strict_init_present"))
    with_any = linked.where("usable_forecast").select("storm_id", F.lit(True).alias("storm_has_forecast")).distinct()
    rows = cases.join(group, ["storm_id", "init_time"], "left").join(with_any, "storm_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("strict_init_usable", "strict_init_present", "storm_has_forecast")})
    before = F.col("init_time") < F.col("reference_time")
    asks = F.col("strict_init_usable") & before
    out = _covered(rows.withColumn("_own", F.col("matched_message_id")).withColumn("matched_message_id", F.when(asks, F.col("_own"))), points)
    conflict = F.col("strict_init_present") & F.col("_own").isNull()
    reason = joins.unavailable_reason(conflict, F.col("strict_init_present"), F.col("strict_init_usable"), before, F.col("forecast_available"))
    out = out.withColumns({"unavailable_reason": reason, "previous_valid_time": F.col("before.time"), "next_valid_time": F.col("after.time"), "matched_message_id": F.col("_own")})
    return out.drop("_own", "before", "after")


def event_overlap(linked: DataFrame, points: DataFrame, events: DataFrame, overlap: DataFrame) -> DataFrame:
    """Every event with the number of usable initializations, how many before it cover its time, and counts over its cases.

    Only initializations whose positions span the event's time are compared with it.
    """
    usable = linked.where("usable_forecast AND message_id = canonical_message_id").select("storm_id", "init_time", "message_id")
    placed = points.where(geo.valid_position("latitude", "longitude")).groupBy("message_id").agg(F.min("valid_time").alias("_from"), F.max("valid_time").alias("_to"))
    spans = usable.join(placed, "message_id").withColumnRenamed("message_id", "matched_message_id")
    near = joins.in_interval(events.select("case_id", "storm_id", "reference_time"), spans, "storm_id", "reference_time", "_from", "_to").where("init_time < reference_time")
    hit = _covered(near.select("case_id", "reference_time", "matched_message_id"), points)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    held = hit.groupBy("case_id").agg(any_("forecast_available").alias("event_time_covered"), any_("forecast_wind_available").alias("event_wind_available"), any_("forecast_pressure_available").alias("event_pressure_available"), F.count_if("forecast_available").alias("covering_initialization_count"))
    n = lambda c: F.count_if(F.col(c))
    planned = overlap.groupBy("case_id").agg(F.count("*").alias("planned_case_count"), n("strict_init_present").alias("strict_init_present_case_count"), n("forecast_available").alias("available_case_count"), n("forecast_wind_available").alias("wind_available_case_count"), n("forecast_pressure_available").alias("pressure_available_case_count"))
    out = joins.usable_initializations(events, usable.withColumn("usable", F.lit(True))).join(held, "case_id", "left").join(planned, "case_id", "left")
    zero = [c for c in (*held.columns, *planned.columns) if c.endswith("count")]
    no = [c for c in held.columns if c.startswith("event_")]
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero} | {c: F.coalesce(c, F.lit(False)) for c in no})


def match(messages: DataFrame, points: DataFrame, truth: DataFrame, events: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    """storm_links, case_overlap, event_overlap, coverage_by_year and coverage_by_lead. Every input event and case stays in its table."""
    linked = kept(links(messages, points, truth, events))
    overlap = case_overlap(linked, points, cases)
    covered = event_overlap(linked, points, events, overlap)
    return {"storm_links": linked, "case_overlap": overlap, "event_overlap": covered, "coverage_by_year": aggregates.coverage_by_year(covered, overlap), "coverage_by_lead": aggregates.coverage_by_lead(overlap)}
