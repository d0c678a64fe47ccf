"""Whole evaluations on small inputs with known answers, and against plain loops."""

import datetime as dt

import numpy as np
import pytest

from galeframe.functions import geo
from galeframe.operators.validation import IntegrityError
from galeframe.pipelines import matching, verification

START = dt.datetime(2024, 8, 1)


def hours(n):
    return START + dt.timedelta(hours=n)


MESSAGE = "message_id string, source_file string, init_time timestamp_ntz, storm_identifier string, observed_latitude double, observed_longitude double, member_number int"
POINT = "message_id string, member_number int, init_time timestamp_ntz, lead_hours int, valid_time timestamp_ntz, latitude double, longitude double, pressure_hpa double, max_wind_ms double"
TRUTH = "storm_id string, atcf_id string, name string, iso_time timestamp_ntz, track_type string, lat double, lon double"


def inputs(spark, messages=(("m1", 0, 10.0, -50.0),), points=(("m1", 0, None), ("m1", 24, 10.0), ("m1", 30, 11.0)), wind=30.0):
    """Messages (id, start, latitude, longitude), points (message, lead, latitude); one event 27 h behind the start with one case."""
    start = {m[0]: m[1] for m in messages}
    m = spark.createDataFrame([(i, "f", hours(h), "04L", y, x, 1) for i, h, y, x in messages], MESSAGE)
    p = spark.createDataFrame([(i, 1, hours(start[i]), h, hours(start[i] + h), y, None if y is None else -50.0, 990.0, wind) for i, h, y in points], POINT)
    t = spark.createDataFrame([("S", "AL042024", "N", hours(0), "main", 10.1, -50.0), ("S", "AL042024", "N", hours(6), "MAIN", 10.2, -50.0), ("S", "AL042024", "N", hours(6), "spur", 0.0, 0.0)], TRUTH)
    e = spark.createDataFrame([("S-CE01", "S", hours(27))], "case_id string, storm_id string, reference_time timestamp_ntz")
    c = spark.createDataFrame([("S-CE01-L024", "S-CE01", "S", hours(0), hours(27), 24)], "forecast_case_id string, case_id string, storm_id string, init_time timestamp_ntz, reference_time timestamp_ntz, nominal_lead_hours int")
    return m, p, t, e, c


def matched(spark, *args, **kwargs):
    given = inputs(spark, *args, **kwargs)
    matching.check_inputs(*given)
    found = matching.match(*given)
    return {r.message_id: r for r in found["storm_links"].collect()}, found["case_overlap"].first(), found["event_overlap"].first(), found


def test_a_case_is_covered_between_two_leads(spark):
    links, case, event, found = matched(spark)
    assert (links["m1"].identity_status, links["m1"].id_mapping_method, links["m1"].usable_forecast, links["m1"].positive_positions, links["m1"].max_valid_lead_hours) == ("matched_cohort", "identifier_and_position", True, 2, 30)
    assert (case.forecast_available, case.coverage_method, case.unavailable_reason, case.previous_valid_time, case.next_valid_time) == (True, "interpolated", "", hours(24), hours(30))
    assert (event.event_time_covered, event.covering_initialization_count, event.initializations, event.available_case_count) == (True, 1, 1, 1)
    year, lead = found["coverage_by_year"].first(), found["coverage_by_lead"].first()
    assert (year.total_events, year.events_with_all_planned_cases, lead.nominal_lead_hours, lead.available_events) == (1, 1, 24, 1)


def test_reasons_why_a_case_is_not_covered(spark):
    assert matched(spark, points=[("m1", 0, 10.0)])[1].unavailable_reason == "no_positive_position_points"
    assert matched(spark, points=[("m1", 24, 10.0), ("m1", 36, 11.0)])[1].unavailable_reason == "reference_time_not_covered"
    links, case, event, _ = matched(spark, messages=[("m1", 6, 10.0, -50.0)])
    assert case.unavailable_reason == "planned_init_absent" and not case.strict_init_present and event.event_time_covered is False and case.storm_has_forecast
    links, case, _, _ = matched(spark, messages=[("m1", 0, 10.0, -50.0), ("m2", 0, 10.0, -50.0)], points=[("m1", 24, 10.0), ("m1", 30, 10.0), ("m2", 24, 12.0)])
    assert case.unavailable_reason == "conflicting_duplicate_forecasts" and {m.duplicate_status for m in links.values()} == {"conflicting_duplicate_forecasts"}
    links, case, event, _ = matched(spark, messages=[("m1", 0, 10.0, -50.0), ("m2", 0, 10.0, -50.0)], points=[(m, h, 10.0) for m in ("m1", "m2") for h in (24, 30)])
    assert case.matched_message_id == "m1" and links["m2"].duplicate_status == "equivalent_duplicate" and event.initializations == 1
    links, case, _, _ = matched(spark, messages=[("m1", 0, 30.0, -50.0)])
    assert links["m1"].identity_status == "no_position_match" and case.unavailable_reason == "planned_init_absent"
    assert matched(spark, messages=[("m1", 0, None, -50.0)])[0]["m1"].identity_status == "missing_observed_position"
    assert not matched(spark, wind=-1.0)[1].forecast_wind_available


def test_matching_inputs_are_checked(spark):
    m, p, t, e, c = inputs(spark)
    for bad in ((m.unionByName(m), p, t, e, c), (m, p, t, e.limit(0), c), (m, p.withColumn("lead_hours", p.lead_hours + 1), t, e, c), (m, p, t.unionByName(t.withColumn("lat", t.lat + 1)), e, c), (m.limit(0), p, t, e, c)):
        with pytest.raises(IntegrityError):
            matching.check_inputs(*bad)


def test_verification_equals_plain_loops(spark):
    rng = np.random.default_rng(5)
    truth, means, members = [], [], []
    for k, sid in enumerate(("AL012024", "SH022025", "WP032024")):
        for h in range(0, 49, 6):
            truth.append((sid, f"S{k}", "B", hours(h), 10.0 * k, 20.0 + h / 10, float(rng.integers(30, 120)), None if h == 24 else 980.0))
        named = {"SH022025": "IO022024", "WP032024": "XX992024"}.get(sid, sid)
        for h in (0, 6):
            for lead in (0, 24, 42):
                means.append((hours(h), named, lead, 10.0 * k + 0.2, 20.0 + (h + lead) / 10, 60.0 + lead, 990.0))
                for s in range(4 if (k, lead) != (1, 24) else 3):
                    members.append((hours(h), named, lead, s, 10.0 * k + s / 10, 20.0 + (h + lead) / 10, 50.0 + 7 * s))
    mean_shape = "init_time timestamp_ntz, track_id string, lead_hours int, lat double, lon double, wind_kt double, pressure_hpa double"
    t = spark.createDataFrame(truth, "truth_id string, storm_id string, basin string, iso_time timestamp_ntz, lat double, lon double, wind_kt double, pressure_hpa double")
    got = verification.verification_cases(spark.createDataFrame(means, mean_shape), spark.createDataFrame(members, "init_time timestamp_ntz, track_id string, lead_hours int, sample int, lat double, lon double, wind_kt double"), t, [24, 42], size=4)
    rows = {(r.truth_id, r.init_time, r.lead_hours): r for r in got.collect()}
    assert set(rows) == {(sid, hours(h), lead) for sid in ("AL012024", "SH022025", "WP032024") for lead in (24, 42) for h in range(0, 49 - lead, 6)}
    assert {r.truth_id: r.id_mapping_method for r in rows.values() if r.init_time == hours(0)} == {"AL012024": "exact", "SH022025": "position_only", "WP032024": "position_only"}
    assert all(r.id_mapping_method == "unlinked" and not r.forecast_present and r.track_error_km is None for r in rows.values() if r.init_time > hours(6))
    seen = {(r[0], r[3]): r for r in truth}
    for (sid, init, lead), r in rows.items():
        if init > hours(6):
            continue
        k, h = int(sid[3]) - 1, (init - START).seconds // 3600
        target = seen[sid, init + dt.timedelta(hours=lead)]
        km = lambda y, x, target=target: float(geo.inverse(y, x, target[4], target[5])[0])
        assert abs(r.track_error_km - km(10.0 * k + 0.2, 20.0 + (h + lead) / 10)) < 0.01 and r.vmax_error_kt == 60.0 + lead - target[6]
        assert r.pressure_error_hpa == (None if target[7] is None else 10.0)
        if (k, lead) == (1, 24):
            assert r.member_count == 3 and r.vmax_crps_kt is None and r.track_energy_score_km is None
        else:
            w = np.array([50.0 + 7 * s for s in range(4)])
            assert abs(r.vmax_crps_kt - (np.abs(w - target[6]).mean() - np.abs(np.subtract.outer(w, w)).mean() / 2)) < 1e-9
            assert abs(r.vmax_brier_64 - ((w >= 64).mean() - (target[6] >= 64)) ** 2) < 1e-12
            places = [(10.0 * k + s / 10, 20.0 + (h + lead) / 10) for s in range(4)]
            between = np.mean([float(geo.inverse(*a, *b)[0]) for a in places for b in places])
            assert abs(r.track_energy_score_km - (np.mean([km(*a) for a in places]) - between / 2)) < 0.01
    one = {r.lead_hours: r for r in verification.summary(got).collect()}
    assert (one[24].eligible, one[24].matched, one[24].full_ensemble_n, one[42].eligible) == (15, 6, 4, 6) and one[42].track_mae_low <= one[42].track_mae_km <= one[42].track_mae_high


def test_catalog_and_its_checks(spark):
    """A landfall and an approach on a square of land; good cases pass, and each change to a case is named."""
    from pyspark.sql import functions as F

    from galeframe.operators import schedule
    from galeframe.pipelines import catalog, quality

    corners = [(0.0, y, 0.0, y - 1.0) for y in range(10, -10, -1)] + [(float(x), -10.0, x + 1.0, -10.0) for x in range(10)] + [(10.0, float(y), 10.0, y + 1.0) for y in range(-10, 10)] + [(x + 1.0, 10.0, float(x), 10.0) for x in range(9, -1, -1)]
    edges = spark.createDataFrame([(1, i, *map(float, s)) for i, s in enumerate(corners)], "ring_id int, segment_id long, lon_a double, lat_a double, lon_b double, lat_b double")
    rows = []
    for storm, places, wind in (("IN", [(0.1, -1.0), (0.1, 1.0)], 70.0), ("BY", [(3.0, -2.5), (3.0, -1.2), (3.5, -2.5)], 80.0), ("WEAK", [(5.0, -1.0), (5.0, 1.0)], 60.0), ("FAR", [(40.0, -60.0), (40.0, -59.0)], 90.0)):
        rows += [(storm, i, hours(3 * i), y, x, wind, storm, "NA", "TS", "main") for i, (y, x) in enumerate(places)]
    fixes = spark.createDataFrame(rows, "storm_id string, fix_id int, iso_time timestamp_ntz, lat double, lon double, wind_kt double, name string, basin string, nature string, track_type string")
    fixes = fixes.withColumns({f"r{kt}_{q}": F.lit(200.0 * 34 / kt) for kt in (34, 50, 64) for q in catalog.QUADRANTS})
    cfg = catalog.CatalogConfig("2024-07-31", "2024-08-31", spacing_km=25.0, sample_km=10.0, candidates=8)
    made = catalog.build(fixes, edges, cfg)
    cases = made["cases"]
    got = {r.case_id: r for r in cases.collect()}
    assert set(got) == {"IN-CE01", "BY-CE01"}
    land, by = got["IN-CE01"], got["BY-CE01"]
    assert (land.reference_event, land.landfall_count, land.tier, land.name, land.basin) == ("landfall", 1, "A", "IN", "NA") and abs(land.longitude) < 1e-3 and abs((land.reference_time - hours(1.5)).total_seconds()) < 60
    assert by.reference_event == "coastal_approach" and by.reference_time == hours(3) and abs(by.minimum_coast_distance_km - float(geo.inverse(3.0, -1.2, 3.0, 0.0)[0])) < 0.5
    plan = schedule.schedule(cases.select("case_id", "storm_id", "reference_time"))
    pick = lambda c, v: F.when(F.col("case_id") == c, v)
    wrong = {
        "tier_a_unsupported;tier_b_should_be_a": None, "reversed_episode": ("BY-CE01", "episode_start", F.timestamp_add("HOUR", F.lit(5), "episode_end")), "invalid_basin": ("BY-CE01", "basin", F.lit("XX")), "landfall_not_on_source_segment": ("IN-CE01", "latitude", F.col("latitude") + 0.2),
        "approach_distance_mismatch": ("BY-CE01", "minimum_coast_distance_km", F.lit(10.0)), "below_intensity_threshold": ("BY-CE01", "episode_vmax_kt", F.lit(50.0)), "reference_outside_period": ("BY-CE01", "reference_time", F.timestamp_add("DAY", F.lit(90), "reference_time")),
        "sample_definition": ("IN-CE01", "tier", F.lit("C")), "forecast_lead_coverage": "plan", "landfall_flag_mismatch": ("IN-CE01", "landfall_count", F.lit(0).cast("long")), "invalid_reference_event": ("BY-CE01", "reference_event", F.lit("other")),
    }
    many, plans = cases.withColumn("set", F.lit("good")), plan.withColumn("set", F.lit("good"))
    for name, change in wrong.items():
        if change is None:
            continue
        changed = cases if change == "plan" else cases.withColumn(change[1], F.coalesce(pick(change[0], change[2]), F.col(change[1])))
        many, plans = many.unionByName(changed.withColumn("set", F.lit(name))), plans.unionByName((plan.where("nominal_lead_hours <> 48") if change == "plan" else plan).withColumn("set", F.lit(name)))
    own = F.concat("set", F.lit("/"), "case_id")
    checks = quality.event_qc(many.withColumn("case_id", own).drop("set"), fixes, made["points"], plans.withColumn("case_id", own).drop("set"), edges, cfg, candidates=16)
    found = {}
    for r in checks.collect():
        name, case = r.case_id.split("/")
        found.setdefault(name, {})[case] = set(r.failures.split(";")) - {""}
    assert found["good"] == {"IN-CE01": set(), "BY-CE01": set()}
    for name, change in wrong.items():
        if change is not None:
            hit = found[name]["IN-CE01" if change == "plan" else change[0]]
            assert name in hit
    good = checks.where("case_id LIKE 'good/%'")
    assert quality.approved(cases.withColumn("case_id", F.concat(F.lit("good/"), "case_id")), good).where("qc_status = 'passed'").count() == 2
