"""The hand-over to model runs: each rule by one fault, tables, counts."""

from datetime import datetime, timedelta

import pytest

from galeframe.operators import handoff, validation

EVENT = "case_id string, storm_id string, reference_time timestamp_ntz, reference_event string, qc_status string, name string, basin string"
PLAN = (
    "forecast_case_id string, case_id string, storm_id string, schedule_status string, nominal_lead_hours int, init_time timestamp_ntz, reference_time timestamp_ntz, "
    "reference_event string, target_init_time timestamp_ntz, actual_lead_hours double, cycle_offset_hours double"
)
AT = datetime(2024, 9, 5, 4, 30)


def event(n=1, **other):
    return {"case_id": f"E{n}", "storm_id": f"S{n}", "reference_time": AT, "reference_event": "landfall", "qc_status": "passed", "name": "ONE", "basin": "NA"} | other


def plan(lead, n=1, **other):
    target = AT - timedelta(hours=lead)
    init = target + timedelta(hours=1.5)
    return {
        "forecast_case_id": f"E{n}-L{lead:03d}", "case_id": f"E{n}", "storm_id": f"S{n}", "schedule_status": "matched", "nominal_lead_hours": lead, "init_time": init, "reference_time": AT,
        "reference_event": "landfall", "target_init_time": target, "actual_lead_hours": lead - 1.5, "cycle_offset_hours": 1.5,
    } | other


def plans(n=1):
    return [plan(h, n) for h in handoff.LEADS]


def found(spark, events, rows, **expected):
    e, p = spark.createDataFrame(events, EVENT), spark.createDataFrame(rows, PLAN)
    return sorted((r.rule, r.key, r.detail) for r in handoff.findings(e, p, **expected).collect())


def test_nothing_wrong(spark):
    assert found(spark, [event(1), event(2)], [*plans(1), *plans(2)], event_count=2, plan_count=10) == []
    assert found(spark, [], []) == []


HOUR = timedelta(hours=1)
FAULTS = [
    ({"case_id": "E9"}, {("event_unknown", "E1-L024", ""), ("case_id_differs", "E1-L024", ""), ("leads_missing", "E1", "24")}),
    ({"schedule_status": "no_cycle"}, {("not_matched", "E1-L024", "")}),
    ({"schedule_status": None}, {("not_matched", "E1-L024", "")}),
    ({"storm_id": "S2"}, {("storm_differs", "E1-L024", "")}),
    ({"forecast_case_id": "E1-L24"}, {("case_id_differs", "E1-L24", "")}),
    ({"reference_event": "closest"}, {("reference_differs", "E1-L024", "")}),
    ({"actual_lead_hours": 22.4}, {("actual_lead_differs", "E1-L024", "")}),
    ({"actual_lead_hours": 22.5 + 5e-7}, set()),
    ({"cycle_offset_hours": 1.4}, {("offset_differs", "E1-L024", "")}),
    ({"init_time": datetime(2024, 9, 4, 6, 0, 0, 1)}, {("init_off_cycle", "E1-L024", "")}),
    ({"init_time": datetime(2024, 9, 4, 12), "actual_lead_hours": 16.5, "cycle_offset_hours": 7.5}, {("offset_too_large", "E1-L024", "")}),
    ({"init_time": datetime(2024, 9, 5, 6), "actual_lead_hours": -1.5, "cycle_offset_hours": 25.5}, {("offset_too_large", "E1-L024", ""), ("starts_after_event", "E1-L024", "")}),
    ({"init_time": datetime(2024, 8, 26, 0), "actual_lead_hours": 244.5, "cycle_offset_hours": -220.5}, {("offset_too_large", "E1-L024", ""), ("horizon_too_long", "E1-L024", "")}),
    ({"target_init_time": AT - 23 * HOUR, "cycle_offset_hours": 0.5}, {("target_differs", "E1-L024", "")}),
    ({"nominal_lead_hours": 30, "forecast_case_id": "E1-L030"}, {("lead_unexpected", "E1-L030", ""), ("target_differs", "E1-L030", ""), ("leads_missing", "E1", "24")}),
    ({"nominal_lead_hours": 48, "forecast_case_id": "E1-L048", "init_time": datetime(2024, 9, 3, 6), "target_init_time": AT - 48 * HOUR, "actual_lead_hours": 46.5}, {("lead_repeated", "E1|48", "2"), ("case_repeated", "E1-L048", "2"), ("leads_missing", "E1", "24")}),
]


@pytest.mark.parametrize("fault,want", FAULTS)
def test_each_rule(spark, fault, want):
    assert set(found(spark, [event()], [plan(24, **fault), *plans()[1:]])) == want


def test_rules_of_events_and_counts(spark):
    assert found(spark, [event(qc_status="failed"), event(2)], plans()) == [("event_not_passed", "E1", "failed"), ("leads_missing", "E2", "24,48,72,96,120")]
    assert found(spark, [event(), event()], plans(), event_count=1, plan_count=6) == [("event_count", "", "2"), ("event_repeated", "E1", "2"), ("plan_count", "", "5")]
    rows = found(spark, [event()], [plan(24, **dict.fromkeys(("case_id", "storm_id", "init_time", "reference_time", "nominal_lead_hours"))), *plans()[1:]])
    assert {r[0] for r in rows} >= {"event_unknown", "lead_unexpected", "case_id_differs", "init_off_cycle", "target_differs", "starts_after_event", "horizon_too_long", "leads_missing"}


def test_tables_and_counts(spark):
    e, p = spark.createDataFrame([event(1), event(2)], EVENT), spark.createDataFrame([*plans(1), *plans(2)], PLAN)
    cases, index = handoff.build(e, p, event_count=2, plan_count=10)
    first = cases.orderBy("case_id").first()
    assert (first.case_id, first.storm_id, first.init_time, first.forecast_hours, first.output_interval_hours, first.name, first.basin) == ("E1-L024", "S1", datetime(2024, 9, 4, 6), 24, 6, "ONE", "NA")
    rows = index.collect()
    assert len(rows) == 10 and all(r.forecast_hours % 6 == 0 and r.init_time + timedelta(hours=r.forecast_hours - 6) < r.reference_time <= r.forecast_end_time == r.init_time + timedelta(hours=r.forecast_hours) for r in rows)
    n = handoff.counts(index).first()
    assert (n.event_count, n.case_count, n.unique_init_time_count, n.forecast_hours_counts) == (2, 10, 5, {24: 2, 48: 2, 72: 2, 96: 2, 120: 2})
    empty = handoff.counts(index.limit(0)).first()
    assert (empty.case_count, empty.forecast_hours_counts) == (0, {})
    with pytest.raises(validation.IntegrityError, match="event_count"):
        handoff.build(e, p, event_count=114)
