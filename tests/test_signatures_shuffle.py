"""Points that lie by message are signed where they lie."""

from galeframe.operators import duplicates
from galeframe.pipelines import matching
from galeframe.plans.q_pipelines import matching_inputs


def test_f9_f12_signatures_and_conflicts(spark):
    rows = [(1, 6, 10.0), (1, 6, 10.0), (1, 12, None), (2, 12, None), (2, 6, 10.0), (3, 6, 10.0), (3, 6, 11.0), (4, None, 1.0), (4, None, 2.0), (5, None, 1.0)]
    points = spark.createDataFrame(rows, "message_id int, lead_hours int, latitude double").repartition(4, "message_id")
    signed = duplicates.signatures(points, "message_id", ["lead_hours"], ["latitude"])
    got = {r.message_id: r for r in signed.collect()}
    assert {k: (r.points, r.conflict) for k, r in got.items()} == {1: (2, False), 2: (2, False), 3: (2, True), 4: (2, True), 5: (1, False)}
    assert got[1].signature == got[2].signature and len({r.signature for r in got.values()}) == 4


def test_f9_f12_points_are_shuffled_by_message_only(spark):
    messages, points, truth, events, _ = matching_inputs(spark, "/root/testdata/sf0.001")
    plan = matching.links(messages, points, truth, events)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and [line for line in dealt if "lead_hours" in line.split("hashpartitioning(")[1].split("ENSURE")[0]] == []
