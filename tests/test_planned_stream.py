"""The planned fold over a stream with late, missing and repeated leads, across restarts, against a plain fold."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from galeframe.streaming import planned

LEADS = [0, 6, 12, 18]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 1)


def plain(values, most):
    """Rows of one case from its value by lead."""
    out, held, ok = [], None, True
    for k, lead in enumerate(LEADS):
        if lead not in values:
            return out + [(h, held, "terminated") for h in LEADS[k:]]
        ok = ok and (held is None or abs(values[lead] - held) <= most)
        held = values[lead] if ok else held
        out.append((lead, held, "ok" if ok else "lost"))
    return out


def test_equals_a_plain_fold_over_restarts(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    cases = {"whole": {0: 1.0, 6: 2.0, 12: 3.0, 18: 4.0}, "lost": {0: 1.0, 6: 2.0, 12: 9.0, 18: 2.0}, "gap": {0: 1.0, 6: 1.5, 18: 1.6}, "late start": {6: 1.0, 12: 1.0}, "one": {0: 7.0}}
    row = lambda case, lead, value: (case, lead, START + timedelta(hours=lead), value)
    batches = [
        [row("whole", 12, 3.0), row("whole", 0, 1.0), row("lost", 0, 1.0), row("gap", 0, 1.0), row("one", 0, 7.0)],  # out of order
        [row("whole", 6, 2.0), row("whole", 0, 50.0), row("lost", 6, 2.0), row("lost", 12, 9.0), row("gap", 6, 1.5), row("late start", 6, 1.0)],  # repeated
        [row("whole", 18, 4.0), row("lost", 18, 2.0), row("gap", 18, 1.6), row("late start", 12, 1.0), row("one", 7, 1.0), ("one", 6, START, None)],  # not in the plan, null
        [("clock", 0, START + timedelta(hours=60), 0.0)],
        [("clock", 6, START + timedelta(hours=66), 0.0), row("gap", 12, 1.5)],  # behind the watermark
    ]
    schema = "forecast_case_id string, lead_hours int, valid_time timestamp, value double"
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = planned.hold_or_lose_planned(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), LEADS, 1.0, "24 hours")
            # a query of its own each time: state comes from the checkpoint
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out")).where(F.col("forecast_case_id") != "clock").collect()
    want = {(c, *r) for c, values in cases.items() for r in plain(values, 1.0)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_plans_must_rise(spark):
    with pytest.raises(ValueError, match="rise"):
        planned.hold_or_lose_planned(spark.range(1), [6, 0], 1.0)
