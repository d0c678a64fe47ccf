"""Queries over rules, QC and resume (K, C21, A25 of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import scalar
from galeframe.operators import handoff, inventory, qc, validation
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.sources import checkpoint


@query("""SELECT 'duplicate_key' AS rule, l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'range', event_id::VARCHAR, value::INTEGER::VARCHAR FROM (SELECT event_id, floor(value) AS value FROM events WHERE NOT (value <= 200))
UNION ALL SELECT 'missing_value', event_id::VARCHAR, 'r34_ne' FROM events WHERE event_type = 'error'""")
def k01_violations(spark: SparkSession, d: str) -> DataFrame:
    li, e = views.table(spark, d, "lineitem"), views.table(spark, d, "events")
    nulls = e.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("r34_ne"))
    return validation.violations(
        validation.unique_key(li, ["l_orderkey", "l_linenumber"]), validation.check(e, F.col("value") <= 200, ["event_id"], "range", F.floor("value").cast("int")), validation.not_null(nulls, ["r34_ne"], ["event_id"])
    )


@query("""SELECT fix_id, concat_ws(';', CASE WHEN NOT (abs(lat) <= 55) THEN 'latitude_out_of_range' END, CASE WHEN r34_ne IS NULL THEN 'radius_missing' END, CASE WHEN NOT (wind_kt >= 1) THEN 'wind_too_low' END) AS failures,
 concat_ws(';', CASE WHEN wind_kt > 200 THEN 'very_strong' END, CASE WHEN track_type = 'PROVISIONAL' THEN 'provisional' END) AS notes, abs(lat) <= 55 AND r34_ne IS NOT NULL AND wind_kt >= 1 AS passed FROM fixes""", ("fixes",))
def k03_event_qc(spark: SparkSession, d: str) -> DataFrame:
    f = views.fixes(spark, d)
    failed = validation.named_failures({"wind_too_low": F.col("wind_kt") >= 1, "latitude_out_of_range": F.abs("lat") <= 55, "radius_missing": F.col("r34_ne").isNotNull()})
    noted = validation.notes({"very_strong": F.col("wind_kt") > 200, "provisional": F.col("track_type") == "PROVISIONAL"})
    return f.select("fix_id", failed.alias("failures"), noted.alias("notes"), (failed == "").alias("passed"))


@query()
def k03_episode_qc(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's own rules over the episodes."""
    from galeframe.plans.q_sequences import episode_table

    return qc.event_checks(episode_table(spark, d))


@query("""SELECT event_id, concat_ws(';', CASE WHEN NOT (h > 0 AND h <= 240) THEN 'horizon_out_of_range' END, CASE WHEN NOT (h % 6 = 0) THEN 'horizon_not_in_steps' END, CASE WHEN i > ts THEN 'starts_after_event' END) AS failures
 FROM (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY AS i, (event_id % 300)::INTEGER AS h FROM events)""")
def c21_k04_handoff_checks(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select(F.col("event_id").alias("case_id"), F.col("ts").alias("reference_time"), (F.date_trunc("day", "ts").cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")).alias("init_time"), (F.col("event_id") % 300).cast("int").alias("forecast_hours"))
    return qc.handoff_checks(e).select(F.col("case_id").alias("event_id"), "failures")


@query("""SELECT forecast_case_id FROM (SELECT 'C' || o_orderkey::VARCHAR AS forecast_case_id, o_orderkey FROM orders) WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0)""")
def a25_k05_resume(spark: SparkSession, d: str) -> DataFrame:
    """Cases to run: all but those with a stored result of the same fingerprint; input errors are run again."""
    o = views.table(spark, d, "orders")
    cases = o.select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("forecast_case_id"), F.lit("same").alias("fingerprint"))
    done = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("forecast_case_id"), F.lit("same").alias("fingerprint"), F.when(F.col("o_orderkey") % 9 == 0, "input_error").otherwise("ok").alias("case_status"))
    return checkpoint.pending(cases, done, ["forecast_case_id"]).select("forecast_case_id")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'partial_file' WHEN p_retailprice < 950 THEN 'size_mismatch' ELSE 'ok' END AS state FROM part""")
def k06_inventory_checks(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part")
    return p.select("p_partkey", F.when(F.col("p_size") > 40, "partial_file").when(F.col("p_retailprice") < 950, "size_mismatch").otherwise("ok").alias("state"))


@query("""
WITH e AS (SELECT o_orderkey::VARCHAR AS id, 6 * (1 + o_orderkey % 4) AS h FROM orders),
l AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 10 = 0 THEN 6 ELSE 6 * (1 + o_orderkey % 4) END AS h FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey::VARCHAR, 6 * (1 + o_orderkey % 4) FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'X' || n_nationkey::VARCHAR, 6 FROM nation),
r AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'complete' END AS status FROM orders),
t AS (SELECT l_orderkey::VARCHAR AS id, 6 * l_linenumber AS lead, l_discount - 0.01 AS s FROM lineitem),
d AS (SELECT id, h, list_transform(range(1, h // 6 + 1), lambda k: (6 * k)::INTEGER) AS due FROM e),
g AS (SELECT id, list_sort(list(lead::INTEGER)) AS leads, count(*) FILTER (WHERE NOT (s > 0)) AS bad FROM t GROUP BY id)
SELECT 'cases:missing' AS rule, id AS key, '' AS detail FROM e WHERE id NOT IN (SELECT id FROM l)
UNION ALL SELECT DISTINCT 'cases:extra', id, '' FROM l WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'cases:duplicate', id, '' FROM l GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'cases:forecast_hours', l.id, 'is ' || l.h::VARCHAR || ' not ' || e.h::VARCHAR FROM l JOIN e USING (id) WHERE l.h <> e.h
UNION ALL SELECT 'unfinished', id, 'failed' FROM r WHERE status = 'failed'
UNION ALL SELECT 'leads_differ', d.id, '' FROM d LEFT JOIN g USING (id) WHERE g.leads IS DISTINCT FROM d.due
UNION ALL SELECT 'bad_seconds', d.id, '' FROM d JOIN g USING (id) WHERE g.bad > 0
UNION ALL SELECT 'size_differs', p_partkey::VARCHAR, CASE WHEN p_partkey % 5 = 0 THEN 'absent' ELSE (p_size + 1)::VARCHAR END FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0
UNION ALL SELECT 'partial_file', p_partkey::VARCHAR, '' FROM part WHERE p_partkey % 5 <> 0 AND p_size > 45""")
def k06_run_problems(spark: SparkSession, d: str) -> DataFrame:
    """All findings over a made-up run: orders as cases, lineitem as timings, part as files."""
    o, k = views.table(spark, d, "orders"), F.col("o_orderkey")
    hours = ((k % 4 + 1) * 6).cast("int")
    e = o.select(k.cast("string").alias("case_id"), hours.alias("forecast_hours"))
    extra = views.table(spark, d, "nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("case_id"), F.lit(6).alias("forecast_hours"))
    listed = o.where("o_orderkey % 7 <> 0").select(k.cast("string").alias("case_id"), F.when(k % 10 == 0, 6).otherwise(hours).alias("forecast_hours")).unionByName(o.where("o_orderkey % 11 = 0").select(k.cast("string").alias("case_id"), hours.alias("forecast_hours"))).unionByName(extra)
    results = o.select(k.cast("string").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("complete").alias("status"), F.lit(None).cast("string").alias("error"))
    timings = views.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"), (F.col("l_linenumber") * 6).cast("int").alias("lead_hours"), (F.col("l_discount") - 0.01).alias("seconds"))
    p = F.col("p_partkey")
    due = views.table(spark, d, "part").select(p.cast("string").alias("path"), F.col("p_size").cast("long").alias("length"))
    files = views.table(spark, d, "part").where("p_partkey % 5 <> 0").select(p.cast("string").alias("path"), (F.col("p_size") + F.when(p % 7 == 0, 1).otherwise(0)).cast("long").alias("length"), (F.col("p_size") > 45).alias("partial"))
    return inventory.run_problems(e, {"cases": listed}, results, timings, due, files)


HAND_OVER = """WITH ev AS (SELECT event_id AS k, 'E' || event_id::VARCHAR AS case_id, user_id AS storm_id, ts AS reference_time, CASE WHEN event_id % 3 = 0 THEN 'landfall' ELSE 'closest' END AS reference_event, CASE WHEN event_id % 50 = 0 THEN 'failed' ELSE 'passed' END AS qc_status FROM events WHERE event_type = 'purchase'),
base AS (SELECT *, (k * 7 + h) % 40 AS m, epoch_us(reference_time) - h * 3600000000 AS target FROM ev, (SELECT unnest([24, 48]) AS h)),
shifted AS (SELECT *, target // 21600000000 * 21600000000 + CASE WHEN target % 21600000000 >= 10800000000 THEN 21600000000 ELSE 0 END AS cycle FROM base WHERE m <> 9),
p AS (SELECT CASE WHEN m = 7 THEN 'none' ELSE case_id END AS case_id, case_id || '-L0' || h::VARCHAR || CASE WHEN m = 2 THEN 'x' ELSE '' END AS forecast_case_id, storm_id AS e_storm, reference_event AS e_event, epoch_us(reference_time) AS ref, m,
  storm_id + CASE WHEN m = 0 THEN 1 ELSE 0 END AS storm_id, CASE WHEN m = 1 THEN 'unmatched' ELSE 'matched' END AS status, CASE WHEN m = 12 THEN 30 ELSE h END AS h, cycle + CASE WHEN m = 3 THEN 3600000000 WHEN m = 8 THEN -43200000000 WHEN m = 13 THEN 432000000000 WHEN m = 14 THEN -864000000000 ELSE 0 END AS init,
  target + CASE WHEN m = 4 THEN 3600000000 ELSE 0 END AS target, CASE WHEN m = 10 THEN 'other' ELSE reference_event END AS event, (epoch_us(reference_time) - cycle) / 3600000000e0 + CASE WHEN m = 5 THEN 1 ELSE 0 END AS actual, (cycle - target) / 3600000000e0 + CASE WHEN m = 6 THEN 0.5e0 ELSE 0 END AS away FROM shifted),
plans AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE m = 11)"""


@query(HAND_OVER + """, found AS (SELECT forecast_case_id AS key, unnest(list_filter([CASE WHEN case_id = 'none' THEN 'event_unknown' END, CASE WHEN status <> 'matched' THEN 'not_matched' END, CASE WHEN h NOT IN (24, 48) THEN 'lead_unexpected' END,
  CASE WHEN forecast_case_id <> case_id || '-L0' || h::VARCHAR THEN 'case_id_differs' END, CASE WHEN case_id <> 'none' AND storm_id <> e_storm THEN 'storm_differs' END, CASE WHEN init % 21600000000 <> 0 THEN 'init_off_cycle' END,
  CASE WHEN case_id <> 'none' AND event <> e_event THEN 'reference_differs' END, CASE WHEN target <> ref - h * 3600000000 THEN 'target_differs' END, CASE WHEN abs(actual - (ref - init) / 3600000000e0) > 1e-6 THEN 'actual_lead_differs' END,
  CASE WHEN abs(away - (init - target) / 3600000000e0) > 1e-6 THEN 'offset_differs' END, CASE WHEN abs(init - target) > 10800000000 THEN 'offset_too_large' END, CASE WHEN init >= ref THEN 'starts_after_event' END, CASE WHEN ref - init > 864000000000 THEN 'horizon_too_long' END], lambda r: r IS NOT NULL)) AS rule FROM plans),
g AS (SELECT case_id, h, count(*) AS n FROM plans WHERE h IN (24, 48) GROUP BY ALL)
SELECT rule, key, '' AS detail FROM found
UNION ALL SELECT 'event_not_passed', case_id, qc_status FROM ev WHERE qc_status <> 'passed'
UNION ALL SELECT 'case_repeated', forecast_case_id, count(*)::VARCHAR FROM plans GROUP BY forecast_case_id HAVING count(*) > 1
UNION ALL SELECT 'lead_repeated', case_id || '|' || h::VARCHAR, n::VARCHAR FROM g WHERE n > 1
UNION ALL SELECT 'leads_missing', case_id, string_agg(h::VARCHAR, ',' ORDER BY h) FROM (SELECT case_id, h FROM ev, (SELECT unnest([24, 48]) AS h) EXCEPT SELECT case_id, h FROM g) GROUP BY case_id""")
def c21_k04_handoff_findings(spark: SparkSession, d: str) -> DataFrame:
    """Everything wrong with plans into which faults of each kind are put."""
    return handoff.findings(*_hand_over(spark, d), leads=(24, 48))


@query(HAND_OVER + """, ok AS (SELECT *, ((ref - init + 21599999999) // 21600000000 * 6)::INTEGER AS hours FROM plans WHERE case_id <> 'none' AND init < ref AND ref - init <= 864000000000),
s AS (SELECT count(DISTINCT case_id) AS event_count, count(*) AS case_count, count(DISTINCT init) AS unique_init_time_count FROM ok), c AS (SELECT hours AS forecast_hours, count(*) AS n FROM ok GROUP BY hours) SELECT * FROM s, c""")
def k04_handoff_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the tables of those plans whose event and horizon are known, a row a horizon."""
    events, plans = _hand_over(spark, d)
    ahead = scalar.micros("reference_time") - scalar.micros("init_time")
    plans = plans.where((ahead > 0) & (ahead <= 240 * scalar.HOUR_US))
    n = handoff.counts(handoff.tables(events, plans)[1])
    return n.select("event_count", "case_count", "unique_init_time_count", F.explode("forecast_hours_counts").alias("forecast_hours", "n"))


def _hand_over(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = views.table(spark, d, "events").where("event_type = 'purchase'")
    k, kind = F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "landfall").otherwise("closest")
    events = e.select(k.alias("k"), F.concat(F.lit("E"), k.cast("string")).alias("case_id"), F.col("user_id").alias("storm_id"), F.col("ts").cast("timestamp_ntz").alias("reference_time"), kind.alias("reference_event"), F.when(k % 50 == 0, "failed").otherwise("passed").alias("qc_status"), F.lit("ONE").alias("name"), F.lit("NA").alias("basin"))
    unit, hour, six = F.lit(scalar.HOUR_US), scalar.HOUR_US, 6 * scalar.HOUR_US
    p = events.withColumn("h", F.explode(F.array(F.lit(24), F.lit(48)))).withColumn("m", (F.col("k") * 7 + F.col("h")) % 40).where("m <> 9")
    p = p.withColumn("target", scalar.micros("reference_time") - F.col("h") * unit)
    p = p.withColumn("cycle", F.col("target") - F.col("target") % six + F.when(F.col("target") % six >= 3 * hour, six).otherwise(0))
    fault = lambda n, then, other: F.when(F.col("m") == n, then).otherwise(other)
    at = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")
    init = F.col("cycle") + F.when(F.col("m") == 3, hour).when(F.col("m") == 8, -12 * hour).when(F.col("m") == 13, 120 * hour).when(F.col("m") == 14, -240 * hour).otherwise(0)
    p = p.select(
        "m", fault(7, F.lit("none"), F.col("case_id")).alias("case_id"), F.concat("case_id", F.lit("-L0"), F.col("h").cast("string"), fault(2, F.lit("x"), F.lit(""))).alias("forecast_case_id"), (F.col("storm_id") + fault(0, F.lit(1), F.lit(0))).alias("storm_id"),
        fault(1, F.lit("unmatched"), F.lit("matched")).alias("schedule_status"), fault(12, F.lit(30), F.col("h")).alias("nominal_lead_hours"), at(init).alias("init_time"), "reference_time", fault(10, F.lit("other"), F.col("reference_event")).alias("reference_event"),
        at(F.col("target") + fault(4, F.lit(hour), F.lit(0))).alias("target_init_time"), ((scalar.micros("reference_time") - F.col("cycle")) / unit + fault(5, F.lit(1), F.lit(0))).alias("actual_lead_hours"), ((F.col("cycle") - F.col("target")) / unit + fault(6, F.lit(0.5), F.lit(0.0))).alias("cycle_offset_hours"),
    )
    plans = p.withColumn("_", F.explode(F.when(F.col("m") == 11, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return events.drop("k"), plans.drop("_", "m")
