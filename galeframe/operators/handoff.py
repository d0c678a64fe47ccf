"""What is handed to the runs of models: its checks, its two tables, its counts.

events: case_id, storm_id, reference_time, reference_event, qc_status, name, basin. plans:
forecast_case_id, case_id, storm_id, schedule_status, nominal_lead_hours, init_time, reference_time,
reference_event, target_init_time, actual_lead_hours, cycle_offset_hours, and where they exist the
reference's latitude and longitude. Times are UTC.

All rules that look at one plan are judged in one pass over plans joined to their events; rules
about a whole table are sums before the shuffle, so that an event with very many plans is no hot
group. A null in a column that a rule looks at breaks the rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import scalar
from galeframe.operators import validation

LEADS = (24, 48, 72, 96, 120)


def plan_rules(leads: Sequence[int] = LEADS, step: int = 6, most: int = 240, tolerance_hours: float = 3.0) -> dict[str, Column]:
    """What must hold of a plan and the event it names (columns _e_...), by the name of the finding."""
    us = lambda a, b: scalar.micros(b) - scalar.micros(a)
    hour = F.lit(scalar.HOUR_US)
    ahead = us("init_time", "reference_time")
    near = lambda column, value: F.abs(F.col(column).cast("double") - value) <= 1e-6
    return {
        "event_unknown": F.col("_known"),
        "not_matched": F.col("schedule_status") == "matched",
        "lead_unexpected": F.col("nominal_lead_hours").isin(*leads),
        "case_id_differs": F.col("forecast_case_id") == scalar.forecast_case_id("case_id", "nominal_lead_hours"),
        "storm_differs": ~F.col("_known") | (F.col("storm_id") == F.col("_e_storm_id")),
        "init_off_cycle": F.pmod(scalar.micros("init_time"), step * hour) == 0,
        "reference_differs": ~F.col("_known") | ((F.col("reference_time") == F.col("_e_reference_time")) & (F.col("reference_event") == F.col("_e_reference_event"))),
        "target_differs": us("target_init_time", "reference_time") == F.col("nominal_lead_hours").cast("long") * hour,
        "actual_lead_differs": near("actual_lead_hours", ahead / hour),
        "offset_differs": near("cycle_offset_hours", us("target_init_time", "init_time") / hour),
        "offset_too_large": F.abs(us("target_init_time", "init_time")) <= F.lit(int(tolerance_hours * scalar.HOUR_US)),
        "starts_after_event": ahead > 0,
        "horizon_too_long": F.ceil(ahead / (step * hour)) * step <= most,
    }


def findings(events: DataFrame, plans: DataFrame, leads: Sequence[int] = LEADS, step: int = 6, most: int = 240, tolerance_hours: float = 3.0, event_count: int | None = None, plan_count: int | None = None) -> DataFrame:
    """rule, key, detail of everything that is wrong, no rows if nothing is.

    Beside the rules of a plan: ids given more than once (event_repeated, case_repeated), events
    that did not pass (event_not_passed), a lead planned twice (lead_repeated, its number of rows) or
    not at all (leads_missing, which), and numbers of rows other than expected (event_count,
    plan_count; not judged by default). Plans of a repeated event are compared with one of its rows.
    """
    compared = ("storm_id", "reference_time", "reference_event")
    one = events.where("case_id IS NOT NULL").groupBy("case_id").agg(F.min(F.struct(*compared)).alias("e")).select("case_id", F.lit(True).alias("_k"), *[F.col(f"e.{c}").alias(f"_e_{c}") for c in compared])
    both = plans.join(one, "case_id", "left").withColumn("_known", F.col("_k").isNotNull())
    rules = plan_rules(leads, step, most, tolerance_hours)
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    each = both.select(F.explode(failed).alias("rule"), F.coalesce("forecast_case_id", F.lit("NULL")).alias("key"), F.lit("").alias("detail"))
    planned = plans.where(F.col("nominal_lead_hours").isin(*leads)).groupBy("case_id", F.col("nominal_lead_hours").cast("int").alias("lead")).agg(F.count("*").alias("n"))
    held = planned.groupBy("case_id").agg(F.sort_array(F.collect_set("lead")).alias("held"))
    due = events.select("case_id").distinct().join(held, "case_id", "left")
    due = due.withColumn("missing", F.array_except(F.array(*[F.lit(int(h)) for h in leads]), F.coalesce("held", F.array().cast("array<int>"))))
    found = [
        each,
        validation.unique_key(events, ["case_id"], "event_repeated"),
        validation.check(events, F.col("qc_status") == "passed", ["case_id"], "event_not_passed", F.coalesce("qc_status", F.lit(""))),
        validation.unique_key(plans, ["forecast_case_id"], "case_repeated"),
        validation.check(planned, F.col("n") == 1, ["case_id", "lead"], "lead_repeated", F.col("n")),
        validation.check(due, F.size("missing") == 0, ["case_id"], "leads_missing", F.array_join("missing", ",")),
    ]
    for rule, df, want in (("event_count", events, event_count), ("plan_count", plans, plan_count)):
        if want is not None:
            n = df.agg(F.count("*").alias("n"))
            found.append(validation.check(n, F.col("n") == want, [], rule, F.col("n")))
    return validation.violations(*found)


def tables(events: DataFrame, plans: DataFrame, step: int = 6, most: int = 240) -> tuple[DataFrame, DataFrame]:
    """(cases, index): a run's row and what it is for, one row a plan; nothing is checked but that horizons are in (0, most]."""
    about = events.select("case_id", "name", "basin")
    hours = scalar.horizon_hours("init_time", "reference_time", step, most)
    p = plans.join(about, "case_id").withColumn("forecast_hours", hours)
    cases = p.select(F.col("forecast_case_id").alias("case_id"), "storm_id", "init_time", "forecast_hours", F.lit(step).alias("output_interval_hours"), "name", "basin")
    place = [F.col(c) if c in plans.columns else F.lit(None).cast("double").alias(c) for c in ("reference_latitude", "reference_longitude")]
    index = p.select(
        "forecast_case_id", F.col("case_id").alias("event_case_id"), "storm_id", "reference_event", "reference_time", *place, "nominal_lead_hours", "target_init_time", "actual_lead_hours", "cycle_offset_hours", "init_time", "forecast_hours",
        F.timestamp_add("HOUR", F.col("forecast_hours"), "init_time").alias("forecast_end_time"),
    )
    return cases, index


def counts(index: DataFrame) -> DataFrame:
    """One row: event_count, case_count, unique_init_time_count, forecast_hours_counts (cases by horizon, a map in rising order). An empty index counts zero."""
    # horizons are few, at most most / step
    by = index.groupBy("forecast_hours").agg(F.count("*").alias("n"))
    spread = by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("forecast_hours", "n")))).alias("forecast_hours_counts"))
    return index.agg(F.countDistinct("event_case_id").alias("event_count"), F.count("*").alias("case_count"), F.countDistinct("init_time").alias("unique_init_time_count")).withColumn("forecast_hours_counts", spread.scalar())


def build(events: DataFrame, plans: DataFrame, **expected) -> tuple[DataFrame, DataFrame]:
    """The tables of a hand-over without findings; raises naming the first ones. expected: as of `findings`."""
    validation.require(findings(events, plans, **expected))
    return tables(events, plans, expected.get("step", 6), expected.get("most", 240))
