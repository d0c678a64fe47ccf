"""Forecast cycles: schedules for events, cycles of a period, handoff tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import scalar


def check_parameters(leads: Sequence[int], cycles: Sequence[int]) -> None:
    """Leads positive, cycles hours of the day, both sorted without repeats."""
    if not leads or list(leads) != sorted(set(leads)) or min(leads) <= 0:
        raise ValueError("leads must be positive, sorted and without repeats")
    if not cycles or list(cycles) != sorted(set(cycles)) or not 0 <= min(cycles) <= max(cycles) <= 23:
        raise ValueError("cycles must be hours of the day, sorted and without repeats")


def schedule(events: DataFrame, leads: Sequence[int] = (24, 48, 72, 96, 120), cycles: Sequence[int] = (0, 6, 12, 18), tolerance_hours: float = 3.0) -> DataFrame:
    """One row for each event (case_id, storm_id, reference_time) and lead, with the nearest cycle.

    Of two cycles as near, the earlier one; beyond the tolerance init_time is null and the status
    no_cycle_within_tolerance.
    """
    check_parameters(leads, cycles)
    if tolerance_hours < 0:
        raise ValueError("tolerance must not be negative")
    one = events.withColumn("nominal_lead_hours", F.explode(F.array(*[F.lit(h) for h in leads])))
    one = one.withColumn("target_time", F.timestamp_add("HOUR", -F.col("nominal_lead_hours"), "reference_time")).withColumn("_c", scalar.nearest_cycle("target_time", cycles))
    ok = F.col("_c.off_us") <= int(tolerance_hours * scalar.HOUR_US)
    init = F.when(ok, F.timestamp_micros("_c.cycle_us").cast("timestamp_ntz"))
    one = one.withColumns({"init_time": init, "status": F.when(ok, "planned").otherwise("no_cycle_within_tolerance"), "forecast_case_id": scalar.forecast_case_id("case_id", "nominal_lead_hours")})
    return one.withColumns({"actual_lead_hours": scalar.hours_between("init_time", "reference_time"), "offset_hours": scalar.hours_between("target_time", "init_time")}).drop("_c")


def handoff(plan: DataFrame) -> DataFrame:
    """Rows for the model runs: case id, storm, initialization, horizon in whole steps of six hours."""
    return plan.where("init_time IS NOT NULL").select(F.col("forecast_case_id").alias("case_id"), "storm_id", "init_time", scalar.horizon_hours("init_time", "reference_time").alias("forecast_hours"), F.lit(6).alias("output_interval_hours"))


def cycles_between(spark, start: str, end: str, step_hours: int = 6) -> DataFrame:
    """init_time: every cycle from start to end, both included."""
    times = F.sequence(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end)), F.expr(f"INTERVAL {int(step_hours)} HOURS"))
    return spark.range(1).select(F.explode(times).alias("init_time"))


def cycles_of(times: DataFrame, column: str, step_hours: int = 6) -> DataFrame:
    """init_time: every cycle of the days from the first to the last time of a table; no rows where it has none."""
    day = lambda f: F.date_trunc("day", f(F.col(column).cast("timestamp_ntz"))).cast("timestamp_ntz")
    span = times.agg(day(F.min).alias("a"), day(F.max).alias("b")).where("a IS NOT NULL")
    end = F.timestamp_add("HOUR", F.lit(24 - step_hours), "b")
    return span.select(F.explode(F.sequence("a", end, F.expr(f"INTERVAL {int(step_hours)} HOURS"))).alias("init_time"))


def integral_leads(points: DataFrame, init: str = "init_time", valid: str = "valid_time", lead: str | None = None) -> DataFrame:
    """points with lead_hours from its times; raises where it is no whole hour or disagrees with the column lead."""
    us = scalar.micros(valid) - scalar.micros(init)
    fine = us % scalar.HOUR_US == 0
    if lead:
        fine = fine & (us == F.col(lead) * F.lit(scalar.HOUR_US))
    hours = F.floor(us / F.lit(scalar.HOUR_US)).cast("int")
    return points.withColumn("lead_hours", F.when(fine, hours).otherwise(F.raise_error(F.lit("lead is not a whole hour or disagrees")).cast("int")))
