"""What a finished inference run must hold: its cases, their states, their leads and its files, as findings (rule, key, detail)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.operators import validation

DONE = ("complete", "reused")
#: About as many rows of a table go to a task, so that a task's memory does not grow with a run.
ROWS_A_TASK = 500_000


def spread(key: str, *tables: DataFrame) -> list[DataFrame]:
    """Tables that will meet by a key, dealt by it into as many parts as the largest needs; they are counted for that. Joins and groups by the key follow without a further shuffle."""
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(max(t.count() for t in tables) / ROWS_A_TASK))
    return [t.repartition(parts, key) for t in tables]


def same_ids(expected: DataFrame, listed: DataFrame, source: str, key: str = "case_id") -> DataFrame:
    """Cases that a source lacks, holds twice or holds beyond the plan."""
    d = validation.set_differences(expected.select(key), listed.select(key), key).where("problem <> 'duplicate_left'")
    return d.select(F.concat(F.lit(f"{source}:"), F.when(F.col("problem") == "duplicate_right", "duplicate").otherwise(F.col("problem"))).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))


def same_fields(expected: DataFrame, listed: DataFrame, source: str, fields: Sequence[str], key: str = "case_id") -> DataFrame:
    """Fields of listed cases that differ from the plan's."""
    d = validation.field_differences(listed.select(key, *fields), expected.select(key, *fields), [key], fields)
    return d.select(F.concat(F.lit(f"{source}:"), "field").alias("rule"), F.col(key).cast("string").alias("key"), F.concat_ws(" ", F.lit("is"), F.coalesce("actual", F.lit("null")), F.lit("not"), F.coalesce("expected", F.lit("null"))).alias("detail"))


def unfinished(results: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases whose status is not complete or reused, or that have an error."""
    good = F.col("status").isin(*DONE) & (F.coalesce("error", F.lit("")) == "")
    return validation.check(results, good, [key], "unfinished", F.coalesce("error", "status"))


def wrong_leads(expected: DataFrame, timings: DataFrame, key: str = "case_id", step: int = 6) -> DataFrame:
    """Cases whose timing rows (lead_hours, seconds) are not exactly one for each step up to forecast_hours, or whose times are no positive numbers."""
    bad = ~F.coalesce((F.col("seconds") > 0) & (F.col("seconds") < float("inf")), F.lit(False))
    held = timings.groupBy(key).agg(F.array_sort(F.collect_list("lead_hours")).alias("leads"), F.count_if(bad).alias("bad"))
    both = expected.join(held, key, "left").withColumn("due", F.sequence(F.lit(step), F.greatest(F.col("forecast_hours").cast("int"), F.lit(step)), F.lit(step)))
    differ = validation.check(both, F.col("leads") == F.col("due").cast("array<int>"), [key], "leads_differ")
    return validation.violations(differ, validation.check(both.where("leads IS NOT NULL"), F.col("bad") == 0, [key], "bad_seconds"))


def wrong_files(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are absent or of another size than listed (path, length), and partial ones (sources.tables.inventory())."""
    both = listed.select("path", F.col("length").alias("due")).join(found.select("path", "length"), "path", "left")
    sizes = validation.check(both, F.col("due").eqNullSafe(F.col("length")), ["path"], "size_differs", F.coalesce(F.col("length").cast("string"), F.lit("absent")))
    return validation.violations(sizes, validation.check(found, ~F.col("partial"), ["path"], "partial_file"))


def run_problems(expected: DataFrame, listed: dict[str, DataFrame], results: DataFrame, timings: DataFrame, listed_files: DataFrame, files: DataFrame, fields: Sequence[str] = ("forecast_hours",)) -> DataFrame:
    """All findings of a run. expected: case_id, forecast_hours and fields; listed: the case tables that must equal it, by name."""
    e, r, t, *dealt = spread("case_id", expected, results.select("case_id"), timings, *listed.values())
    tables = [f for name, df in zip(listed, dealt, strict=True) for f in (same_ids(e, df, name), same_fields(e, df, name, fields))]
    return validation.violations(*tables, same_ids(e, r, "results"), unfinished(results), wrong_leads(e, t), wrong_files(*spread("path", listed_files, files)))
