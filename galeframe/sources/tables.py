"""Case, forecast and run tables; file inventories; sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from galeframe.functions import scalar
from galeframe.operators.validation import IntegrityError, check, non_empty, require, require_columns, unique_key

#: Column orders of the tracker's two tables.
TRACK_COLUMNS = ("model", "forecast_case_id", "lead_hours", "latitude", "longitude", "msl_hpa", "vmax10_ms", "cyclonic_vorticity_s", "status", "reason")
CASE_COLUMNS = ("model", "forecast_case_id", "planned_points", "ok_points", "last_ok_lead", "case_status", "case_reason")
MODEL_ALIASES = {"pangu_weather": "pangu"}


def read_cases(spark: SparkSession, path: str, only: Sequence[str] | None = None) -> DataFrame:
    """Forecast cases: unique ids that end in -L###, horizons in whole steps of six hours; only picks ids, unknown ones raise."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    raw = raw.toDF(*[c.removeprefix("﻿") for c in raw.columns])
    require_columns(raw, ["case_id", "storm_id", "init_time", "forecast_hours"])
    step = F.expr("try_cast(output_interval_hours AS INT)") if "output_interval_hours" in raw.columns else F.lit(None).cast("int")
    cases = raw.select(F.col("case_id").alias("forecast_case_id"), "storm_id", F.try_to_timestamp("init_time").cast("timestamp_ntz").alias("init_time"), F.expr("try_cast(forecast_hours AS INT)").alias("forecast_hours"), step.alias("output_interval_hours"))
    cases = cases.withColumn("case_id", scalar.split_case_id("forecast_case_id")["case_id"])
    key = ["forecast_case_id"]
    require(
        non_empty(cases), unique_key(cases, key), check(cases, F.col("case_id").isNotNull() & ~F.col("forecast_case_id").rlike(r"[/\\]"), key, "malformed_case_id"), check(cases, F.col("init_time").isNotNull(), key, "bad_init_time"),
        check(cases, (F.col("forecast_hours") > 0) & (F.col("forecast_hours") % 6 == 0), key, "bad_horizon"), check(cases, F.coalesce(F.col("output_interval_hours") == 6, F.lit(True)), key, "bad_interval"),
    )
    if only is not None:
        wanted = spark.createDataFrame([(x,) for x in only], "forecast_case_id string")
        lost = wanted.join(cases, key, "left_anti").limit(5).collect()
        if lost:
            raise IntegrityError(f"unknown cases: {', '.join(r[0] for r in lost)}")
        cases = cases.join(wanted.distinct(), key, "left_semi")
    return cases.orderBy("forecast_case_id")


def read_forecasts(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Forecast CSVs with # comments and their file's name; absent files give no rows, columns that one lacks are null."""
    out = spark.createDataFrame([], schema).withColumn("source_path", F.lit(None).cast("string"))
    for p in paths:
        try:
            one = spark.read.option("header", True).option("comment", "#").csv(p)
        except AnalysisException:
            continue
        one = one.select("*", F.col("_metadata.file_path").alias("source_path"))
        typed = one.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in out.schema if f.name in one.columns])
        out = out.unionByName(typed, allowMissingColumns=True)
    return out


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """model, path of the folders under root that hold a job.json; two of one model raise."""
    jobs = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "job.json").json(root)
    require_columns(jobs, ["model"])
    alias = F.create_map(*[F.lit(x) for kv in MODEL_ALIASES.items() for x in kv])
    runs = jobs.select(F.coalesce(alias[F.col("model")], F.col("model")).alias("model"), F.regexp_replace(F.col("_metadata.file_path"), r"/job\.json$", "").alias("path"))
    require(non_empty(runs), unique_key(runs, ["model"], "duplicate_model"))
    return runs


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified, partial of every file under root; contents are not read.

    Spark's file source leaves out files without a byte: these show as missing in size_differences().
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.withColumn("partial", F.col("path").rlike(r"\.(part|tmp)$"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """path and SHA-256 of every file under root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha256"))


def size_differences(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path, listed, found of files that lack or have another size than listed (path, length)."""
    both = listed.select("path", F.col("length").alias("listed")).join(found.select("path", F.col("length").alias("found")), "path", "left")
    return both.where(~F.col("listed").eqNullSafe(F.col("found")))


def catalog_views(cases: DataFrame) -> dict[str, DataFrame]:
    """The tables that a catalog build writes: all, primary tiers, main tracks, both, by storm."""
    from galeframe.operators.aggregates import storm_rollup

    primary = F.col("tier").isin("A", "B")
    main = ~F.coalesce(F.col("provisional_track"), F.lit(False)) if "provisional_track" in cases.columns else F.lit(True)
    return {"all": cases, "primary": cases.where(primary), "main": cases.where(main), "main_primary": cases.where(primary & main), "storms": storm_rollup(cases), "primary_storms": storm_rollup(cases.where(primary))}


def write_catalog(cases: DataFrame, path: str) -> None:
    """Each view as a folder of CSV under path, which must not exist."""
    for name, df in catalog_views(cases).items():
        df.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")


def write_by_year(df: DataFrame, path: str, time: str = "init_time") -> None:
    """Gzipped CSV, one folder a year."""
    df.withColumn("year", F.year(time)).repartition("year").write.partitionBy("year").option("header", True).option("compression", "gzip").csv(path)


def write_ordered(df: DataFrame, columns: Sequence[str], path: str, decimals: int | None = None) -> None:
    """CSV of fixed columns in their order, others left out, doubles with a number of decimals; an unfinished write leaves nothing."""
    kinds = dict(df.dtypes)
    shown = [F.format_string(f"%.{decimals}f", c).alias(c) if decimals is not None and kinds[c] == "double" else F.col(c) for c in columns]
    df.select(*shown).write.option("header", True).csv(path)


def write_details(df: DataFrame, path: str) -> None:
    """One JSON object a line; NaN and infinities become null."""
    clean = [scalar.finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.option("ignoreNullFields", False).json(path)
