"""Roll-ups of a catalog of cases and of its sources, with every measure a manifest holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import scalar

COUNTED = ("tier", "reference_event", "basin", "selection_method")


def counts_by_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column a map <column>_counts from its values, as text, to their numbers, in order of values; nulls count as nan.

    All columns are counted in one pass, with partial sums, and only the counts meet in one task.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v")) for c in columns]))
    held = df.select(each.alias("e")).groupBy("e.c", "e.v").agg(F.count("*").alias("n"))
    entries = lambda c: F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("v", "n"))))
    return held.agg(*[F.map_from_entries(entries(c)).alias(f"{c}_counts") for c in columns])


def catalog_measures(cases: DataFrame, points: DataFrame) -> DataFrame:
    """One row of twenty measures: cases, storms, primary, provisional, landfall, sea-only and exit cases and how these overlap, counts of tiers, reference events, basins and methods, points, medians.

    cases: storm_id, tier, primary_sample, provisional_track, landfall_count, exit_count,
    reference_event, basin, selection_method, minimum_coast_distance_km, r34_coverage. No cases give
    zeros, empty maps and null medians.
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    primary, provisional = no("primary_sample"), no("provisional_track")
    landfall, leaves = F.coalesce(F.col("landfall_count") > 0, F.lit(False)), F.coalesce(F.col("exit_count") > 0, F.lit(False))
    n = lambda c, name: F.count_if(c).alias(name)
    one = cases.agg(
        F.count("*").alias("case_count"), n(primary, "primary_case_count"), F.countDistinct("storm_id").alias("storm_count"), F.countDistinct(F.when(primary, F.col("storm_id"))).alias("primary_storm_count"),
        n(provisional, "provisional_case_count"), n(provisional & primary, "provisional_primary_case_count"), n(~provisional, "final_main_case_count"), n(~provisional & primary, "final_main_primary_case_count"),
        n(landfall, "landfall_case_count"), n(~landfall, "sea_only_case_count"), n(leaves, "exit_associated_case_count"), n(primary & landfall, "primary_landfall_case_count"), n(primary & ~landfall, "primary_sea_only_case_count"),
        F.median("minimum_coast_distance_km").alias("median_minimum_coast_distance_km"), F.median("r34_coverage").alias("median_r34_coverage_fraction"),
    )
    rows = [one, counts_by_value(cases, COUNTED), points.agg(F.count("*").alias("dense_track_point_count"))]
    return reduce(lambda a, b: a.join(b), rows)  # three tables of one row


def storm_catalog(cases: DataFrame) -> DataFrame:
    """One row a storm, by first contact and id: name of its first case, basins, numbers of cases, best tier, contact span, least distance, peak winds, crossing flags."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    primary = no("primary_sample")
    out = cases.groupBy("storm_id").agg(
        F.min(F.struct("episode_start", "case_id", "name"))["name"].alias("name"), scalar.sorted_join("basin").alias("basins"), F.count("*").alias("episode_count"), F.count_if(primary).alias("primary_episode_count"),
        F.min("tier").alias("highest_tier"), F.bool_or(primary).alias("primary_sample"), F.min("episode_start").alias("first_coastal_contact"), F.max("episode_end").alias("last_coastal_contact"),
        F.min("minimum_coast_distance_km").alias("minimum_coast_distance_km"), F.max("lifetime_vmax_kt").alias("lifetime_vmax_kt"), F.max("episode_vmax_kt").alias("maximum_coastal_episode_vmax_kt"),
        F.bool_or(F.coalesce(F.col("landfall_count") > 0, F.lit(False))).alias("any_coastline_crossing"), F.bool_or(F.coalesce(F.col("exit_count") > 0, F.lit(False))).alias("any_coastline_exit"), F.bool_or(no("provisional_track")).alias("provisional_track"),
    )
    return out.withColumn("qc_status", F.lit("pending")).orderBy("first_coastal_contact", "storm_id")


def source_measures(fixes: DataFrame, storm: str, time: str, wind: str, position: tuple[str, str], radii: Sequence[str], kind: str) -> DataFrame:
    """One row: rows, storms, first and last time, rows by track type, shares without wind, without position and with any radius, rows that repeat a storm and time."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    lacking: Column = F.col(position[0]).isNull() | F.col(position[1]).isNull()
    one = fixes.agg(
        F.count("*").alias("row_count"), F.countDistinct(storm).alias("storm_count"), F.min(time).alias("time_start"), F.max(time).alias("time_end"), share(F.col(wind).isNull()).alias("wind_missing_fraction"),
        share(lacking).alias("position_missing_fraction"), share(F.coalesce(*[F.col(r) for r in radii]).isNotNull()).alias("any_wind_radius_fraction"),
    )
    twice = fixes.groupBy(storm, time).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_storm_time_count"))
    kinds = counts_by_value(fixes, [kind]).withColumnRenamed(f"{kind}_counts", "track_type_rows")
    return one.join(kinds).join(twice)


def as_text(counts: Column) -> Column:
    """A map of counts as text: value:count, in order, with commas."""
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
