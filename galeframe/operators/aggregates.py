"""Grouped summaries: episodes, storms, coverage, statuses, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import scalar
from galeframe.operators.joins import in_interval


def lifetime_peak(fixes: DataFrame, at_least: float, key: str = "storm_id", wind: str = "wind_kt") -> DataFrame:
    """fixes of storms whose largest wind is at_least, with lifetime_vmax; an aggregate and a semi-join's worth of shuffle."""
    peak = fixes.groupBy(key).agg(F.max(scalar.finite(wind)).alias("lifetime_vmax")).where(F.col("lifetime_vmax") >= at_least)
    return fixes.join(peak, key)


def within_period(fixes: DataFrame, start: Column, end: Column, padding_hours: float, key: str = "storm_id", time: str = "iso_time") -> DataFrame:
    """fixes of storms whose span meets [start, end], padded."""
    pad = int(padding_hours * scalar.HOUR_US)
    span = fixes.groupBy(key).agg(F.min(scalar.micros(time)).alias("_lo"), F.max(scalar.micros(time)).alias("_hi"))
    span = span.where((F.col("_hi") >= scalar.micros(start) - pad) & (F.col("_lo") <= scalar.micros(end) + pad))
    return fixes.join(span.select(key), key, "left_semi")


def coverage_fraction(columns: Sequence[str]) -> Column:
    """Share of rows with any of columns known: an aggregate."""
    return F.avg(F.coalesce(*[F.col(c) for c in columns]).isNotNull().cast("double"))


def episodes(contacts: DataFrame, dense: DataFrame, padding_hours: float = 6.0, strong_kt: float = 64.0, crossings: DataFrame | None = None, period: tuple[Column, Column] | None = None) -> DataFrame:
    """Coastal-contact episodes, one row each.

    contacts: storm_id, iso_time, fix_id, episode_group, distance_km, wind_kt and the flags r34, r50,
    r64, proxy, landfall; dense: all rows of the track with storm_id, iso_time, fix_id, wind_kt and
    r34_any. Times, closest approach and flags come from contact rows, peak wind and coverage from
    the span padded by padding_hours; only episodes whose padded peak reaches strong_kt stay, and
    these are numbered in time order. crossings (storm_id, crossing_time, crossing_type, wind_kt) add
    numbers of landfalls, exits and tangents within the padded span; the first landfall is the reference
    time. With a period only
    episodes whose reference time lies in it are kept, and numbered.
    """
    flag = lambda c: F.bool_or(F.coalesce(F.col(c), F.lit(False)))
    spans = contacts.groupBy("storm_id", "episode_group").agg(
        F.min("iso_time").alias("episode_start"), F.max("iso_time").alias("episode_end"), F.count("*").cast("long").alias("contact_rows"),
        F.min(F.struct("distance_km", "iso_time", "fix_id", "wind_kt")).alias("closest"),
        flag("r34").alias("r34_contact"), flag("r50").alias("r50_contact"), flag("r64").alias("r64_contact"), flag("proxy").alias("proxy_contact"), flag("landfall").alias("landfall_contact"),
    )
    key = ["storm_id", "episode_group"]
    near = spans.select(*key, "episode_start", "episode_end")
    inside = in_interval(dense.select("storm_id", "iso_time", "wind_kt", "r34_any"), near, "storm_id", "iso_time", "episode_start", "episode_end", padding_hours)
    window = inside.groupBy(*key).agg(
        F.max("wind_kt").alias("episode_vmax_kt"), coverage_fraction(["wind_kt"]).alias("wind_coverage"), F.avg(F.coalesce("r34_any", F.lit(False)).cast("double")).alias("r34_coverage"),
    )
    out = spans.join(window, key).where(F.col("episode_vmax_kt") >= strong_kt)
    if crossings is None:
        none = F.lit(0).cast("long")
        out = out.withColumns({"landfall_time": F.lit(None).cast("timestamp_ntz"), "landfall_count": none, "exit_count": none, "tangent_count": none, "landfall_vmax_kt": F.lit(None).cast("double")})
    else:
        hit = in_interval(crossings.select("storm_id", "crossing_time", "crossing_type", "wind_kt"), near, "storm_id", "crossing_time", "episode_start", "episode_end", padding_hours)
        ashore = F.col("crossing_type") == "landfall"
        hit = hit.groupBy(*key).agg(
            F.min(F.when(ashore, F.col("crossing_time"))).alias("landfall_time"), F.max(F.when(ashore, F.col("wind_kt"))).alias("landfall_vmax_kt"),
            *[F.count_if(F.col("crossing_type") == kind).cast("long").alias(f"{kind}_count") for kind in ("landfall", "exit", "tangent")],
        )
        out = out.join(hit, key, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("landfall_count", "exit_count", "tangent_count")})
    out = out.withColumn("reference_time", F.coalesce("landfall_time", "closest.iso_time"))
    if period:
        out = out.where(F.col("reference_time").between(*period))
    w = Window.partitionBy("storm_id").orderBy("episode_start", "episode_group")
    ordinal = F.row_number().over(w)
    methods = F.concat_ws("+", F.when(F.col("landfall_contact"), "landfall_crossing"), F.when(F.col("r34_contact"), "wind_radius"), F.when(F.col("proxy_contact"), "distance_proxy"))
    return out.select(
        "storm_id", scalar.case_id("storm_id", ordinal).alias("case_id"), ordinal.alias("episode_index"), "episode_start", "episode_end", "contact_rows",
        F.col("closest.iso_time").alias("closest_time"), F.col("closest.distance_km").alias("closest_km"), F.col("closest.wind_kt").alias("closest_wind_kt"),
        "reference_time", F.col("closest.fix_id").alias("closest_id"), F.when(F.col("landfall_count") > 0, "landfall").otherwise("coastal_approach").alias("reference_event"),
        "landfall_count", "exit_count", "tangent_count", "landfall_vmax_kt", "episode_vmax_kt", "wind_coverage", "r34_coverage", "r34_contact", "r50_contact", "r64_contact",
        scalar.hours_between("episode_start", "episode_end").alias("span_hours"), methods.alias("selection_method"),
        scalar.tier(F.col("r64_contact"), F.col("r50_contact"), F.col("r34_contact"), F.col("landfall_contact"), F.col("landfall_vmax_kt"), strong_kt).alias("tier"),
    )


def storm_rollup(cases: DataFrame) -> DataFrame:
    """One row a storm: best tier, cases, peak wind, span, basins in order."""
    return cases.groupBy("storm_id").agg(F.min("tier").alias("best_tier"), F.count("*").cast("long").alias("cases"), F.max("episode_vmax_kt").alias("peak_kt"), F.min("episode_start").alias("first_contact"), F.max("episode_end").alias("last_contact"), F.sum("landfall_count").cast("long").alias("landfalls"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value (text, null included), count."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))


def catalog_summary(cases: DataFrame) -> DataFrame:
    """One row: numbers of cases and storms, landfalls, medians; zeros for no cases."""
    return cases.agg(F.count("*").alias("cases"), F.countDistinct("storm_id").alias("storms"), F.count_if(F.col("reference_event") == "landfall").alias("landfall_cases"), F.count_if(F.col("tier").isin("A", "B")).alias("primary_cases"), F.median("episode_vmax_kt").alias("median_vmax"), F.median("span_hours").alias("median_span"))


def source_quality(fixes: DataFrame, key: Sequence[str], wind: str, radii: Sequence[str]) -> DataFrame:
    """One row: rows, storms, time range, missing shares, rows that repeat a key."""
    first, time = key[0], key[1]
    per = fixes.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col(wind).isNull().cast("long")).alias("no_wind"), F.sum(F.coalesce(*[F.col(r) for r in radii]).isNotNull().cast("long")).alias("some"))
    return per.agg(
        F.sum("n").cast("long").alias("rows"), F.countDistinct(first).alias("storms"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        (F.sum("no_wind") / F.sum("n")).alias("wind_missing"), (F.sum("some") / F.sum("n")).alias("any_radius"), F.sum(F.col("n") - 1).cast("long").alias("duplicates"),
    )


def coverage_by_year(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Eight measures of events and six of cases by the year of the reference time; all planned means some planned and all available."""
    y = F.year("reference_time").alias("year")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    e = events.groupBy(y).agg(
        F.count("*").alias("total_events"), F.countDistinct("storm_id").alias("total_storms"), F.countDistinct(F.when(F.col("storm_has_forecast"), F.col("storm_id"))).alias("storms_with_forecast"),
        n(F.col("storm_has_forecast")).alias("events_with_storm_forecast"), n(F.col("event_time_covered")).alias("events_with_reference_coverage"), n(F.col("available_case_count") > 0).alias("events_with_any_available_case"),
        n((F.col("planned_case_count") > 0) & (F.col("available_case_count") == F.col("planned_case_count"))).alias("events_with_all_planned_cases"),
    )
    return e.join(cases.groupBy(y).agg(*_case_measures()), "year", "left")


def _case_measures() -> list[Column]:
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return [F.count("*").alias("total_cases"), n("strict_init_present").alias("strict_init_present_cases"), n("forecast_available").alias("available_cases"), n("forecast_wind_available").alias("wind_available_cases"), n("forecast_pressure_available").alias("pressure_available_cases"), F.avg(F.coalesce("forecast_available", F.lit(False)).cast("double")).alias("available_case_fraction")]


def coverage_by_lead(cases: DataFrame) -> DataFrame:
    """Case measures and distinct available events and storms by nominal lead."""
    there = F.coalesce("forecast_available", F.lit(False))
    return cases.groupBy("nominal_lead_hours").agg(F.countDistinct(F.when(there, F.col("case_id"))).alias("available_events"), F.countDistinct(F.when(there, F.col("storm_id"))).alias("available_storms"), *_case_measures())


def status_summary(points: DataFrame, group: str, status: str) -> DataFrame:
    """group, status, count, fraction within the group; group null is the overall count: one pass over grouping sets."""
    cube = points.groupingSets([[F.col(group), F.col(status)], [F.col(status)]], group, status).agg(F.count("*").alias("count"), F.grouping(group).alias("overall"))
    total = F.sum("count").over(Window.partitionBy("overall", group))
    return cube.select(group, status, "overall", "count", (F.col("count") / total).alias("fraction"))


def fewest_within(df: DataFrame, workers: str, value: str, share: float = 0.05) -> DataFrame:
    """workers, median, chosen: medians of value; chosen is the fewest workers within share of the fastest."""
    m = df.groupBy(workers).agg(F.median(value).alias("median"))
    everything = Window.partitionBy(F.lit(1))
    best = F.min("median").over(everything)
    m = m.withColumn("_close", F.col("median") <= best * (1 + share))
    return m.withColumn("chosen", F.col(workers) == F.min(F.when(F.col("_close"), F.col(workers))).over(everything)).drop("_close")


def payload_stats(df: DataFrame, value: str) -> Sequence[Column]:
    """Values, masked, non-finite, least and largest finite value: aggregates."""
    v = scalar.finite(value)
    return [F.count("*").alias("values"), F.count_if(F.col(value).isNull()).alias("masked"), F.count_if(F.col(value).isNotNull() & v.isNull()).alias("nonfinite"), F.min(v).alias("least"), F.max(v).alias("largest")]


def failure_counts(df: DataFrame, column: str, mark: str = ";") -> DataFrame:
    """failure, count over a column of joined names."""
    each = df.where(F.col(column) != "").select(F.explode(F.split(column, mark)).alias("failure"))
    return each.groupBy("failure").agg(F.count("*").alias("count"))
