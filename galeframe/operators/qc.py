"""Named checks of the catalog's events and of handoff tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import scalar
from galeframe.operators.validation import named_failures, notes


def event_rules(strong_kt: float = 64.0) -> dict[str, Column]:
    """What must hold for an episode, by the name of its failure."""
    between = lambda x, lo, hi: F.col(x).between(lo, hi)
    return {
        "case_id_malformed": F.col("case_id").rlike(r"^.+-CE\d{2,}$"),
        "case_id_of_other_storm": F.col("case_id").startswith(F.concat(F.col("storm_id").cast("string"), F.lit("-CE"))),
        "episode_ends_before_start": F.col("episode_end") >= F.col("episode_start"),
        "span_disagrees": F.abs(F.col("span_hours") - scalar.hours_between("episode_start", "episode_end")) < 1e-6,
        "closest_outside_episode": F.col("closest_time").between(F.col("episode_start"), F.col("episode_end")),
        "distance_negative": F.col("closest_km") >= 0,
        "peak_below_threshold": F.col("episode_vmax_kt") >= strong_kt,
        "peak_below_closest": F.col("closest_wind_kt").isNull() | (F.col("episode_vmax_kt") >= F.col("closest_wind_kt")),
        "wind_coverage_out_of_range": between("wind_coverage", 0.0, 1.0),
        "radius_coverage_out_of_range": between("r34_coverage", 0.0, 1.0),
        "tier_unknown": F.col("tier").isin("A", "B", "C", "D"),
        "tier_disagrees_with_contact": F.when(F.col("r64_contact"), F.col("tier") == "A").when(F.col("r50_contact"), F.col("tier").isin("A", "B")).otherwise(F.lit(True)),
        "event_kind_disagrees": (F.col("reference_event") == "landfall") == (F.col("landfall_count") > 0),
        "approach_time_disagrees": (F.col("reference_event") == "landfall") | (F.col("reference_time") == F.col("closest_time")),
        "landfall_wind_without_landfall": (F.col("landfall_count") > 0) | F.col("landfall_vmax_kt").isNull(),
        "method_missing": F.col("selection_method") != "",
        "ordinal_not_positive": F.col("episode_index") >= 1,
    }


def event_checks(cases: DataFrame, strong_kt: float = 64.0) -> DataFrame:
    """case_id, failures, notes, passed: one row an event; ordinals must be gapless and ids unique over the table."""
    by_storm, by_case = Window.partitionBy("storm_id"), Window.partitionBy("case_id")
    c = cases.withColumns({"_most": F.max("episode_index").over(by_storm), "_all": F.count("*").over(by_storm), "_same": F.count("*").over(by_case)})
    rules = event_rules(strong_kt) | {"ordinals_have_gaps": F.col("_most") == F.col("_all"), "case_id_repeated": F.col("_same") == 1}
    noted = {"many_episodes": F.col("_all") > 5, "incomplete_wind": F.col("wind_coverage") < 1, "incomplete_radii": F.col("r34_coverage") < 1, "proxy_only": F.col("selection_method") == "distance_proxy", "single_fix": F.col("contact_rows") == 1, "several_landfalls": F.col("landfall_count") > 1}
    failed = named_failures(rules)
    return c.select("case_id", failed.alias("failures"), notes(noted).alias("notes"), (failed == "").alias("passed"))


def handoff_checks(plan: DataFrame, step: int = 6, most: int = 240) -> DataFrame:
    """case_id, failures of handoff rows (init_time, reference_time, forecast_hours)."""
    h = F.col("forecast_hours")
    failed = {"horizon_out_of_range": (h > 0) & (h <= most), "horizon_not_in_steps": h % step == 0, "starts_after_event": F.col("init_time") <= F.col("reference_time")}
    ordered = F.concat_ws(";", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in failed.items()])
    return plan.select("case_id", ordered.alias("failures"))
