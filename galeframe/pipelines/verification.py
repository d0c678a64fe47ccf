"""Ensemble forecasts against best tracks: errors of the mean, scores of complete ensembles, intervals by resampling storms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import ensemble, joins, validation
from galeframe.operators.lineage import merged

KEY = ("init_time", "track_id", "lead_hours")


def _scores(cases: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """KEY with member_count, and CRPS, Brier score and energy score where the ensemble is complete and all its values are there."""
    m = members.join(merged(cases.where("track_id IS NOT NULL").select(*KEY, "truth_lat", "truth_lon", "truth_wind_kt")), list(KEY)).withColumnRenamed("sample", "member")
    count = m.groupBy(*KEY).agg(F.count("*").alias("member_count"))
    whole = lambda values: m.join(merged(ensemble.complete(m, KEY, size, values).where("complete").select(*KEY)), list(KEY), "left_semi")
    wind = whole(["wind_kt"]).where(scalar.finite("truth_wind_kt").isNotNull())
    crps = ensemble.crps(wind, KEY, "wind_kt", "truth_wind_kt").withColumnRenamed("crps", "vmax_crps_kt")
    brier = ensemble.brier(wind, KEY, 64.0, "wind_kt", "truth_wind_kt").withColumnRenamed("brier", "vmax_brier_64")
    energy = ensemble.energy_score(whole(["lat", "lon"]), KEY).withColumnRenamed("energy", "track_energy_score_km")
    for one in (crps, brier, energy):
        count = count.join(merged(one), list(KEY), "left")
    return count


def verification_cases(means: DataFrame, members: DataFrame, truth: DataFrame, leads: Sequence[int], size: int = 50) -> DataFrame:
    """One row for each storm, initialization and lead at which it is observed at both ends.

    means: init_time, track_id, lead_hours, lat, lon, wind_kt, pressure_hpa; members: the same with
    sample; truth: truth_id, storm_id, basin, iso_time, lat, lon, wind_kt, pressure_hpa. Forecast and
    observed storms are linked by position at lead 0; without a forecast the errors are null.
    """
    validation.require(validation.unique_key(means, KEY, "duplicate_mean"), validation.unique_key(members, [*KEY, "sample"], "duplicate_member"), validation.unique_key(truth, ["truth_id", "iso_time"], "duplicate_truth"))
    due = joins.lead_opportunities(truth, leads, "truth_id", "iso_time")
    at = truth.select("truth_id", F.col("iso_time").alias("valid_time"), "storm_id", "basin", F.col("lat").alias("truth_lat"), F.col("lon").alias("truth_lon"), F.col("wind_kt").alias("truth_wind_kt"), F.col("pressure_hpa").alias("truth_pressure_hpa"))
    linked = joins.link_at_start(means.where("lead_hours = 0").select("init_time", "track_id", "lat", "lon"), truth.select("truth_id", "iso_time", "lat", "lon"))
    rows = due.join(merged(at), ["truth_id", "valid_time"]).join(merged(linked), ["init_time", "truth_id"], "left").withColumn("id_mapping_method", F.coalesce("method", F.lit("unlinked"))).drop("method")
    rows = rows.join(merged(means.select(*KEY, "lat", "lon", "wind_kt", "pressure_hpa", F.lit(True).alias("forecast_present"))), list(KEY), "left").withColumn("forecast_present", F.coalesce("forecast_present", F.lit(False)))
    rows = rows.join(merged(_scores(rows, members, size)), list(KEY), "left").withColumn("member_count", F.coalesce("member_count", F.lit(0).cast("long")))
    shown = F.col("forecast_present")
    off = lambda a, b: F.when(shown, scalar.finite(a) - scalar.finite(b))
    rows = rows.withColumns({"track_error_km": F.when(shown & geo.valid_position("lat", "lon"), geo.distance_km("lat", "lon", "truth_lat", "truth_lon")), "vmax_error_kt": off("wind_kt", "truth_wind_kt"), "pressure_error_hpa": off("pressure_hpa", "truth_pressure_hpa")})
    rows = rows.withColumns({c: F.when(shown, F.col(c)) for c in ("vmax_crps_kt", "vmax_brier_64", "track_energy_score_km")})
    return rows.withColumn("init_year", F.year("init_time")).drop("lat", "lon", "wind_kt", "pressure_hpa")


def summary(cases: DataFrame, seed: int = 20220801) -> DataFrame:
    """One row a year and lead: eligible and matched cases, errors with intervals of storms drawn anew, means of the scores."""
    keys = ["init_year", "lead_hours"]
    have = F.col("forecast_present")
    out = cases.groupBy(*keys).agg(
        F.count("*").alias("eligible"), F.count_if(have).alias("matched"), F.countDistinct(F.when(have, F.col("storm_id"))).alias("storms"), F.count("track_error_km").alias("track_n"), F.avg("track_error_km").alias("track_mae_km"), F.median("track_error_km").alias("track_median_km"),
        F.count("vmax_error_kt").alias("vmax_n"), F.avg(F.abs("vmax_error_kt")).alias("vmax_mae_kt"), F.avg("vmax_error_kt").alias("vmax_bias_kt"), F.count("pressure_error_hpa").alias("pressure_n"), F.avg(F.abs("pressure_error_hpa")).alias("pressure_mae_hpa"),
        F.count("vmax_crps_kt").alias("full_ensemble_n"), F.avg("vmax_crps_kt").alias("vmax_crps_kt"), F.avg("vmax_brier_64").alias("vmax_brier_64"), F.avg("track_energy_score_km").alias("track_energy_score_km"),
    )
    for name, error, start in (("track_mae", "track_error_km", seed), ("vmax_mae", "vmax_error_kt", seed + 10_000)):
        drawn = ensemble.bootstrap_interval(cases, keys, "storm_id", error, start).select(*keys, F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
        out = out.join(drawn, keys, "left")
    return out
