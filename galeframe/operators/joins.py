"""Joins that tracks and forecasts need: seeds, lead offsets, distance with an ambiguity rule, brackets, intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators.lineage import merged


def with_seed(cases: DataFrame, fixes: DataFrame) -> DataFrame:
    """cases with seed_lat, seed_lon and has_seed: the main-track fix of the storm at exactly init_time, never interpolated."""
    seeds = fixes.where(F.lower("track_type") == "main").select("storm_id", F.col("iso_time").alias("init_time"), F.col("lat").alias("seed_lat"), F.col("lon").alias("seed_lon"), F.lit(True).alias("has_seed"))
    return cases.join(seeds, ["storm_id", "init_time"], "left").withColumn("has_seed", F.coalesce("has_seed", F.lit(False)))


def lead_opportunities(truth: DataFrame, leads: Sequence[int], key: str = "storm_id", time: str = "iso_time") -> DataFrame:
    """key, init_time, lead_hours, valid_time where the storm is active at both times: one equi-join over exploded leads."""
    starts = truth.select(key, F.col(time).alias("init_time"), F.explode(F.array(*[F.lit(h) for h in leads])).alias("lead_hours"))
    starts = starts.withColumn("valid_time", F.timestamp_add("HOUR", "lead_hours", "init_time"))
    return starts.join(merged(truth.select(key, F.col(time).alias("valid_time"))), [key, "valid_time"]).select(key, "init_time", "lead_hours", "valid_time")


def _band_deg(limit_km: float) -> float:
    """Degrees of latitude that limit_km can span at most."""
    return math.degrees(limit_km / geo.LEAST_RADIUS_KM)


def within_km(left: DataFrame, right: DataFrame, on: str, limit_km: float) -> DataFrame:
    """Rows of left (on, lat, lon) with each row of right (on, t_lat, t_lon) of the same on that lies within limit_km, and distance_km.

    Both meet by cells of latitude as high as the limit; the ellipsoidal distance is computed only
    where the longitudes allow it.
    """
    band = _band_deg(limit_km)
    cell = lambda y: F.floor((F.col(y) + 90.0) / band).cast("int")
    near = left.withColumn("_cell", F.explode(F.array(*[cell("lat") + k for k in (-1, 0, 1)]))).join(right.withColumn("_cell", cell("t_lat")), [on, "_cell"])
    dlon = F.abs(F.pmod(F.col("t_lon") - F.col("lon") + 180.0, F.lit(360.0)) - 180.0)
    reach = F.when(F.abs("lat") + band < 89.0, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(min(90.0, band)))) / F.cos(F.radians("lat")))))).otherwise(180.0)
    near = near.where((F.abs(F.col("t_lat") - F.col("lat")) <= band) & (dlon <= reach)).withColumn("distance_km", geo.distance_km("lat", "lon", "t_lat", "t_lon"))
    return near.where(F.col("distance_km") <= limit_km).drop("_cell")


def nearest_two(left: DataFrame, right: DataFrame, on: str, other: str, limit_km: float) -> DataFrame:
    """on, lat, lon, candidates (the number of right's rows within limit_km), first and second (structs of distance_km and other) in order of distance and other, for each place of left that has any.

    left: on, lat, lon; right: on, t_lat, t_lon, other. Rows of one place are as far from all others,
    so places meet and not rows: a place of right stands for its rows by their number and its two
    smallest others, which are all of them that can be first or second.
    """
    w = Window.partitionBy(on, "t_lat", "t_lon").orderBy(other)
    ranked = right.select(on, "t_lat", "t_lon", other, F.row_number().over(w).alias("_n"))
    at = lambda n: F.max(F.when(F.col("_n") == n, F.col(other)))
    held = ranked.groupBy(on, "t_lat", "t_lon").agg(F.max("_n").cast("long").alias("_rows"), at(1).alias("_a"), at(2).alias("_b"))
    near = within_km(left.select(on, "lat", "lon").distinct(), held, on, limit_km)
    one = lambda c: F.when(F.col(c).isNotNull(), F.struct("distance_km", F.col(c).alias(other)))
    rank = F.row_number().over(Window.partitionBy(on, "lat", "lon").orderBy("distance_km", "_a"))
    ranked = near.select(on, "lat", "lon", "_rows", one("_a").alias("_c"), one("_b").alias("_d"), rank.alias("_n"))
    of = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    # behind the first comes the next row of its own place or the first of the next place
    return ranked.groupBy(on, "lat", "lon").agg(F.sum("_rows").cast("long").alias("candidates"), of(1, "_c").alias("first"), F.least(of(1, "_d"), of(2, "_c")).alias("second"))


def identify(messages: DataFrame, truth: DataFrame, cohort: DataFrame, limit_km: float = 150.0, apart_km: float = 75.0) -> DataFrame:
    """Each message's storm by position at its time: the nearest of the candidates.

    messages: message_id, init_time, lat, lon; truth: storm_id, iso_time, lat, lon (extra columns are
    dropped); cohort: storm_id. Candidates lie within limit_km, ordered by (distance, storm_id); if
    the second is less than apart_km farther than the first, the match is ambiguous.
    """
    t = truth.select(F.col("storm_id").alias("candidate"), F.col("iso_time").alias("init_time"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    m = messages.withColumn("positioned", geo.valid_position("lat", "lon"))
    two = nearest_two(m.where("positioned"), t, "init_time", "candidate", limit_km)
    times = t.select("init_time").distinct().withColumn("seen", F.lit(True))
    out = m.join(two, ["init_time", "lat", "lon"], "left").join(times, "init_time", "left")
    out = out.withColumns({"nearest": F.col("first.candidate"), "nearest_km": F.col("first.distance_km"), "second_km": F.col("second.distance_km"), "candidates": F.coalesce("candidates", F.lit(0)).cast("long")})
    out = out.join(cohort.select(F.col("storm_id").alias("nearest"), F.lit(True).alias("in_cohort")).distinct(), "nearest", "left")
    status = (
        F.when(~F.col("positioned"), "missing_observed_position").when(F.col("seen").isNull(), "no_truth_at_init").when(F.col("candidates") == 0, "no_position_match")
        .when(F.col("second_km") - F.col("nearest_km") < apart_km, "ambiguous_position").when(F.col("in_cohort"), "matched_cohort").otherwise("matched_outside_cohort")
    )
    out = out.withColumn("identity_status", status).withColumn("storm_id", F.when(status.startswith("matched"), F.col("nearest")))
    return out.drop("positioned", "first", "second", "seen", "in_cohort", "nearest")


def link_at_start(means: DataFrame, truth: DataFrame, limit_km: float = 150.0, apart_km: float = 75.0) -> DataFrame:
    """init_time, track_id, truth_id, method, init_match_distance_km: which observed storm a forecast track is, by its position at lead 0.

    means: init_time, track_id, lat, lon (lead 0); truth: truth_id, iso_time, lat, lon. A track needs
    one storm within limit_km that is apart_km nearer than the next. The method is exact for equal
    ids, position_suffix where number and year agree (basins and seasons are named differently), else
    position_only. A storm claimed by two tracks of one time raises.
    """
    m = means.where(geo.valid_position("lat", "lon")).select("init_time", "track_id", "lat", "lon")
    t = truth.select("truth_id", F.col("iso_time").alias("init_time"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    two = m.join(merged(nearest_two(m, t, "init_time", "truth_id", limit_km)), ["init_time", "lat", "lon"])
    lone = two.where(F.coalesce(F.col("second.distance_km") - F.col("first.distance_km") >= apart_km, F.lit(True)))
    same, tail = F.col("track_id") == F.col("truth_id"), F.substring("track_id", -6, 6) == F.substring("truth_id", -6, 6)
    found = lone.select("init_time", "track_id", F.col("first.truth_id").alias("truth_id"), F.col("first.distance_km").alias("init_match_distance_km"))
    found = found.withColumn("method", F.when(same, "exact").when(tail, "position_suffix").otherwise("position_only"))
    return one_to_one(found, ["init_time", "truth_id"], "track_id")


def one_to_one(links: DataFrame, claim: Sequence[str], claimant: str) -> DataFrame:
    """links, raising at run time if two claimants hold one claim."""
    n = F.count(claimant).over(Window.partitionBy(*claim))
    return links.withColumn("_n", F.when(n > 1, F.raise_error(F.lit(f"claimed twice: {', '.join(claim)}")).cast("long")).otherwise(n)).where("_n >= 0").drop("_n")


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], validate: str = "many_to_one", how: str = "inner") -> DataFrame:
    """The join, raising at run time where a key that must be unique (right's for many_to_one, left's for one_to_many, both for one_to_one) is not."""
    sides = {"many_to_one": (False, True), "one_to_many": (True, False), "one_to_one": (True, True), "many_to_many": (False, False)}[validate]

    def unique(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*on))
        many = F.raise_error(F.lit(f"not {validate}: {', '.join(on)} repeats")).cast("long")
        return df.withColumn("_n", F.when(n > 1, many).otherwise(n)).where("_n = 1").drop("_n")

    left, right = (unique(df) if once else df for df, once in zip((left, right), sides, strict=True))
    return left.join(right, list(on), how)


def _timeline(left: DataFrame, key: str, left_time: str, right: DataFrame, right_time: str, row: Column) -> DataFrame:
    """Both tables as one: _k, _t and either _l, the whole row of left, or _r; what a row of left meets lies beside it in time."""
    one = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    two = right.where(F.col(right_time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), row.alias("_r"))
    return one.unionByName(two, allowMissingColumns=True)


def _latest(order: Sequence[Column]) -> Column:
    """The last _r so far in an order within the key: one pass over sorted rows, however many a key has."""
    return F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def bracket(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], gap_hours: float = 6.0, inclusive: bool = False) -> DataFrame:
    """left with before and after structs (time, values): the last right row before and the first after left_time.

    An exact row is both. A pair farther apart than gap_hours counts as none. inclusive allows the
    ends to be the time itself on either side, which an exact row gives anyway. Of right rows of one
    time the one with the largest values is before, that with the least after and exact.
    """
    both = _timeline(left, key, left_time, right, right_time, F.struct(F.col(right_time).alias("time"), *values))
    own = F.col("_l").isNotNull()
    last = own if inclusive else ~own  # where times are equal: whether rows of left come behind those of right
    both = both.withColumns({"_lo": _latest([F.col("_t"), last, F.col("_r")]), "_hi": _latest([F.col("_t").desc(), last, F.col("_r").desc()]), "_at": _latest([F.col("_t").desc(), own, F.col("_r").desc()])})
    there = both.where(own).withColumns({c: F.when(F.col("_t").isNotNull(), F.col(c)) for c in ("_lo", "_hi")}).withColumn("_at", F.when(F.col("_at.time") == F.col("_t"), F.col("_at")))
    exact = F.col("_at").isNotNull()
    fits = F.col("_lo").isNotNull() & F.col("_hi").isNotNull() & (scalar.hours_between(F.col("_lo.time"), F.col("_hi.time")) <= gap_hours)
    end = lambda c: F.when(exact, F.col("_at")).when(fits, F.col(c))
    method = F.when(exact, "exact").when(fits, "interpolated").otherwise("unavailable")
    return there.select("_l.*", end("_lo").alias("before"), end("_hi").alias("after"), method.alias("coverage_method"))


def coverage_flags(bracketed: DataFrame, wind: str, pressure: str) -> DataFrame:
    """forecast_available, and wind and pressure available at both ends (wind 0 or more, pressure above 0)."""
    there = F.col("before").isNotNull()
    good = lambda c, ok: F.coalesce(ok(scalar.finite(F.col(f"before.{c}"))) & ok(scalar.finite(F.col(f"after.{c}"))), F.lit(False))
    return bracketed.withColumns({"forecast_available": there, "forecast_wind_available": there & good(wind, lambda x: x >= 0), "forecast_pressure_available": there & good(pressure, lambda x: x > 0)})


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_id: str) -> DataFrame:
    """left with nearest: the right_id of the closest row in time, the smaller id of two as close; and off_us, how far it is."""
    both = _timeline(left, key, left_time, right, right_time, F.struct(F.col(right_time).alias("time"), F.col(right_id).alias("id")))
    own, small = F.col("_l").isNotNull(), F.col("_r.id").desc()
    both = both.withColumns({"_lo": _latest([F.col("_t"), own, small]), "_hi": _latest([F.col("_t").desc(), own, small])})
    off = lambda c: F.when(F.col(c).isNotNull() & F.col("_t").isNotNull(), F.struct(F.abs(scalar.micros(f"{c}.time") - scalar.micros("_t")).alias("off_us"), F.col(f"{c}.id").alias("id")))
    return both.where(own).withColumn("_b", F.least(off("_lo"), off("_hi"))).select("_l.*", F.col("_b.id").alias("nearest"), F.col("_b.off_us").alias("off_us"))


def in_interval(points: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, padding_hours: float = 0.0, cell_hours: float = 24.0) -> DataFrame:
    """Rows of points with each span of their key that holds their time, padded at both ends, inclusive.

    A span goes to all cells of time that it touches, a point to its own, so points meet spans of
    their own days only.
    """
    pad, cell = int(padding_hours * scalar.HOUR_US), int(cell_hours * scalar.HOUR_US)
    lo, hi = scalar.micros(start) - pad, scalar.micros(end) + pad
    s = spans.where(lo <= hi).withColumn("_cell", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    p = points.withColumn("_cell", F.floor(scalar.micros(time) / cell))
    return p.join(s, [key, "_cell"]).where(scalar.micros(time).between(lo, hi)).drop("_cell")


def usable_initializations(events: DataFrame, forecasts: DataFrame) -> DataFrame:
    """events (case_id, storm_id, reference_time) with the number of usable initializations before the reference time and of all."""
    f = forecasts.where("usable").select("storm_id", "init_time")
    both = _timeline(events, "storm_id", "reference_time", f, "init_time", F.lit(1))
    own = F.col("_l").isNotNull()
    w = Window.partitionBy("_k").orderBy("_t", ~own).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("initializations_before", F.count("_r").over(w)).where(own).select("_l.*", "initializations_before")
    total = f.groupBy("storm_id").agg(F.count("init_time").cast("long").alias("initializations"))
    out = counted.join(total, "storm_id", "left").withColumn("initializations", F.coalesce("initializations", F.lit(0).cast("long")))
    return out.withColumn("storm_has_forecast", F.col("initializations") > 0)


def unavailable_reason(conflict: Column, present: Column, usable: Column, before: Column, covered: Column) -> Column:
    """The first of the ordered reasons that holds, or an empty string."""
    no = lambda x: ~F.coalesce(x, F.lit(False))
    return (
        F.when(F.coalesce(conflict, F.lit(False)), "conflicting_duplicate_forecasts").when(no(present), "planned_init_absent").when(no(usable), "no_positive_position_points")
        .when(no(before), "initialization_not_before_event").when(no(covered), "reference_time_not_covered").otherwise("")
    )
