"""Ordered operations within a storm: sessions, pairs, densified tracks, folds over failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import lineage


def sessions(df: DataFrame, key: str, time: str, tie: str, gap_hours: float = 6.0, name: str = "episode_group") -> DataFrame:
    """df with name, 0, 1, ... within key: a new one begins after a gap of more than gap_hours."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = scalar.micros(time) - F.lag(scalar.micros(time)).over(w)
    new = F.coalesce(gap > int(gap_hours * scalar.HOUR_US), F.lit(False)).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w).cast("int")).drop("_new")


def consecutive_pairs(df: DataFrame, key: str, time: str, tie: str, values: Sequence[str], max_gap_hours: float = 6.0) -> DataFrame:
    """One row per pair of neighbours in time: a_* and b_* values, hours, gap (longer than max_gap_hours); pairs without time between are left out."""
    w = Window.partitionBy(key).orderBy(time, tie)
    names = [time, tie, *values]
    pair = df.select(key, *[F.col(c).alias(f"a_{c}") for c in names], *[F.lead(c).over(w).alias(f"b_{c}") for c in names], F.row_number().over(w).alias("segment"))
    pair = pair.where(F.col(f"b_{time}").isNotNull()).withColumn("segment", F.col("segment") - 1)
    pair = pair.withColumn("hours", scalar.hours_between(f"a_{time}", f"b_{time}"))
    return pair.where("hours > 0").withColumn("gap", F.col("hours") > max_gap_hours)


def steps_between(pairs: DataFrame, spacing_km: float = 10.0, step_hours: float = 1.0, length: Column | None = None) -> DataFrame:
    """Pairs without a gap, exploded into steps 1..n with fraction: n is the larger of length / spacing and hours / step, rounded up, and 1 at least."""
    d = geo.distance_km("a_lat", "a_lon", "b_lat", "b_lon") if length is None else length
    n = F.greatest(F.lit(1), F.ceil(d / spacing_km).cast("int"), F.ceil(F.col("hours") / step_hours).cast("int"))
    one = pairs.where("NOT gap").withColumn("length_km", d).withColumn("steps", n).withColumn("step", F.explode(F.sequence(F.lit(1), n)))
    return one.withColumn("fraction", F.col("step") / F.col("steps"))


def densify(df: DataFrame, numeric: Sequence[str], nearest: Sequence[str], key: str = "storm_id", time: str = "iso_time", tie: str = "fix_id", spacing_km: float = 10.0, step_hours: float = 1.0, gap_hours: float = 6.0) -> DataFrame:
    """The track resampled to at most spacing_km and step_hours.

    Positions follow the ellipsoidal geodesic; numeric columns are linear and null unless both ends
    are there (the ends keep their own); nearest columns come from the earlier fix below the middle.
    After a gap only the later fix itself is kept, with segment_break_before.
    """
    w = Window.partitionBy(key).orderBy(time, tie)
    names = [time, tie, "lat", "lon", *numeric, *nearest]
    # one pass over the sorted fixes: each gives itself if it is the first, and what leads to the next one
    rows = df.select(key, *[F.col(c).alias(f"a_{c}") for c in names], *[F.lead(c).over(w).alias(f"b_{c}") for c in names], F.row_number().over(w).alias("segment"))
    rows = rows.withColumn("hours", scalar.hours_between(f"a_{time}", f"b_{time}"))
    ahead, gap = F.coalesce(F.col("hours") > 0, F.lit(False)), F.coalesce(F.col("hours") > gap_hours, F.lit(False))
    end = [F.when(ahead & ~gap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")) for c in ("lat", "lon")]
    # a pair's length and bearing once, then its steps
    rows = rows.withColumns({"length_km": geo.exact_distance_km("a_lat", "a_lon", *end), "way": geo.exact_bearing_deg("a_lat", "a_lon", *end)})
    n = F.greatest(F.lit(1), F.ceil(F.col("length_km") / spacing_km).cast("int"), F.ceil(F.col("hours") / step_hours).cast("int"))
    own, none = F.col("segment") == 1, F.expr("CAST(array() AS array<int>)")
    steps = F.concat(F.when(own, F.array(F.lit(0))).otherwise(none), F.when(gap, F.array(F.lit(-1))).when(ahead, F.sequence(F.lit(1), n)).otherwise(none))
    each = rows.withColumn("steps", n).withColumn("step", F.explode(steps)).withColumn("fraction", F.when(F.col("step") > 0, F.col("step") / F.col("steps")).otherwise(0.0))
    each = each.withColumn("_at", geo.destination("a_lat", "a_lon", "way", F.col("length_km") * F.col("fraction")))
    first, break_, last = F.col("step") == 0, F.col("step") == -1, F.col("step") == F.col("steps")
    pick = lambda c, between: F.when(first, F.col(f"a_{c}")).when(break_, F.col(f"b_{c}")).otherwise(between)
    time_at = F.timestamp_micros((scalar.micros(f"a_{time}") + F.round((scalar.micros(f"b_{time}") - scalar.micros(f"a_{time}")) * F.col("fraction")).cast("long"))).cast("timestamp_ntz")
    return each.select(
        key, pick(time, F.when(last, F.col(f"b_{time}").cast("timestamp_ntz")).otherwise(time_at)).alias(time), pick("lat", F.col("_at.latitude")).alias("lat"), pick("lon", F.col("_at.longitude")).alias("lon"),
        *[pick(c, scalar.interpolate(f"a_{c}", f"b_{c}", "fraction")).alias(c) for c in numeric], *[pick(c, F.when(F.col("fraction") < 0.5, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))).alias(c) for c in nearest],
        pick(tie, F.when(last, F.col(f"b_{tie}")).otherwise(F.lit(-1))).alias("source_row"), F.when(first, 0).when(break_, F.col("segment")).otherwise(F.col("segment") - 1).cast("int").alias("source_segment"),
        "fraction", (first | break_ | last).alias("is_original"), break_.alias("segment_break_before"),
    )


def flag_hours(df: DataFrame, keys: Sequence[str], time: str, tie: str, flag: str) -> DataFrame:
    """keys, hours: trapezoidal time under a flag; one row gives 0."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    f = F.coalesce(F.col(flag), F.lit(False)).cast("double")
    area = scalar.hours_between(time, F.lead(time).over(w)) * (f + F.lead(f).over(w)) / 2.0
    return df.withColumn("_area", area).groupBy(*keys).agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("hours"))


def terminated_after_failure(df: DataFrame, keys: Sequence[str], order: str, failed: Column, status: str = "status") -> DataFrame:
    """Rows behind the first failed one get the status terminated."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.coalesce(failed, F.lit(False))).over(w), F.lit(False))
    return df.withColumn(status, F.when(over, F.lit("terminated")).otherwise(F.col(status)))


def first_and_last(df: DataFrame, keys: Sequence[str], order: str, status: str = "status") -> DataFrame:
    """keys, last_ok (largest order with status ok), first_bad and its status."""
    bad = F.col(status) != "ok"
    return df.groupBy(*keys).agg(F.max(F.when(~bad, F.col(order))).alias("last_ok"), F.min(F.when(bad, F.col(order))).alias("first_bad"), F.min(F.when(bad, F.struct(order, status)))[status].alias("first_bad_status"))


def fill_both_ways(df: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Missing values between two known ones on the line over row positions; before the first and after the last the nearest known."""
    w = Window.partitionBy(key).orderBy(*order)
    at = F.row_number().over(w)
    rows = df.withColumn("_at", at).withColumn("_known", F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v"))))
    back = F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # backwards too the frame ends at the row: one that looks ahead would be read anew for each row
    down = Window.partitionBy(key).orderBy(F.col("_at").desc())
    ahead = F.last("_known", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_b", back).withColumn("_f", ahead)
    line = F.col("_b.v") + (F.col("_f.v") - F.col("_b.v")) * (F.col("_at") - F.col("_b.at")) / (F.col("_f.at") - F.col("_b.at"))
    both = F.col("_b").isNotNull() & F.col("_f").isNotNull() & (F.col("_f.at") > F.col("_b.at"))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).when(both, line).otherwise(F.coalesce("_b.v", "_f.v"))).drop("_at", "_known", "_b", "_f")


def hold_or_lose(df: DataFrame, key: str, order: Sequence[str], value: str, most: float) -> DataFrame:
    """key, step, held, status: a value is kept while it lies within most of the last one kept; from the first that does not, the track is lost.

    Until the loss the last one kept is the one before, so the fold is the first jump and a running
    maximum: windows, in time and memory of the sort, however long a sequence is. A missing value
    is a jump.
    """
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.row_number().over(w)
    jump = (step > 1) & ~F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) <= most, F.lit(False))
    rows = df.select(key, *order, F.col(value).alias("_v"), step.alias("step"), jump.alias("_jump")).withColumn("_lost", F.max("_jump").over(so_far))
    held = F.last(F.when(~F.col("_lost"), F.col("_v")), ignorenulls=True).over(so_far)
    return rows.select(key, "step", held.alias("held"), F.when(F.col("_lost"), "lost").otherwise("ok").alias("status"))


def line_segments(df: DataFrame, key: str, order: Sequence[str], tie: str, value: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Track pieces to draw: key, tie of both ends, start and end with the end's longitude moved by 360 where the piece crosses the date line, and the mean value of the ends.

    Missing values are first filled along the track; a piece without a position at either end, or
    without any value, is left out.
    """
    filled = fill_both_ways(df.withColumn("_v", scalar.finite(value)), key, order, "_v", "_filled")
    w = Window.partitionBy(key).orderBy(*order)
    ahead = lambda c: F.lead(c).over(w)
    p = filled.select(key, F.col(tie).alias("from_id"), ahead(tie).alias("to_id"), F.col(lat).alias("start_lat"), F.col(lon).alias("start_lon"), ahead(lat).alias("end_lat"), ahead(lon).alias("_lon"), F.col("_filled").alias("_a"), ahead("_filled").alias("_b"))
    there = geo.valid_position("start_lat", "start_lon") & geo.valid_position("end_lat", "_lon")
    jump = F.col("_lon") - F.col("start_lon")
    end = F.when(jump > 180, F.col("_lon") - 360.0).when(jump < -180, F.col("_lon") + 360.0).otherwise(F.col("_lon"))
    mean = (F.coalesce("_a", "_b") + F.coalesce("_b", "_a")) / 2.0
    return p.where(F.col("to_id").isNotNull() & there).withColumns({"end_lon": end, "value": mean}).where(F.col("value").isNotNull()).drop("_lon", "_a", "_b")


def placed(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with its rows' places from 1 in the given order, nulls first; order must tell all rows apart, else equal rows take their places in any order.

    One sort by range, kept by a checkpoint so that counts and rows come from the same sort. A row's place
    is its place in its partition after the rows of all partitions before, of which there is one number each.
    """
    rows = lineage.kept(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_at", "_part", "_row", "_before")
