"""Small column functions: numbers, units, times, identifiers, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
#: Storm identifier letters to basin prefixes (fixed values).
BASIN_LETTERS = {"L": "AL", "E": "EP", "C": "CP", "W": "WP", "A": "IO", "B": "IO", "S": "SH", "P": "SH"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, independent of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), _c(ts).cast("timestamp_ntz"))


def hours_between(a: Column | str, b: Column | str) -> Column:
    """Hours from a to b, with fractions."""
    return (micros(b) - micros(a)) / float(HOUR_US)


def finite(x: Column | str) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf")), _c(x))


def sentinel_to_null(x: Column | str) -> Column:
    """Null for the missing markers of decoded messages: NaN, infinities, 1e90 and beyond, 2147483647."""
    return F.when(~F.isnan(_c(x)) & (F.abs(_c(x)) < 1e90) & (_c(x) != 2147483647), _c(x))


def nmi_to_km(x: Column | str) -> Column:
    return _c(x) * 1.852


def ms_to_kt(x: Column | str) -> Column:
    return _c(x) * 3600.0 / 1852.0


def pa_to_hpa(x: Column | str) -> Column:
    return _c(x) / 100.0


def m_to_km(x: Column | str) -> Column:
    return _c(x) / 1000.0


def interpolate(a: Column | str, b: Column | str, fraction: Column | str) -> Column:
    """a + fraction * (b - a); with one end missing only that end itself gives a value."""
    a, b, f = _c(a), _c(b), _c(fraction)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a + f * (b - a)).when(a.isNotNull() & (f <= 1e-12), a).when(b.isNotNull() & (f >= 1 - 1e-12), b)


def wind_speed(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def exceeds(x: Column | str, limit: float) -> Column:
    """1.0 where x >= limit, 0.0 where it is below, null where x is missing."""
    return (_c(x) >= limit).cast("double")


def horizon_hours(init: Column | str, reference: Column | str, step: int = 6, most: int = 240) -> Column:
    """Hours from init to reference, rounded up to whole steps; raises outside (0, most]."""
    us = micros(reference) - micros(init)
    unit = step * HOUR_US
    hours = F.floor((us + unit - 1) / F.lit(unit)).cast("int") * step
    fine = (us > 0) & (hours <= most)
    return F.when(fine, hours).otherwise(F.raise_error(F.concat(F.lit("horizon out of range: "), hours.cast("string"))).cast("int"))


def identifier_agrees(identifier: Column | str, atcf: Column | str) -> Column:
    """Whether a forecast's storm identifier (two digits and a basin letter) names the same storm as an ATCF id."""
    up = F.upper(F.trim(_c(identifier)))
    number, letter = F.regexp_extract(up, r"^(\d{2})([A-Z])$", 1), F.regexp_extract(up, r"^(\d{2})([A-Z])$", 2)
    basin = F.create_map(*[F.lit(x) for pair in BASIN_LETTERS.items() for x in pair])[letter]
    return F.coalesce((number != "") & (basin == F.substring(_c(atcf), 1, 2)) & (number == F.substring(_c(atcf), 3, 2)), F.lit(False))


def case_id(storm: Column | str, ordinal: Column | str) -> Column:
    """storm-CE##; longer numbers keep all their digits."""
    return F.concat(_c(storm).cast("string"), F.lit("-CE"), F.format_string("%02d", _c(ordinal).cast("long")))


def forecast_case_id(case: Column | str, lead: Column | str) -> Column:
    """case-L###; longer leads keep all their digits."""
    return F.concat(_c(case), F.lit("-L"), F.format_string("%03d", _c(lead).cast("long")))


def split_case_id(forecast_case: Column | str) -> Column:
    """struct<case_id, lead> of case-L###, parted at the last -L; nulls where it does not fit."""
    got = lambda i: F.nullif(F.regexp_extract(_c(forecast_case), r"^(.*)-L(\d+)$", i), F.lit(""))
    return F.struct(got(1).alias("case_id"), got(2).cast("int").alias("lead"))


def surface(is_land: Column | str) -> Column:
    return F.when(F.coalesce(_c(is_land), F.lit(False)), "land").otherwise("sea")


def tier(r64: Column, r50: Column, r34: Column, landfall: Column, landfall_wind: Column, strong: float = 64.0) -> Column:
    """A: 64-kt contact or landfall at storm strength; B: 50-kt contact or landfall; C: 34-kt contact; D: none. Missing counts as no."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return F.when(yes(r64) | yes(landfall & (landfall_wind >= strong)), "A").when(yes(r50) | yes(landfall), "B").when(yes(r34), "C").otherwise("D")


def mean_longitude(lon: Column | str) -> Column:
    """Circular mean, an aggregate."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(_c(lon)))), F.avg(F.cos(F.radians(_c(lon))))))


def sorted_join(x: Column | str, mark: str = "+") -> Column:
    """Distinct values in order, joined: an aggregate."""
    return F.array_join(F.array_sort(F.collect_set(_c(x))), mark)


def nearest_cycle(target: Column | str, hours: Sequence[int] = (0, 6, 12, 18)) -> Column:
    """The forecast cycle closest to target, the earlier of two as close: struct<off_us, cycle_us>."""
    day = 24 * HOUR_US
    at = micros(target)
    start = F.floor(at / F.lit(day)).cast("long") * day
    cycles = F.array(*[start + F.lit(d * day + h * HOUR_US) for d in (-1, 0, 1) for h in hours])
    return F.array_min(F.transform(cycles, lambda c: F.struct(F.abs(c - at).alias("off_us"), c.alias("cycle_us"))))
