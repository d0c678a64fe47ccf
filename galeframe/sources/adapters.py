"""Forecasts of any model as one canonical table: readers by declared format, names by declared mappings.

A reader is a function (spark, path, variables, bounds) that gives a lazy DataFrame of cells, of
variables under the files' names and within bounds of them (see `scans`). Formats are
looked up by name when a forecast is opened; `register_format` adds one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from galeframe.sources import netcdf, scans, zarr

# Canonical names of dimensions and fields.
DIMENSIONS = ("init_time", "lead_time", "latitude", "longitude")
FIELDS = ("msl", "u10", "v10", "z500", "u850", "v850", "u200", "v200")

Reader = Callable[[SparkSession, str, Sequence[str], scans.Bounds], DataFrame]


def _by_source(source: type[DataSource]) -> Reader:
    return lambda spark, path, variables, bounds: scans.opened(spark, source, path, bounds, variables=",".join(variables))


def _parquet(spark: SparkSession, path: str, variables: Sequence[str], bounds: scans.Bounds) -> DataFrame:
    df = spark.read.parquet(path)
    for name, (lo, hi) in bounds.items():
        c = F.col(_quoted(name))
        df = df.where((F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c <= hi) & c.isNotNull())
    return df


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


FORMATS: dict[str, Reader] = {"netcdf": _by_source(netcdf.NetcdfSource), "zarr": _by_source(zarr.ZarrSource), "parquet": _parquet}
ADAPTERS: dict[str, Adapter] = {}


def register_format(name: str, reader: Reader) -> None:
    """Make a format known under a name, in place of an earlier one."""
    FORMATS[name] = reader


def check_canonical(df: DataFrame, all_fields: bool = True) -> DataFrame:
    """df itself; raises where a canonical dimension, or with all_fields a canonical field, lacks."""
    for what, names in (("dimensions", DIMENSIONS), ("fields", FIELDS if all_fields else ())):
        lacking = sorted(set(names) - set(df.columns))
        if lacking:
            raise ValueError(f"missing canonical {what}: {', '.join(lacking)}")
    return df


@dataclass(frozen=True)
class Adapter:
    """How a model's files are read. coordinates and variables: canonical name -> name in the files; convert: canonical name -> change of its column, such as of units."""

    model: str
    file_format: str
    coordinates: Mapping[str, str]
    variables: Mapping[str, str]
    convert: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for names, given in ((DIMENSIONS, self.coordinates), (FIELDS, self.variables)):
            lacking = sorted(set(names) - set(given))
            if lacking:
                raise ValueError(f"missing mapping of {', '.join(lacking)}")

    def open_forecast(self, spark: SparkSession, path: str, bounds: scans.Bounds | None = None) -> DataFrame:
        """The cells of a forecast under the files' own names, within bounds by canonical dimensions; nothing but metadata is read."""
        if self.file_format not in FORMATS:
            raise ValueError(f"unsupported forecast format: {self.file_format}")
        within = {self.coordinates[name]: b for name, b in (bounds or {}).items()}
        return FORMATS[self.file_format](spark, path, list(dict.fromkeys(self.variables.values())), within)

    def normalize(self, cells: DataFrame) -> DataFrame:
        """cells under canonical names, all renamed at once, so that names may swap; other columns follow as they are.

        A mapped name that lacks raises, as does another column that has a canonical name already.
        """
        named = {**self.coordinates, **self.variables}
        lacking = sorted(set(named.values()) - set(cells.columns))
        if lacking:
            raise ValueError(f"missing in the files of {self.model}: {', '.join(lacking)}")
        rest = [c for c in cells.columns if c not in named.values()]
        clash = sorted({c.lower() for c in rest} & {c.lower() for c in named})
        if clash:
            raise ValueError(f"columns under canonical names: {', '.join(clash)}")
        same = lambda c: c
        out = cells.select(*[self.convert.get(new, same)(F.col(_quoted(old))).alias(new) for new, old in named.items()], *[F.col(_quoted(c)) for c in rest])
        return check_canonical(out)


def register_adapter(adapter: Adapter) -> None:
    """Make a model's adapter known, in place of an earlier one."""
    ADAPTERS[adapter.model.lower()] = adapter


def forecast(spark: SparkSession, model: str, path: str, bounds: scans.Bounds | None = None) -> DataFrame:
    """The canonical cells of a model's forecast, within bounds by canonical dimensions."""
    if model.lower() not in ADAPTERS:
        raise ValueError(f"no adapter for {model}")
    a = ADAPTERS[model.lower()]
    return a.normalize(a.open_forecast(spark, path, bounds))
