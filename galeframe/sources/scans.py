"""Opening file sources: bounds that are said when a scan is opened, and filters that Spark pushes.

    scans.opened(spark, netcdf.NetcdfSource, "surface.nc", {"latitude": (0, 10)}, variables="msl")

Bounds belong to the DataFrame that is opened, both ends included (None: open); rows beyond them,
or without a value there, are not in it. They are the safe way to read less.

Spark 4.1 can push filters into Python sources too (`pushdown`), but it keeps what was pushed with
the loaded DataFrame: a later use of the same DataFrame, even the other side of a union, is then
read with the filters of the earlier one and loses rows. So it is off unless both the session
(`register` with pushdown) and the load (option pushdown) ask for it, and then each scan must be
loaded by itself.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

Bounds = Mapping[str, tuple[float | None, float | None]]


def register(spark: SparkSession, source: type[DataSource], pushdown: bool = False) -> None:
    """Make a format known to the session; pushdown also lets Spark push filters into loads that ask for it."""
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def opened(spark: SparkSession, source: type[DataSource], path: str, bounds: Bounds | None = None, **options) -> DataFrame:
    """The rows of a source at path within bounds."""
    register(spark, source)
    return spark.read.format(source.name()).options(**options).option("bounds", json.dumps(dict(bounds or {}))).load(path)


def pushes(options: Mapping) -> bool:
    """Whether a load asks for pushed filters."""
    return str(options.get("pushdown", "")).lower() == "true"


def bounds_of(options: Mapping) -> dict[str, tuple[float, float]]:
    """The bounds among a source's options, open ends as infinities."""
    given = json.loads(options.get("bounds") or "{}")
    return {name: (float("-inf") if lo is None else lo, float("inf") if hi is None else hi) for name, (lo, hi) in given.items()}
