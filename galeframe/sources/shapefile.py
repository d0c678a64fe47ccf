"""Polygon shapefiles as a Spark data source: one row a ring, read part by part.

    scans.opened(spark, shapefile.ShapefileSource, "coast.shp", {"area": (100, None)})

The source needs only the .shp file. Where records begin is read once, by the driver: from the .shx
file beside it, eight bytes a record, or else from the records' own headers. Where a .dbf with an
AREA column lies beside it, its values travel with the partitions. Bounds of `area`, comparisons that
Spark pushes (see `scans`) and the option `min_area` (which keeps records without an area) choose
records before their bytes are read; a partition reads its own records only. Paths are names or URIs that
pyarrow.fs opens.

Rings that cross or touch themselves are kept as they are: what they cover is meant by the even-odd
rule, sides included, which `operators.spatial.covered_by` applies. That is what repairing such
rings into valid polygons covers: both lobes of a bow-tie, a spike as the line it is, the ring around a
hole that touches it, not what is run around twice.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from galeframe.sources import scans

RING = "record int, part int, area double, ring array<struct<lon: double, lat: double>>"


class _Records(InputPartition):
    def __init__(self, records: list[tuple[int, int, int, float | None]]):
        self.records = records


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"^\w+:/", path) else (pyarrow.fs.LocalFileSystem(), path)


def _open(path: str) -> BinaryIO:
    fs, at = _fs(path)
    return fs.open_input_file(at)


def _beside(path: str, ending: str) -> str | None:
    """The file of the same name with another ending, if it is there."""
    other = os.path.splitext(path)[0] + ending
    fs, at = _fs(other)
    return other if fs.get_file_info(at).type == pyarrow.fs.FileType.File else None


def record_offsets(path: str) -> list[tuple[int, int]]:
    """(offset, bytes) of each record's content, from the index file if there is one, else from the records' own headers."""
    with _open(path) as f:
        head, size = f.read(100), f.size()
        if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
            raise ValueError("not a shapefile")
        if index := _beside(path, ".shx"):
            with _open(index) as g:
                body = g.read()[100:]
            out = [(2 * at + 8, 2 * words) for at, words in struct.iter_unpack(">ii", body[: len(body) // 8 * 8])]
        else:
            out, at = [], 100
            while at + 8 <= size:
                f.seek(at)
                _, words = struct.unpack(">ii", f.read(8))
                out.append((at + 8, 2 * words))
                at += 8 + 2 * words
        if any(n < 0 or at + n > size for at, n in out):
            raise ValueError("a record ends beyond the file")
    return out


def parse_polygon(content: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon record, closed; a null shape has none."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return []
    if kind != 5:
        raise ValueError(f"shape type {kind} is no polygon")
    parts, points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", content, 44 + 4 * parts)
    rings = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ring = [(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)]
        if ring and ring[0] != ring[-1]:
            ring.append(ring[0])
        if len(ring) >= 4:
            rings.append(ring)
    return rings


def attribute(path: str, name: str) -> list[float | None]:
    """A numeric column of a .dbf file."""
    with _open(path) as f:
        rows, head, width = struct.unpack("<4xIHH20x", f.read(32))
        fields, at = [], 1
        while (d := f.read(1)) not in (b"\r", b""):
            d += f.read(31)
            fields.append((d[:11].split(b"\0")[0].decode().upper(), at, d[16]))
            at += d[16]
        where = {n: (o, w) for n, o, w in fields}
        if name.upper() not in where:
            return []
        o, w = where[name.upper()]
        f.seek(head)
        body = f.read(rows * width)
    out: list[float | None] = []
    for i in range(rows):
        text = body[i * width + o : i * width + o + w].strip()
        out.append(float(text) if text else None)
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.min_area = options["path"], float(options.get("min_area", 0))
        self.per = int(options.get("records_per_partition", 2000))
        bounds = scans.bounds_of(options)
        if set(bounds) - {"area"}:
            raise ValueError("only area has bounds")
        self.tests = [(lambda x, y: y[0] <= x <= y[1], b) for b in bounds.values()]

    def partitions(self) -> list[_Records]:
        dbf = _beside(self.path, ".dbf")
        areas = attribute(dbf, "AREA") if dbf else []
        chosen = []
        for i, (at, n) in enumerate(record_offsets(self.path)):
            area = areas[i] if i < len(areas) else None
            if (area is None or area >= self.min_area) and all(area is not None and test(area, value) for test, value in self.tests):
                chosen.append((i, at, n, area))
        return [_Records(chosen[k : k + self.per]) for k in range(0, len(chosen), self.per)] or [_Records([])]

    def read(self, partition: _Records) -> Iterator[tuple]:
        with _open(self.path) as f:
            for i, at, n, area in partition.records:
                f.seek(at)
                for part, ring in enumerate(parse_polygon(f.read(n))):
                    yield i, part, area, ring


class _Pushing(_Reader):
    def pushFilters(self, filters: list) -> Iterator:
        known = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}
        for f in filters:
            if getattr(f, "attribute", None) == ("area",) and type(f) in known and f.value == f.value:
                self.tests.append((known[type(f)], f.value))
            else:
                yield f


class ShapefileSource(DataSource):
    """Format name polygons."""

    @classmethod
    def name(cls) -> str:
        return "polygons"

    def schema(self) -> str:
        return RING

    def reader(self, schema) -> _Reader:
        return (_Pushing if scans.pushes(self.options) else _Reader)(self.options)


def ring_edges(rings: DataFrame) -> DataFrame:
    """ring_id, segment_id, lon_a, lat_a, lon_b, lat_b: the sides of rings, sides without length left out."""
    at = rings.withColumn("ring_id", F.xxhash64("record", "part")).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("ring") - 2)))
    a, b = F.get("ring", F.col("k")), F.get("ring", F.col("k") + 1)
    e = at.select("ring_id", F.xxhash64("record", "part", "k").alias("segment_id"), a["lon"].alias("lon_a"), a["lat"].alias("lat_a"), b["lon"].alias("lon_b"), b["lat"].alias("lat_b"))
    return e.where("lon_a <> lon_b OR lat_a <> lat_b")
