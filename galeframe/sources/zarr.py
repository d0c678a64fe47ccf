"""Chunked arrays (Zarr, version 2): metadata, codecs, a data source, a sink.

    scans.opened(spark, zarr.ZarrSource, "forecast.zarr", {"latitude": (None, 10)}, variables="msl,u10")

A row is a cell: a column for each dimension (the value of its coordinate array, or the index where
it has none), for each other one-dimensional array along one of these dimensions, and for each
chosen array. The chosen arrays must have the same dimensions, named by _ARRAY_DIMENSIONS. An input
partition is a chunk of the first chosen array; bounds of dimension columns and pushed comparisons
(see `scans`) choose indices, and chunks without a chosen index are never opened. Absent chunks, fill values,
_FillValue and missing_value are null, scale_factor and add_offset are applied, NaN stays NaN unless
it is the fill value.

Codecs: none, zlib, gzip, bz2, lzma of the standard library's form, zstd, and the filter shuffle.
Another codec, type or version raises, naming it. `write` stores a table of cells, a chunk a task.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition

from galeframe.sources import netcdf, scans


class Store:
    """A folder of keys, by a name or a URI that pyarrow.fs opens; opened counts the keys whose bytes were read."""

    def __init__(self, path: str):
        self.fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.root, self.opened = at.rstrip("/"), 0

    def get(self, key: str) -> bytes | None:
        """The bytes of a key, None where there is none; other failures raise."""
        info = self.fs.get_file_info(f"{self.root}/{key}")
        if info.type == pyarrow.fs.FileType.NotFound:
            return None
        self.opened += 1
        with self.fs.open_input_file(f"{self.root}/{key}") as f:
            return f.read()

    def arrays(self) -> list[str]:
        """Names of the folder's arrays, sorted."""
        under = self.fs.get_file_info(pyarrow.fs.FileSelector(self.root))
        return sorted(i.base_name for i in under if i.type == pyarrow.fs.FileType.Directory and self.fs.get_file_info(f"{i.path}/.zarray").type == pyarrow.fs.FileType.File)


def _unshuffled(data: bytes, size: int) -> bytes:
    whole = len(data) // size * size
    return np.frombuffer(data[:whole], np.uint8).reshape(size, -1).T.tobytes() + data[whole:]


def _shuffled(data: bytes, size: int) -> bytes:
    whole = len(data) // size * size
    return np.frombuffer(data[:whole], np.uint8).reshape(-1, size).T.tobytes() + data[whole:]


def decompressed(data: bytes, codec: dict) -> bytes:
    """What codec (its JSON entry) made data of."""
    kind = codec.get("id")
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == "shuffle":
        return _unshuffled(data, int(codec.get("elementsize", 4)))
    known = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}
    if kind not in known:
        raise ValueError(f"unknown codec {kind}")
    return known[kind](data)


def compressed(data: bytes, codec: dict) -> bytes:
    """data as `decompressed` takes it."""
    kind, level = codec.get("id"), codec.get("level")
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level or 3).compress(data)
    if kind == "shuffle":
        return _shuffled(data, int(codec.get("elementsize", 4)))
    known = {"zlib": lambda b: zlib.compress(b, 1 if level is None else level), "gzip": lambda b: gzip.compress(b, 1 if level is None else level, mtime=0), "bz2": bz2.compress, "lzma": lzma.compress}
    if kind not in known:
        raise ValueError(f"unknown codec {kind}")
    return known[kind](data)


@dataclass
class Array:
    """An array's metadata, as .zarray and .zattrs hold it."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    order: str = "C"
    fill: float | int | None = None
    compressor: dict | None = None
    filters: tuple[dict, ...] = ()
    separator: str = "."
    attributes: dict = field(default_factory=dict)

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(self.attributes.get("_ARRAY_DIMENSIONS", ()))

    @classmethod
    def load(cls, store: Store, name: str) -> Array:
        raw = store.get(f"{name}/.zarray")
        if raw is None:
            raise ValueError(f"no array {name}")
        m, own = json.loads(raw), store.get(f"{name}/.zattrs")
        if m.get("zarr_format") != 2:
            raise ValueError(f"{name}: format {m.get('zarr_format')} is not read")
        kind = np.dtype(m["dtype"]) if isinstance(m["dtype"], str) else None
        if kind is None or kind.kind not in "biuf":
            raise ValueError(f"{name}: type {m['dtype']} is not read")
        fill = m.get("fill_value")
        fill = float(fill) if isinstance(fill, str) else fill  # NaN, Infinity, -Infinity are written as text
        shape, chunks = tuple(m["shape"]), tuple(m["chunks"])
        if len(shape) != len(chunks) or min(chunks, default=1) < 1 or m.get("order", "C") not in ("C", "F"):
            raise ValueError(f"{name}: shape, chunks or order do not fit")
        return cls(name, shape, chunks, kind, m.get("order", "C"), fill, m.get("compressor"), tuple(m.get("filters") or ()), m.get("dimension_separator", "."), json.loads(own) if own else {})

    def metadata(self) -> dict:
        fill = self.fill
        if isinstance(fill, float) and not math.isfinite(fill):
            fill = "NaN" if math.isnan(fill) else "Infinity" if fill > 0 else "-Infinity"
        return {"zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": self.dtype.str, "order": self.order, "fill_value": fill, "compressor": self.compressor, "filters": list(self.filters) or None, "dimension_separator": self.separator}

    def key(self, place: Sequence[int]) -> str:
        return f"{self.name}/{self.separator.join(map(str, place)) or '0'}"

    def encoded(self, block: np.ndarray) -> bytes:
        """The bytes of a whole chunk."""
        data = np.asarray(block, self.dtype).tobytes(order=self.order)
        for codec in (*self.filters, *([self.compressor] if self.compressor else ())):
            data = compressed(data, codec)
        return data

    def chunk(self, store: Store, place: Sequence[int]) -> np.ndarray | None:
        """The stored numbers of a chunk, beyond the array's edge included; None where it is absent."""
        data = store.get(self.key(place))
        if data is None:
            return None
        for codec in (*([self.compressor] if self.compressor else ()), *reversed(self.filters)):
            data = decompressed(data, codec)
        if len(data) != self.dtype.itemsize * math.prod(self.chunks):
            raise ValueError(f"chunk {self.key(place)} has {len(data)} bytes")
        return np.frombuffer(data, self.dtype).reshape(self.chunks, order=self.order)


def values(store: Store, a: Array, chosen: Sequence[np.ndarray] | None = None) -> np.ma.MaskedArray:
    """Doubles at the chosen indices of each dimension, all by default, with missing ones masked; only chunks that hold a chosen index are opened."""
    chosen = [np.arange(n) for n in a.shape] if chosen is None else [np.asarray(c, int) for c in chosen]
    raw = np.zeros(tuple(len(c) for c in chosen), a.dtype)
    gone = np.zeros(raw.shape, bool)
    for place in product(*(np.unique(c // n).tolist() for c, n in zip(chosen, a.chunks, strict=True))):
        to = [np.flatnonzero(c // n == k) for c, n, k in zip(chosen, a.chunks, place, strict=True)]
        block = a.chunk(store, place)
        if block is None:
            gone[np.ix_(*to)] = True
        else:
            raw[np.ix_(*to)] = block[np.ix_(*(c[t] - k * n for c, t, k, n in zip(chosen, to, place, a.chunks, strict=True)))]
    x = raw.astype(float)
    for name in ("fill", "_FillValue", "missing_value"):
        fill = a.fill if name == "fill" else a.attributes.get(name)
        for one in np.atleast_1d(np.array([] if fill is None else fill, dtype=float)):
            gone |= np.isnan(x) if math.isnan(one) else x == one
    scale, offset = a.attributes.get("scale_factor", 1.0), a.attributes.get("add_offset", 0.0)
    return np.ma.masked_array(x * scale + offset if (scale, offset) != (1.0, 0.0) else x, gone)


# -- data source ----------------------------------------------------------------------------------


def _columns(store: Store, names: Sequence[str]) -> tuple[tuple[str, ...], list[Array], list[Array], dict[str, Array]]:
    """(dimensions, other arrays along one of them, chosen arrays, coordinates of dimensions)."""
    own = {n: Array.load(store, n) for n in store.arrays()}
    lacking = [n for n in names if n not in own]
    if lacking:
        raise ValueError(f"no array {', '.join(lacking)}")
    chosen = [own[n] for n in names]
    if len({(a.dims, a.shape) for a in chosen}) != 1 or not chosen[0].shape or len(chosen[0].dims) != len(chosen[0].shape):
        raise ValueError("the chosen arrays must have the same named dimensions and shape, one dimension at least")
    dims, shape = chosen[0].dims, chosen[0].shape
    line = {n: a for n, a in own.items() if n not in names and len(a.shape) == 1 and a.dims and a.dims[0] in dims and a.shape[0] == shape[dims.index(a.dims[0])]}
    axes = {d: line[d] for d in dims if d in line and line[d].dims == (d,)}
    return dims, [a for n, a in line.items() if n not in dims], chosen, axes


class _Chunk(InputPartition):
    def __init__(self, index: list[np.ndarray]):
        self.index = index


class _Reader(netcdf.AxisBounds):
    def __init__(self, path: str, names: Sequence[str], bounds: dict[str, tuple[float, float]]):
        self.path, store = path, Store(path)
        self.dims, self.along, self.chosen, axes = _columns(store, names)
        length = dict(zip(self.dims, self.chosen[0].shape, strict=True))
        self.of = {d: (d, values(store, axes[d]).filled(np.nan) if d in axes else np.arange(float(length[d]))) for d in self.dims}
        self.columns = {a.name: (a.dims[0], values(store, a)) for a in self.along}
        self.of |= {n: (d, x.filled(np.nan)) for n, (d, x) in self.columns.items()}
        self.keep = {d: np.ones(n, bool) for d, n in length.items()}
        self.bound(bounds)

    def partitions(self) -> list[_Chunk]:
        index = [np.flatnonzero(self.keep[d]) for d in self.dims]
        parts = [[i[i // n == k] for k in np.unique(i // n)] for i, n in zip(index, self.chosen[0].chunks, strict=True)]
        return [_Chunk(list(p)) for p in product(*parts)] or [_Chunk([i[:0] for i in index])]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        store, index = Store(self.path), partition.index
        grid = dict(zip(self.dims, (g.ravel() for g in np.meshgrid(*index, indexing="ij")), strict=True))
        out = {d: self.of[d][1][grid[d]] for d in self.dims} | {n: x[grid[d]] for n, (d, x) in self.columns.items()}
        out |= {a.name: values(store, a, index).ravel() for a in self.chosen}
        yield pa.RecordBatch.from_arrays([pa.array(np.ma.getdata(c), pa.float64(), mask=np.ma.getmaskarray(c)) for c in out.values()], names=list(out))


class _Pushing(netcdf.AxisFilters, _Reader):
    pass


class ZarrSource(DataSource):
    """Format name zarr; option variables: names with commas, by default all arrays with the most dimensions."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _names(self) -> list[str]:
        if self.options.get("variables"):
            return [n.strip() for n in self.options["variables"].split(",")]
        store = Store(self.options["path"])
        own = [Array.load(store, n) for n in store.arrays()]
        most = max((len(a.shape) for a in own), default=0)
        return [a.name for a in own if len(a.shape) == most]

    def schema(self) -> str:
        dims, along, chosen, _ = _columns(Store(self.options["path"]), self._names())
        return ", ".join(f"`{n}` double" for n in [*dims, *(a.name for a in along), *(a.name for a in chosen)])

    def reader(self, schema) -> _Reader:
        return (_Pushing if scans.pushes(self.options) else _Reader)(self.options["path"], self._names(), scans.bounds_of(self.options))


# -- writing --------------------------------------------------------------------------------------


def write(cells: DataFrame, path: str, arrays: Sequence[Array], index: Sequence[str]) -> None:
    """Store the columns named as arrays from rows of cells, a place in index columns (from 0) for each dimension.

    All arrays share their shape and chunks. One shuffle brings a chunk's cells to one task, which
    holds that chunk only; the driver writes metadata. Nulls and places without a row become the
    fill value, chunks without a row are left absent; a place outside the shape or given twice
    raises. A chunk is put in place whole, so that a task that runs again writes the same bytes.
    """
    first = arrays[0]
    if any((a.shape, a.chunks) != (first.shape, first.chunks) for a in arrays) or len(index) != len(first.shape):
        raise ValueError("arrays of one table must have the same shape and chunks, with an index column for each dimension")
    names, parts = [a.name for a in arrays], [f"_c{k}" for k in range(len(index))]
    netcdf.write(f"{path}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    for a in arrays:
        netcdf.write(f"{path}/{a.name}/.zarray", json.dumps(a.metadata()).encode())
        netcdf.write(f"{path}/{a.name}/.zattrs", json.dumps(a.attributes).encode())

    def store(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = [rows[f"_i{k}"].to_numpy(int) - c * n for k, (c, n) in enumerate(zip(key, first.chunks, strict=True))]
        if len(np.unique(np.ravel_multi_index(at, first.chunks))) < len(rows):
            raise ValueError(f"a place of chunk {key} has more than one row")
        for k, a in enumerate(arrays):
            fill = 0 if a.fill is None else a.fill
            block = np.full(a.chunks, fill, a.dtype)
            given = rows[f"_v{k}"].to_numpy(float)
            block[tuple(at)] = np.where(np.isnan(given), fill, given).astype(a.dtype)
            netcdf.write(f"{path}/{a.key(key)}", a.encoded(block))
        return pd.DataFrame({"chunks": [len(arrays)]})

    inside = F.lit(True)
    for c, n in zip(index, first.shape, strict=True):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    ok = F.when(F.coalesce(inside, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a place lies outside the shape")).cast("boolean"))
    place = [F.col(c).cast("long").alias(f"_i{k}") for k, c in enumerate(index)]
    chunk = [F.floor(F.col(c) / F.lit(n)).cast("long").alias(p) for c, n, p in zip(index, first.chunks, parts, strict=True)]
    put = cells.where(ok).select(*place, *chunk, *[F.col(n).cast("double").alias(f"_v{k}") for k, n in enumerate(names)])
    put.groupBy(*parts).applyInPandas(store, "chunks int").agg(F.sum("chunks")).collect()
