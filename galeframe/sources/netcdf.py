"""NetCDF classic files (CDF-1, CDF-2 and CDF-5): header, hyperslabs as byte ranges, a data source, a writer.

    scans.opened(spark, netcdf.NetcdfSource, "surface.nc", {"latitude": (None, 10)}, variables="msl,u10,v10")

The header is read once, by the driver. A row is a cell: a column for each dimension (the value of
its coordinate variable, or the index where it has none), for each other variable along one of
these dimensions (such as lead_time along valid_time), and for each chosen variable. An input
partition is one index of the first dimension. Bounds of dimension columns and of variables along a
dimension, and comparisons with constants that Spark pushes (see `scans`), are turned into index
ranges, and only their bytes are read. Paths are names or URIs that pyarrow.fs opens; every executor
must reach them.

Values equal to _FillValue, missing_value or the type's default fill, or outside the valid range,
are null; scale_factor and add_offset are applied. NaN stays NaN. `cells` reads many small files,
one a row of a table.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from galeframe.sources import scans

# Fixed values of the format: types by number, tags of the header's lists, default fills by type.
TYPES = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8", 7: "u1", 8: "u2", 9: "u4", 10: "i8", 11: "u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
FILLS = {"i2": -32767, "i4": -2147483647, "f4": 9.969209968386869e36, "f8": 9.969209968386869e36, "u2": 65535, "u4": 4294967295, "i8": -9223372036854775806, "u8": 18446744073709551614}

#: Bytes that are read when a file is opened: its header, as a rule, and all of a small file.
HEAD = 1 << 14
#: Headers that a process keeps, since files of a run begin alike.
KNOWN = 16

Read = Callable[[int, int], bytes]


@dataclass
class Variable:
    """A variable's dimensions, type, attributes and place; stride: bytes from record to record, 0 without records."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    stride: int
    attributes: dict = field(default_factory=dict)

    @property
    def width(self) -> int:
        return int(self.kind[1])


@dataclass
class Header:
    version: int
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    length: int = 0


class _Cursor:
    """Reads a header front to back; asks for more bytes as it goes."""

    def __init__(self, read: Read, version: int):
        self.read, self.at, self.held, self.wide = read, 4, b"", ">q" if version == 5 else ">i"
        self.start = 4

    def take(self, n: int) -> bytes:
        while self.at + n > self.start + len(self.held):
            more = self.read(self.start + len(self.held), max(HEAD, n))
            if not more:
                raise ValueError("the header is cut off")
            self.held += more
        out = self.held[self.at - self.start : self.at - self.start + n]
        self.at += n
        return out

    def number(self, form: str | None = None) -> int:
        form = form or self.wide
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def items(self, tag: int) -> range:
        found, n = self.number(">i"), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("a list of the header has a wrong tag")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(ATTRIBUTE):
            name, kind, n = self.name(), TYPES[self.number(">i")], self.number()
            raw = self.padded(n * int(kind[1]))
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, f">{kind}").tolist()
        return out


def parse_header(read: Read, size: int) -> Header:
    """The header of a file of size bytes; read(offset, n) gives n bytes of it, or fewer at its end."""
    magic = read(0, 4)
    if len(magic) < 4 or magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF classic file")
    version = magic[3]
    c = _Cursor(read, version)
    records = c.number()
    dims = [(c.name(), c.number()) for _ in c.items(DIMENSION)]
    attributes = c.attributes()
    found = []
    for _ in c.items(VARIABLE):
        name = c.name()
        ids = [c.number() for _ in range(c.number())]
        own, kind = c.attributes(), TYPES[c.number(">i")]
        c.number()  # its size, which follows from its shape
        found.append((name, ids, own, kind, c.number(">i" if version == 1 else ">q")))
    record = next((k for k, (_, n) in enumerate(dims) if n == 0), None)
    is_record = lambda ids: bool(ids) and ids[0] == record
    slab = {name: int(np.prod([dims[i][1] for i in ids[1:]], dtype=np.int64)) * int(kind[1]) for name, ids, _, kind, _ in found if is_record(ids)}
    stride = sum(n + -n % 4 for n in slab.values()) if len(slab) > 1 else sum(slab.values())
    if records == -1:  # written as a stream: as many as fit
        first = min((b for name, ids, _, _, b in found if is_record(ids)), default=size)
        records = (size - first) // stride if stride else 0
    length = {k: records if k == record else n for k, (_, n) in enumerate(dims)}
    variables = {name: Variable(name, tuple(dims[i][0] for i in ids), tuple(length[i] for i in ids), kind, begin, stride if is_record(ids) else 0, own) for name, ids, own, kind, begin in found}
    return Header(version, {name: length[k] for k, (name, _) in enumerate(dims)}, attributes, variables, c.at)


_known: dict[tuple[bytes, int], Header] = {}


def _header(head: bytes, read: Read, size: int) -> Header:
    """parse_header of a file that begins with head; a header of the same bytes, in a file of the same size, is parsed once."""
    for (own, n), h in _known.items():
        if n == size and head.startswith(own):
            return h
    h = parse_header(read, size)
    if h.length <= len(head):
        while len(_known) >= KNOWN:
            del _known[next(iter(_known))]
        _known[head[: h.length], size] = h
    return h


def byte_ranges(v: Variable, chosen: Sequence[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(offset, bytes) of the stretches that hold the chosen indices of each dimension, in order; neighbours are joined."""
    if not v.shape:
        yield v.begin, v.width
        return
    if any(not len(c) for c in chosen):
        return
    steps = [v.width * math.prod(v.shape[k + 1 :]) for k in range(len(v.shape))]
    if v.stride:
        steps[0] = v.stride
    if v.stride and len(v.shape) == 1:  # one value a record
        yield from ((v.begin + i * v.stride, v.width) for i in chosen[0].tolist())
        return
    new = np.ones(len(chosen[-1]) + 1, bool)
    new[1:-1] = chosen[-1][1:] - chosen[-1][:-1] != 1
    cuts = new.nonzero()[0]
    at = np.array([v.begin])
    for c, step in zip((*chosen[:-1], chosen[-1][cuts[:-1]]), steps, strict=True):
        at = (at[:, None] + c * step).ravel()
    size = np.empty((len(at) // (len(cuts) - 1), len(cuts) - 1), np.int64)
    size[:] = (cuts[1:] - cuts[:-1]) * v.width
    size = size.ravel()
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + size[:-1]
    parts = new.nonzero()[0]
    yield from zip(at[parts].tolist(), np.add.reduceat(size, parts).tolist(), strict=True)


def raw_values(read: Read, v: Variable, chosen: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """The stored numbers at the chosen indices, all by default, as an array of their shape."""
    shape = v.shape if chosen is None else tuple(len(c) for c in chosen)
    if chosen is None and not v.stride:  # one stretch
        ranges = [(v.begin, v.width * math.prod(shape))]
    else:
        ranges = byte_ranges(v, [np.arange(n) for n in v.shape] if chosen is None else chosen)
    return _stored(read, v, ranges, shape)


def _stored(read: Read, v: Variable, ranges: Iterable[tuple[int, int]], shape: tuple[int, ...]) -> np.ndarray:
    held = b"".join([read(at, n) for at, n in ranges])
    if len(held) != v.width * math.prod(shape):
        raise ValueError(f"{v.name} is cut off")
    return np.frombuffer(held, f">{v.kind}").reshape(shape)


def _number(value) -> float | None:
    return None if value is None or isinstance(value, str) else float(value[0])


def _unpacked(raw: np.ndarray, v: Variable) -> tuple[np.ndarray, np.ndarray]:
    """Doubles of stored numbers, unpacked as the attributes say, and which are missing."""
    a = v.attributes
    if v.kind == "S1":
        raise ValueError(f"{v.name} holds text")
    x = raw.astype(float)
    gone = np.zeros(x.shape, bool)
    for fill in (*(a["missing_value"] if isinstance(a.get("missing_value"), list) else ()), a["_FillValue"][0] if isinstance(a.get("_FillValue"), list) else FILLS.get(v.kind)):
        if fill is not None:
            gone |= raw == np.array(fill).astype(f">{v.kind}")
    low, high = a.get("valid_range") or (_number(a.get("valid_min")), _number(a.get("valid_max")))
    if low is not None:
        gone |= x < low
    if high is not None:
        gone |= x > high
    scale, offset = _number(a.get("scale_factor")), _number(a.get("add_offset"))
    if scale is not None:
        x = x * scale
    return x if offset is None else x + offset, gone


def values(read: Read, v: Variable, chosen: Sequence[np.ndarray] | None = None) -> np.ma.MaskedArray:
    """Doubles with missing ones masked, unpacked as the attributes say."""
    return np.ma.masked_array(*_unpacked(raw_values(read, v, chosen), v))


def filled(read: Read, variables: Sequence[Variable], chosen: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Doubles of each variable at the chosen indices, NaN for missing ones; where variables are laid out alike, the stretches to read are worked out once."""
    out, shape = [], tuple(len(c) for c in chosen)
    alike: dict[tuple, list[tuple[int, int]]] = {}
    for v in variables:
        layout = v.shape, v.kind, v.stride
        if layout not in alike:
            alike[layout] = [(at - v.begin, n) for at, n in byte_ranges(v, chosen)]
        x, gone = _unpacked(_stored(read, v, [(v.begin + at, n) for at, n in alike[layout]], shape), v)
        x[gone] = np.nan
        out.append(x)
    return out


class File:
    """An open file: read(offset, n), its size and header; column(name) keeps what it read. bytes_read counts what was asked for after the header. Its first bytes, which the header came with, are kept and not read again."""

    def __init__(self, path: str):
        fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        self.head = self.file.read_at(min(HEAD, self.size), 0)
        self.header = _header(self.head, self._bytes, self.size)
        self.bytes_read = 0
        self._columns: dict[str, np.ndarray] = {}

    def column(self, name: str) -> np.ndarray:
        """All values of a small variable such as an axis, missing ones NaN; read once."""
        if name not in self._columns:
            self._columns[name] = values(self.read, self.header.variables[name]).filled(np.nan)
        return self._columns[name]

    def read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self._bytes(at, n)

    def _bytes(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        return self.head[at : at + n] if at + n <= len(self.head) else self.file.read_at(n, at)

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


# -- time -----------------------------------------------------------------------------------------

_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
_UNITS |= {"us": 1, "ms": 1000, "s": 10**6, "sec": 10**6, "min": 60 * 10**6, "h": 3600 * 10**6, "hr": 3600 * 10**6, "d": 86400 * 10**6}
CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


def _julian_days(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a date in the Julian calendar."""
    y, m = (y - 1, m + 12) if m < 3 else (y, m)
    return y * 365 + y // 4 + (153 * (m - 3) + 2) // 5 + d - 719471


@lru_cache(maxsize=256)
def time_origin(units: str, calendar: str = "standard") -> tuple[int, int]:
    """(microseconds of a step, microseconds of the origin since 1970) of units such as "hours since 1900-01-01 00:00"; standard dates before 1582-10-15 are Julian."""
    if calendar not in CALENDARS:
        raise ValueError(f"unsupported calendar: {calendar}")
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[ T]+(\d+):(\d+)(?::(\d+(?:\.\d+)?))?)?\s*(Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?\s*", units)
    step = _UNITS.get(m[1].lower()) or _UNITS.get(m[1].lower() + "s") if m else None
    if not step:
        raise ValueError(f"unsupported time units: {units}")
    y, mo, d = int(m[2]), int(m[3]), int(m[4])
    julian = calendar != "proleptic_gregorian" and (y, mo, d) < (1582, 10, 15)
    days = _julian_days(y, mo, d) if julian else (date(y, mo, d) - date(1970, 1, 1)).days
    us = days * 86400 * 10**6 + int(m[5] or 0) * 3600 * 10**6 + int(m[6] or 0) * 60 * 10**6 + round(float(m[7] or 0) * 10**6)
    if m[8] and m[8][0] in "+-":
        digits = m[8][1:].replace(":", "")
        hours, minutes = (int(digits[:-2]), int(digits[-2:])) if len(digits) > 2 else (int(digits), 0)
        us -= (1 if m[8][0] == "+" else -1) * (hours * 60 + minutes) * 60 * 10**6
    return step, us


def date2num(when: datetime, units: str, calendar: str = "standard") -> float:
    """A time (UTC, from 1582-10-15 on) in these units."""
    step, origin = time_origin(units, calendar)
    return ((when - datetime(1970, 1, 1)) // timedelta(microseconds=1) - origin) / step


def num2date(value: float, units: str, calendar: str = "standard") -> datetime:
    """The time (UTC, from 1582-10-15 on) that a number in these units means, to the microsecond."""
    step, origin = time_origin(units, calendar)
    return datetime(1970, 1, 1) + timedelta(microseconds=origin + round(value * step))


# -- data source ----------------------------------------------------------------------------------


def _columns(h: Header, names: Sequence[str]) -> tuple[tuple[str, ...], list[Variable], list[Variable]]:
    """(dimensions, other variables along one of them, chosen variables); the chosen ones must share their dimensions."""
    lacking = [n for n in names if n not in h.variables]
    if lacking:
        raise ValueError(f"no variable {', '.join(lacking)}")
    chosen = [h.variables[n] for n in names]
    if len({v.dims for v in chosen}) != 1 or not chosen[0].dims:
        raise ValueError("the chosen variables must have the same dimensions, one at least")
    dims = chosen[0].dims
    along = [v for v in h.variables.values() if len(v.dims) == 1 and v.dims[0] in dims and v.name not in dims and v.kind != "S1" and v.name not in names]
    return dims, along, chosen


def _axes(f: File, dims: Sequence[str]) -> dict[str, np.ndarray]:
    """The values of each dimension's column; missing ones are NaN."""
    own = f.header.variables
    return {d: values(f.read, own[d]).filled(np.nan) if d in own and own[d].dims == (d,) and own[d].kind != "S1" else np.arange(f.header.dims[d], dtype=float) for d in dims}


def _batches(f: File, names: Sequence[str], index: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the cells at the chosen indices: one index of all dimensions but the last two at a time."""
    dims, along, chosen = _columns(f.header, names)
    axes = _axes(f, dims)
    others = {v.name: (v.dims[0], values(f.read, v)) for v in along}
    outer, inner = dims[:-2], dims[-2:]
    for at in product(*(index[d].tolist() for d in outer)):
        pick = {d: np.array([i]) for d, i in zip(outer, at, strict=True)} | {d: index[d] for d in inner}
        grid = dict(zip(dims, np.meshgrid(*(pick[d] for d in dims), indexing="ij"), strict=True))
        out = {d: axes[d][grid[d].ravel()] for d in dims}
        out |= {name: column[grid[d].ravel()] for name, (d, column) in others.items()}
        yield out | {v.name: values(f.read, v, [pick[d] for d in dims]).ravel() for v in chosen}


def _record_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ma.getdata(c), pa.float64(), mask=np.ma.getmaskarray(c)) for c in columns.values()], names=list(columns))


class _Index(InputPartition):
    def __init__(self, index: dict[str, np.ndarray]):
        self.index = index


class AxisBounds(DataSourceReader):
    """Turns bounds into chosen indices: of names (dimension, values along it) for each column that may be filtered, keep marks the indices left."""

    of: dict[str, tuple[str, np.ndarray]]
    keep: dict[str, np.ndarray]

    def bound(self, bounds: dict[str, tuple[float, float]]) -> None:
        """Keep the indices within bounds; missing values are within none."""
        for name, (lo, hi) in bounds.items():
            if name not in self.of:
                raise ValueError(f"no bounds of {name}: it is no column of a dimension")
            d, column = self.of[name]
            self.keep[d] &= (column >= lo) & (column <= hi)


class AxisFilters(AxisBounds):
    """Takes comparisons that Spark pushes as well."""

    def pushFilters(self, filters: list) -> Iterator:
        tests = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.of or type(f) not in (*tests, In):
                yield f
                continue
            d, column = self.of[name]
            hit = np.isin(column, [x for x in f.value if x is not None]) if isinstance(f, In) else tests[type(f)](column, f.value)
            self.keep[d] &= hit
            if np.isnan(column).any():  # missing or NaN: Spark has the last word
                self.keep[d] |= np.isnan(column)
                yield f


class _Reader(AxisBounds):
    def __init__(self, path: str, names: Sequence[str], bounds: dict[str, tuple[float, float]]):
        self.path, self.names = path, list(names)
        with File(path) as f:
            dims, along, _ = _columns(f.header, names)
            self.dims, self.axes = dims, _axes(f, dims)
            self.of = {d: (d, self.axes[d]) for d in dims} | {v.name: (v.dims[0], values(f.read, v).filled(np.nan)) for v in along}
        self.keep = {d: np.ones(len(a), bool) for d, a in self.axes.items()}
        self.bound(bounds)

    def partitions(self) -> list[_Index]:
        index = {d: np.flatnonzero(k) for d, k in self.keep.items()}
        first = self.dims[0]
        return [_Index(index | {first: index[first][k : k + 1]}) for k in range(len(index[first]))] or [_Index({d: i[:0] for d, i in index.items()})]

    def read(self, partition: _Index) -> Iterator[pa.RecordBatch]:
        with File(self.path) as f:
            for columns in _batches(f, self.names, partition.index):
                yield _record_batch(columns)


class _Pushing(AxisFilters, _Reader):
    pass


class NetcdfSource(DataSource):
    """Format name netcdf; option variables: names with commas, by default all variables with the most dimensions."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _names(self) -> list[str]:
        if self.options.get("variables"):
            return [n.strip() for n in self.options["variables"].split(",")]
        with File(self.options["path"]) as f:
            own = [v for v in f.header.variables.values() if v.kind != "S1"]
        most = max((len(v.dims) for v in own), default=0)
        return [v.name for v in own if len(v.dims) == most]

    def schema(self) -> str:
        with File(self.options["path"]) as f:
            dims, along, chosen = _columns(f.header, self._names())
        return ", ".join(f"`{n}` double" for n in [*dims, *(v.name for v in along), *(v.name for v in chosen)])

    def reader(self, schema) -> _Reader:
        return (_Pushing if scans.pushes(self.options) else _Reader)(self.options["path"], self._names(), scans.bounds_of(self.options))


def cells(files: DataFrame, variables: Sequence[str], columns: Sequence[str], path: str = "path") -> DataFrame:
    """The cells of many files, one a row of a table: its path with columns (dimensions, variables along them, the chosen variables), read where the row lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                with File(p) as f:
                    dims, _, _ = _columns(f.header, variables)
                    for found in _batches(f, variables, {d: np.arange(f.header.dims[d]) for d in dims}):
                        out = _record_batch({c: found[c] for c in columns})
                        yield pa.RecordBatch.from_arrays([pa.array([p] * out.num_rows, pa.string()), *out.columns], names=[path, *columns])

    return files.select(path).mapInArrow(run, f"`{path}` string, " + ", ".join(f"`{c}` double" for c in columns))


# -- writing --------------------------------------------------------------------------------------


def encoded(dims: dict[str, int], variables: dict[str, tuple[Sequence[str], np.ndarray, dict]], attributes: dict | None = None, version: int = 2, record: str | None = None) -> bytes:
    """A file's bytes. variables: name -> (dimensions, array, attributes); record: the dimension that may grow, first in its variables."""
    form = ">q" if version == 5 else ">i"
    number = lambda n, f=None: struct.pack(f or form, n)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: number(len(s.encode())) + pad(s.encode())
    code = {k: n for n, k in TYPES.items()}
    kind_of = lambda a: "S1" if a.dtype.kind == "S" else a.dtype.str[1:]

    def attribute_list(held: dict) -> bytes:
        out = [number(ATTRIBUTE if held else 0, ">i") + number(len(held))]
        for k, value in held.items():
            if isinstance(value, str):
                out.append(name(k) + number(2, ">i") + number(len(value.encode())) + pad(value.encode()))
            else:
                a = np.atleast_1d(np.asarray(value))
                out.append(name(k) + number(code[kind_of(a)], ">i") + number(len(a)) + pad(a.astype(a.dtype.newbyteorder(">")).tobytes()))
        return b"".join(out)

    ids = {d: k for k, d in enumerate(dims)}
    raw = {n: np.asarray(a) for n, (_, a, _) in variables.items()}
    is_record = {n: record is not None and tuple(d)[:1] == (record,) for n, (d, _, _) in variables.items()}
    slab = {n: a.nbytes // max(1, dims[record]) if is_record[n] else a.nbytes for n, a in raw.items()}
    single = sum(is_record.values()) == 1
    room = {n: slab[n] if is_record[n] and single else slab[n] + -slab[n] % 4 for n in raw}

    # the header in parts: all before the place of a variable, which follows from their length
    place = 4 if version == 1 else 8
    own = b"".join([b"CDF", bytes([version]), number(dims[record] if record else 0), number(DIMENSION if dims else 0, ">i"), number(len(dims)), *(name(d) + number(0 if d == record else n) for d, n in dims.items()), attribute_list(attributes or {}), number(VARIABLE if variables else 0, ">i"), number(len(variables))])
    said = {n: name(n) + number(len(d)) + b"".join(number(ids[x]) for x in d) + attribute_list(a) + number(code[kind_of(raw[n])], ">i") + number(room[n]) for n, (d, _, a) in variables.items()}
    at, begins = len(own) + sum(len(b) + place for b in said.values()), {}
    for n in sorted(raw, key=lambda n: is_record[n]):
        begins[n] = at
        at += room[n]
    big = {n: a.astype(a.dtype.newbyteorder(">")) for n, a in raw.items()}
    header = own + b"".join(b + number(begins[n], ">i" if version == 1 else ">q") for n, b in said.items())
    out = [header, *(big[n].tobytes() + b"\0" * (room[n] - slab[n]) for n in raw if not is_record[n])]
    for k in range(dims[record] if record else 0):
        out += [big[n][k : k + 1].tobytes() + b"\0" * (room[n] - slab[n]) for n in raw if is_record[n]]
    return b"".join(out)


def write(path: str, content: bytes) -> None:
    """Put a file in place whole: under another name first, so that a lost task leaves no half of it."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{abs(hash((at, datetime.now()))):x}"
    with fs.open_output_stream(part) as f:
        f.write(content)
    fs.move(part, at)
