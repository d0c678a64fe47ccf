"""Chunked arrays: files written by hand, chunks opened, codecs, the sink, adapters."""

import itertools
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.sources import adapters, netcdf, scans, zarr


def array(name, shape, chunks, dtype="<f4", dims="xyz", **other):
    own = other.pop("attributes", {})
    return zarr.Array(name, shape, chunks, np.dtype(dtype), attributes={"_ARRAY_DIMENSIONS": list(dims[: len(shape)])} | own, **other)


def put(root, a, x, absent=()):
    """The array by hand: every chunk padded to its full shape."""
    folder = root / a.name
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps(a.metadata()))
    (folder / ".zattrs").write_text(json.dumps(a.attributes))
    for place in itertools.product(*(range(-(-n // c)) for n, c in zip(a.shape, a.chunks, strict=True))):
        if place in absent:
            continue
        block = np.zeros(a.chunks, a.dtype)
        part = x[tuple(slice(k * c, (k + 1) * c) for k, c in zip(place, a.chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        at = root / a.key(place)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(a.encoded(block))


CODECS = [None, {"id": "zlib", "level": 6}, {"id": "gzip"}, {"id": "bz2"}, {"id": "lzma"}, {"id": "zstd", "level": 1}]


@pytest.mark.parametrize("order,codec,shuffle,kind,separator", [(o, c, s, k, p) for o, c, s, k, p in zip(itertools.cycle("CF"), CODECS * 2, [True, False, False] * 4, itertools.cycle(["<f4", ">f8", "<i2", "|u1", ">i4"]), [".", "/"] * 6, strict=False)])
def test_orders_codecs_types(tmp_path, order, codec, shuffle, kind, separator):
    x = np.arange(5 * 7 * 3).reshape(5, 7, 3).astype(kind)
    a = array("v", x.shape, (2, 3, 2), kind, order=order, compressor=codec, separator=separator, filters=({"id": "shuffle", "elementsize": np.dtype(kind).itemsize},) if shuffle else ())
    put(tmp_path, a, x)
    store = zarr.Store(str(tmp_path))
    loaded = zarr.Array.load(store, "v")
    assert loaded == a and (zarr.values(store, loaded) == x).all()
    rng = np.random.default_rng(1)
    for _ in range(5):
        pick = [np.sort(rng.choice(n, rng.integers(0, n + 1), replace=False)) for n in x.shape]
        assert (zarr.values(store, loaded, pick).filled(-1) == x[np.ix_(*pick)]).all()


def test_bytes_of_a_store_made_elsewhere(tmp_path):
    """A chunk in Fortran order, little-endian shorts, compressed: its bytes are given here and not by the writer."""
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / ".zarray").write_text('{"zarr_format": 2, "shape": [2, 3], "chunks": [2, 3], "dtype": "<i2", "order": "F", "fill_value": 4, "compressor": {"id": "zlib", "level": 1}, "filters": [{"id": "shuffle", "elementsize": 2}]}')
    stored = bytes([1, 4, 2, 5, 3, 6]) + bytes(6)  # low bytes, then high bytes, column by column
    (tmp_path / "v" / "0.0").write_bytes(zlib.compress(stored))
    store = zarr.Store(str(tmp_path))
    got = zarr.values(store, zarr.Array.load(store, "v"))
    assert got.filled(-1).tolist() == [[1, 2, 3], [-1, 5, 6]]


def test_fill_and_packing(tmp_path):
    x = np.array([[1.0, np.nan, -9.0], [4.0, 5.0, 7.0]])
    for fill, absent, want in ((None, (), [1.0, "nan", None, 4.0, 5.0, None]), (float("nan"), ((1, 0),), [1.0, None, None, None, None, None]), (5.0, (), [1.0, "nan", None, 4.0, None, None])):
        root = tmp_path / str(fill)
        a = array("v", (2, 3), (1, 3), "<f8", fill=fill, attributes={"_FillValue": -9.0, "missing_value": [7.0]})
        put(root, a, x, absent)
        store = zarr.Store(str(root))
        got = zarr.values(store, zarr.Array.load(store, "v"))
        assert [None if m else "nan" if np.isnan(v) else v for v, m in zip(got.data.ravel(), np.ma.getmaskarray(got).ravel(), strict=True)] == want
    a = array("v", (2,), (2,), "<i2", attributes={"scale_factor": 0.5, "add_offset": 10})
    put(tmp_path / "packed", a, np.array([2, 4]))
    store = zarr.Store(str(tmp_path / "packed"))
    assert zarr.values(store, zarr.Array.load(store, "v")).tolist() == [11.0, 12.0]


@pytest.mark.parametrize("change,why", [({"compressor": {"id": "blosc"}}, "blosc"), ({"filters": [{"id": "delta"}]}, "delta"), ({"dtype": "<M8[ns]"}, "M8"), ({"dtype": [["a", "<f4"]]}, "type"), ({"zarr_format": 3}, "format 3"), ({"order": "X"}, "order"), ({"chunks": [2]}, "shape"), ({"chunks": [2, 0]}, "chunks")])
def test_what_is_not_read_raises_by_name(tmp_path, change, why):
    a = array("v", (2, 2), (2, 2))
    put(tmp_path, a, np.zeros((2, 2)))
    (tmp_path / "v" / ".zarray").write_text(json.dumps(a.metadata() | change))
    store = zarr.Store(str(tmp_path))
    with pytest.raises(ValueError, match=why):
        zarr.values(store, zarr.Array.load(store, "v"))


def test_short_chunk_and_absent_array(tmp_path):
    put(tmp_path, array("v", (2, 2), (2, 2)), np.zeros((2, 2)))
    (tmp_path / "v" / "0.0").write_bytes(b"123")
    store = zarr.Store(str(tmp_path))
    with pytest.raises(ValueError, match="3 bytes"):
        zarr.values(store, zarr.Array.load(store, "v"))
    with pytest.raises(ValueError, match="no array w"):
        zarr.Array.load(store, "w")


def a_store(root):
    x = np.arange(6 * 7, dtype=float).reshape(6, 7)
    put(root, array("lat", (6,), (4,), "<f4", ["lat"]), np.linspace(10, 5, 6))
    put(root, array("hour", (6,), (6,), "<i4", ["lat"]), np.arange(6) * 6)
    put(root, array("v", (6, 7), (2, 3), "<f8", ["lat", "lon"]), x)
    put(root, array("w", (6, 7), (4, 4), "<f8", ["lat", "lon"], compressor={"id": "gzip"}), -x)
    return x


def test_source(spark, tmp_path):
    x = a_store(tmp_path)
    scans.register(spark, zarr.ZarrSource, pushdown=True)
    df = spark.read.format("zarr").option("pushdown", True).load(str(tmp_path))
    assert df.columns == ["lat", "lon", "hour", "v", "w"] and df.rdd.getNumPartitions() == 9
    want = {(10.0 - i, float(j), 6.0 * i, x[i, j], -x[i, j]) for i in range(6) for j in range(7)}
    assert {tuple(r) for r in df.collect()} == want
    near = df.where("lat <= 7 AND lat > 5 AND lon IN (5.0, 6.0)")
    assert {tuple(r) for r in near.collect()} == {r for r in want if 5 < r[0] <= 7 and r[1] >= 5}
    assert near.rdd.getNumPartitions() == 4
    assert df.where("hour = 12").select("v").rdd.getNumPartitions() == 3
    assert df.where("hour > 99").count() == 0 and df.where("v > 40").count() == 1
    assert spark.read.format("zarr").option("variables", "w").load(str(tmp_path)).rdd.getNumPartitions() == 4
    for bad in ("v,nothing", "v,lat"):
        with pytest.raises(Exception, match="no array|same named"):
            spark.read.format("zarr").option("variables", bad).load(str(tmp_path)).collect()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_uses_of_one_table_do_not_disturb_each_other(spark, tmp_path):
    a_store(tmp_path)
    df = scans.opened(spark, zarr.ZarrSource, str(tmp_path))
    few = df.where("lat <= 7 AND lat > 5")
    assert (df.count(), few.count(), df.count(), few.unionByName(df).count()) == (42, 14, 42, 56)
    near = scans.opened(spark, zarr.ZarrSource, str(tmp_path), {"lat": (5.5, 7), "lon": (5, None), "hour": (None, 24)}, variables="v")
    assert near.rdd.getNumPartitions() == 4 and sorted((r.lat, r.lon) for r in near.collect()) == [(6.0, 5.0), (6.0, 6.0), (7.0, 5.0), (7.0, 6.0)]
    with pytest.raises(Exception, match="no bounds of v"):
        scans.opened(spark, zarr.ZarrSource, str(tmp_path), {"v": (0, 1)}).count()


def test_only_touched_chunks_are_opened(tmp_path):
    x = a_store(tmp_path)
    store = zarr.Store(str(tmp_path))
    a = zarr.Array.load(store, "v")
    store.opened = 0
    assert (zarr.values(store, a, [np.array([1, 2]), np.array([0, 6])]) == x[np.ix_([1, 2], [0, 6])]).all() and store.opened == 4


def test_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    cells = spark.createDataFrame([(0, 0, 1.0, 1), (0, 4, None, 2), (2, 1, float("nan"), 3), (5, 4, 9.0, 4)], "i int, j int, v double, w int")
    arrays = [array("v", (6, 5), (2, 2), "<f8", ["i", "j"], fill=-1.0, compressor={"id": "zstd"}), array("w", (6, 5), (2, 2), ">i2", ["i", "j"], fill=0)]
    zarr.write(cells, path, arrays, ["i", "j"])
    store = zarr.Store(path)
    v = zarr.values(store, zarr.Array.load(store, "v"))
    assert v.count() == 2 and (v[0, 0], v[5, 4]) == (1.0, 9.0)
    w = zarr.values(store, zarr.Array.load(store, "w"))
    assert w.count() == 4 and w[0, 4] == 2
    assert store.get("v/0.1") is None and store.get("v/2.2") is not None
    for bad, why in (((6, 0, 1.0, 1), "outside"), ((None, 0, 1.0, 1), "outside"), ((0, 0, 2.0, 1), "more than one row")):
        with pytest.raises(Exception, match=why):
            zarr.write(cells.union(spark.createDataFrame([bad], cells.schema)), str(tmp_path / "bad"), arrays, ["i", "j"])
    zarr.write(cells.limit(0), str(tmp_path / "none"), arrays, ["i", "j"])
    store = zarr.Store(str(tmp_path / "none"))
    assert zarr.values(store, zarr.Array.load(store, "v")).count() == 0
    with pytest.raises(ValueError, match="same shape"):
        zarr.write(cells, path, arrays, ["i"])


NAMES = {"init_time": "t0", "lead_time": "step", "latitude": "lat", "longitude": "lon"}
FIELDS = {f: f.upper() for f in adapters.FIELDS}


def test_adapters(spark, tmp_path):
    shape = (1, 2, 2, 3)
    data = {f.upper(): np.arange(12.0).reshape(shape) + 100 * k for k, f in enumerate(adapters.FIELDS)}
    for name, x in data.items():
        put(tmp_path / "z", array(name, shape, (1, 1, 2, 2), "<f8", ["t0", "step", "lat", "lon"]), x)
    lat = np.array([1.5, 0.5])
    put(tmp_path / "z", array("lat", (2,), (2,), "<f8", ["lat"]), lat)
    dims = dict(zip(("t0", "step", "lat", "lon"), shape, strict=True))
    netcdf.write(str(tmp_path / "f.nc"), netcdf.encoded(dims, {"lat": (["lat"], lat, {})} | {n: (list(dims), x, {}) for n, x in data.items()}))
    got = []
    for kind, path in (("zarr", tmp_path / "z"), ("netcdf", tmp_path / "f.nc")):
        adapters.register_adapter(adapters.Adapter("Demo", kind, NAMES, FIELDS, {"msl": lambda c: c / 100}))
        df = adapters.forecast(spark, "demo", str(path))
        assert df.columns == [*adapters.DIMENSIONS, *adapters.FIELDS]
        got.append(sorted(map(tuple, df.where("latitude = 0.5").collect())))
        near = adapters.forecast(spark, "demo", str(path), {"latitude": (None, 1), "longitude": (0, 2)})
        assert sorted(map(tuple, near.collect())) == got[-1]
    assert got[0] == got[1] and len(got[0]) == 6 and got[0][0] == (0.0, 0.0, 0.5, 0.0, 0.03, *(3.0 + 100 * k for k in range(1, 8)))


def test_contracts_of_adapters(spark):
    with pytest.raises(ValueError, match="longitude"):
        adapters.Adapter("m", "zarr", {k: v for k, v in NAMES.items() if k != "longitude"}, FIELDS)
    with pytest.raises(ValueError, match="u200, v200"):
        adapters.Adapter("m", "zarr", NAMES, {k: v for k, v in FIELDS.items() if not k.endswith("200")})
    with pytest.raises(ValueError, match="grib"):
        adapters.Adapter("m", "grib", NAMES, FIELDS).open_forecast(spark, "x")
    with pytest.raises(ValueError, match="no adapter for other"):
        adapters.forecast(spark, "other", "x")
    df = spark.range(1).select(*[F.lit(float(k)).alias(n) for k, n in enumerate([*NAMES.values(), *FIELDS.values()])])
    swap = NAMES | {"latitude": "lon", "longitude": "lat"}
    a = adapters.Adapter("m", "mine", swap, FIELDS)
    adapters.register_format("mine", lambda spark, path, variables, bounds: df.withColumn("a.b", F.lit(path)))
    out = a.normalize(a.open_forecast(spark, "p")).first()
    assert (out.latitude, out.longitude, out["a.b"]) == (3.0, 2.0, "p")
    with pytest.raises(ValueError, match="MSL"):
        a.normalize(df.drop("MSL"))
    with pytest.raises(ValueError, match="canonical names: latitude"):
        a.normalize(df.withColumn("Latitude", F.lit(1.0)))
    with pytest.raises(ValueError, match="lead_time"):
        adapters.check_canonical(df.select(F.lit(0).alias("init_time"), F.lit(0).alias("latitude"), F.lit(0).alias("longitude")))
    assert adapters.check_canonical(df.select(*[F.lit(0).alias(n) for n in adapters.DIMENSIONS]), all_fields=False).columns == list(adapters.DIMENSIONS)
