"""NetCDF classic files of all versions, hyperslabs, times, the contract of forecasts, windows and tracks from files."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators import grid, tracking
from galeframe.sources import forecast_files, netcdf, scans

INIT = datetime(2023, 8, 1)


def reader(raw):
    return lambda at, n: raw[at : at + n]


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("record", [None, "t"])
def test_written_files_read_back(version, record):
    rng = np.random.default_rng(version)
    dims = {"t": 3, "y": 4, "x": 5}
    want = {"a": rng.normal(size=(3, 4, 5)).astype("f4"), "b": rng.integers(-100, 100, (3, 5)).astype("i2"), "c": np.arange(3, dtype="i1"), "d": rng.normal(size=(4,)), "e": np.array(7.25), "f": rng.integers(-9, 9, (4, 5)).astype("i4")}
    if version == 5:
        want |= {"g": np.array([2**40, -(2**41), 3], "i8"), "h": np.array([1, 2, 250], "u1")}
    shapes = {"a": ("t", "y", "x"), "b": ("t", "x"), "c": ("t",), "d": ("y",), "e": (), "f": ("y", "x"), "g": ("t",), "h": ("t",)}
    raw = netcdf.encoded(dims, {n: (shapes[n], a, {"units": "m", "long_name": "é" * k, "n": np.array([k, 1.5])}) for k, (n, a) in enumerate(want.items())}, {"status": "complete", "v": np.int32(4)}, version, record)
    h = netcdf.parse_header(reader(raw), len(raw))
    assert (h.version, h.dims) == (version, dims) and h.attributes == {"status": "complete", "v": [4]}
    for k, (n, a) in enumerate(want.items()):
        v = h.variables[n]
        assert v.dims == shapes[n] and v.attributes == {"units": "m", "long_name": "é" * k, "n": [k, 1.5]}
        np.testing.assert_array_equal(netcdf.raw_values(reader(raw), v), a)
    pick = [np.array([0, 2]), np.array([1, 2]), np.array([0, 3, 4])]
    np.testing.assert_array_equal(netcdf.raw_values(reader(raw), h.variables["a"], pick), want["a"][np.ix_(*pick)])
    assert sum(n for _, n in netcdf.byte_ranges(h.variables["a"], pick)) == 2 * 2 * 3 * 4
    whole = list(netcdf.byte_ranges(h.variables["a"], [np.arange(3), np.arange(4), np.arange(5)]))
    assert len(whole) == (3 if record else 1)


def test_one_record_variable_has_no_padding():
    a = np.arange(6, dtype="i2").reshape(2, 3)
    raw = netcdf.encoded({"t": 2, "x": 3}, {"a": (("t", "x"), a, {})}, record="t")
    streamed = raw[:4] + b"\xff\xff\xff\xff" + raw[8:]  # the number of records left open
    for held in (raw, streamed):
        h = netcdf.parse_header(reader(held), len(held))
        assert h.dims == {"t": 2, "x": 3}
        np.testing.assert_array_equal(netcdf.raw_values(reader(held), h.variables["a"]), a)


def test_what_is_no_file_raises():
    good = netcdf.encoded({"x": 2}, {"a": (("x",), np.zeros(2), {})})
    for bad in (b"", b"CDF\3" + good[4:], b"\x89HDF" + good[4:]):
        with pytest.raises(ValueError, match="not a NetCDF classic"):
            netcdf.parse_header(reader(bad), len(bad))
    with pytest.raises(ValueError, match="header is cut off"):
        netcdf.parse_header(reader(good[:20]), 20)
    h = netcdf.parse_header(reader(good), len(good))
    with pytest.raises(ValueError, match="a is cut off"):
        netcdf.raw_values(reader(good[:-3]), h.variables["a"])


def test_missing_and_packed_values():
    a = np.array([1, -9, 7, 100, -32767, 3], "i2")
    own = {"_FillValue": np.int16(-9), "missing_value": np.array([7], "i2"), "valid_max": np.int16(50), "scale_factor": 0.5, "add_offset": 10.0}
    raw = netcdf.encoded({"x": 6}, {"a": (("x",), a, own), "b": (("x",), a, {}), "c": (("x",), np.array([1, 2, 3, netcdf.FILLS["f4"], np.nan, 5], "f4"), {})})
    h = netcdf.parse_header(reader(raw), len(raw))
    v = {n: netcdf.values(reader(raw), h.variables[n]) for n in "abc"}
    assert v["a"].tolist() == [10.5, None, None, None, 10.0 - 32767 / 2, 11.5]
    assert v["b"].tolist() == [1, -9, 7, 100, None, 3]
    assert v["c"].mask.tolist() == [False, False, False, True, False, False] and np.isnan(v["c"].data[4])


def test_times():
    n = netcdf.date2num
    assert n(datetime(2023, 8, 1, 6), "hours since 1970-01-01 00:00:00") == 469686.0
    assert n(datetime(2000, 1, 1), "days since 0001-01-01") - n(datetime(2000, 1, 1), "days since 0001-01-01", "proleptic_gregorian") == 2
    assert n(datetime(1582, 10, 15), "days since 1582-10-04") == 1 and n(datetime(1582, 10, 15), "days since 1582-10-04", "proleptic_gregorian") == 11
    assert netcdf.num2date(0, "seconds since 2000-01-01T00:00:00 +01:30") == datetime(1999, 12, 31, 22, 30)
    assert netcdf.num2date(1.5, "minutes since 2000-1-1") == datetime(2000, 1, 1, 0, 1, 30)
    for units, calendar in (("fortnights since 2000-01-01", "standard"), ("days after 2000-01-01", "standard"), ("days since 2000-01-01", "noleap")):
        with pytest.raises(ValueError, match="unsupported"):
            n(datetime(2000, 1, 1), units, calendar)


def test_source_reads_only_what_filters_ask_for(spark, tmp_path, monkeypatch):
    a = np.arange(2 * 2 * 40 * 60, dtype="f4").reshape(2, 2, 40, 60)
    y, x = np.linspace(-39, 39, 40), np.arange(60) * 6.0
    shape = ("valid_time", "level", "latitude", "longitude")
    raw = netcdf.encoded(
        {"valid_time": 2, "level": 2, "latitude": 40, "longitude": 60},
        {"lead_time": (("valid_time",), np.array([6, 12], "i4"), {}), "level": (("level",), np.array([500.0, 850.0]), {}), "latitude": (("latitude",), y, {}), "longitude": (("longitude",), x, {}), "u": (shape, a, {"_FillValue": np.float32(5)}), "v": (shape, -a, {})},
        record="valid_time",
    )
    path = f"{tmp_path}/upper.nc"
    netcdf.write(path, raw)
    scans.register(spark, netcdf.NetcdfSource, pushdown=True)
    df = spark.read.format("netcdf").option("pushdown", True).load(path)
    assert df.columns == ["valid_time", "level", "latitude", "longitude", "lead_time", "u", "v"]
    rows = df.collect()
    assert len(rows) == a.size and sum(r.u is None for r in rows) == 1 and {(r.lead_time, r.valid_time) for r in rows} == {(6.0, 0.0), (12.0, 1.0)}
    near = df.where("lead_time = 12 AND level = 850 AND latitude BETWEEN -5 AND 5 AND longitude > 30 AND longitude <= 60")
    want = {(float(p), float(q), float(a[1, 1, i, j])) for i, p in enumerate(y) for j, q in enumerate(x) if abs(p) <= 5 and 30 < q <= 60}
    assert {(r.latitude, r.longitude, r.u) for r in near.collect()} == want
    assert near.where("u > 1e9").count() == 0 and df.where("level = 700").count() == 0 and df.where("longitude IN (0, 6, 7)").count() == 2 * 2 * 40 * 2
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    bounds = {"lead_time": (12, 12), "level": (850, None), "latitude": (-5, 5), "longitude": (31, 60)}
    again = scans.opened(spark, netcdf.NetcdfSource, path, bounds)
    assert again.rdd.getNumPartitions() == 1 and {(r.latitude, r.longitude, r.u) for r in again.collect()} == want
    whole = scans.opened(spark, netcdf.NetcdfSource, path)
    assert whole.where("level = 850").unionByName(whole).count() == a.size * 3 // 2 and whole.count() == a.size
    # bytes: the filters as the reader gets them
    r = netcdf._Pushing(path, ["u"], {})
    left = list(r.pushFilters([netcdf.EqualTo(("lead_time",), 12), netcdf.EqualTo(("level",), 850.0), netcdf.GreaterThan(("longitude",), 30), netcdf.LessThanOrEqual(("longitude",), 60), netcdf.GreaterThanOrEqual(("latitude",), -5), netcdf.LessThanOrEqual(("latitude",), 5), netcdf.GreaterThan(("u",), 0)]))
    assert [f.attribute for f in left] == [("u",)]
    parts = r.partitions()
    assert len(parts) == 1
    asked = []
    plain = netcdf.File.read
    monkeypatch.setattr(netcdf.File, "read", lambda self, at, n: (asked.append(n), plain(self, at, n))[1])
    assert sum(b.num_rows for b in r.read(parts[0])) == len(want)
    assert sum(asked) == len(want) * 4 + (2 + 40 + 60) * 8 + 2 * 4  # the cells, and the axes once


# -- forecasts ------------------------------------------------------------------------------------


def make(path, model="pangu", ascending=False, negative=False, leads=(6, 12), change=None, version=2):
    """A globe of one-degree cells whose values tell their place: latitude x 1000 + longitude."""
    known = forecast_files.layout_of(model)
    y = np.arange(-20.0, 21)[:: 1 if ascending else -1]
    x = np.arange(-180.0, 180) if negative else np.arange(360.0)
    levels = np.array([500.0, 850, 1000] if model == "aurora" else [1000.0, 850, 500])
    tile = (y[:, None] * 1000 + (x % 360)[None, :]).astype("f4")
    n = {"valid_time": len(leads), "latitude": len(y), "longitude": len(x)}
    units = "hours since 1970-01-01 00:00:00"
    start = netcdf.date2num(INIT, units)
    shared = {"latitude": (("latitude",), y, {"units": "degrees_north"}), "longitude": (("longitude",), x, {"units": "degrees_east"}), "lead_time": (("valid_time",), np.array(leads, "i4"), {"units": "hours"}), "valid_time": (("valid_time",), start + np.array(leads, float), {"units": units}), "forecast_reference_time": ((), np.array(start), {"units": units})}
    at, fill = ("valid_time", "latitude", "longitude"), {"_FillValue": np.float32(-9999)}
    surface = {k: (at, np.repeat(tile[None], len(leads), 0).copy(), {"units": u, **fill}) for k, u in (("msl", "Pa"), (known.u10, "m s-1"), (known.v10, "m s-1"))}
    high = np.repeat((levels[:, None, None] + tile[None]).astype("f4")[None], len(leads), 0)
    upper = {"level": (("level",), levels, {"units": "hPa"})} | {k: (("valid_time", "level", *at[1:]), high, {"units": "m s-1", **fill}) for k in "uv"}
    files = {"surface.nc": (dict(n), {**shared, **surface}, {"status": "complete"}), known.upper: ({**n, "level": 3}, {**shared, **upper}, {"status": "complete"})}
    if change:
        change(files)
    for name, (dims, variables, attributes) in files.items():
        netcdf.write(f"{path}/{name}", netcdf.encoded(dims, variables, attributes, version))
    return str(path)


@pytest.mark.parametrize("model", sorted(forecast_files.LAYOUTS))
def test_windows_of_all_layouts(tmp_path, model):
    with forecast_files.Forecast(make(tmp_path, model, version=5 if model == "fuxi" else 2), model, INIT, 12) as f:
        assert f.leads == [6, 12]
        before = f.surface.bytes_read
        w = f.window(1, 5, 120, 150)
        want = w.latitude[:, None] * 1000 + w.longitude[None, :]
        for name, more in (("msl", 0), ("u850", 850), ("v850", 850), ("u10", 0), ("v10", 0)):
            np.testing.assert_array_equal(w.fields[name], want + more)
        assert (np.diff(w.latitude) < 0).all() and (np.diff(w.longitude) > 0).all() and max(len(w.latitude), len(w.longitude)) < 15
        assert f.surface.bytes_read - before == 3 * 4 * want.size


@pytest.mark.parametrize("negative", [False, True])
def test_windows_over_the_seam_and_near_poles(tmp_path, negative):
    center = 179 if negative else 359
    with forecast_files.Forecast(make(tmp_path, ascending=True, negative=negative), "pangu", INIT, 12) as f:
        w = f.window(0, 0, center, 112)
        np.testing.assert_array_equal(w.longitude, np.arange(center - 3, center + 4))
        np.testing.assert_array_equal(w.fields["msl"], w.latitude[:, None] * 1000 + (w.longitude % 360)[None, :])
        assert f.window(0, 20, 0, 8000).fields["msl"].shape == (41, 360)
        for bad in ((0, 95, 0, 1), (0, 0, float("nan"), 1), (0, 0, 0, 0)):
            with pytest.raises(ValueError, match="invalid window"):
                f.window(*bad)
        with pytest.raises(ValueError, match="outside the available latitude"):
            f.window(0, 60, 0, 100)
        with pytest.raises(IndexError):
            f.window(2, 0, 0, 100)


def test_missing_cells_and_the_halo(tmp_path):
    def hole(files):
        files["surface.nc"][1]["msl"][1][0, 20, 0] = -9999

    with forecast_files.Forecast(make(tmp_path, change=hole), "pangu", INIT, 12) as f:
        w = f.window(0, 0, 0, 0.01)
    assert w.latitude.tolist() == [2, 1, 0, -1, -2] and w.longitude.tolist() == [-2, -1, 0, 1, 2] and np.isnan(w.fields["msl"][2, 2]) and np.isnan(w.fields["msl"]).sum() == 1


def put(file, name, array=None, dims=None, **attributes):
    def change(files):
        d, a, own = files[file][1][name]
        files[file][1][name] = (d if dims is None else dims, a if array is None else np.asarray(array), own | attributes)

    return change


def drop(file, name):
    return lambda files: files[file][1].pop(name)


BROKEN = [
    ("status", lambda files: files["upper.nc"][2].update(status="partial"), "not complete"),
    ("lead_time", put("surface.nc", "lead_time", np.array([0, 6], "i4")), "lead_time must match"),
    ("lead_time", put("upper.nc", "lead_time", units="days"), "lead_time must match"),
    ("forecast_reference_time", put("surface.nc", "forecast_reference_time", np.array(0.0)), "forecast_reference_time does not match"),
    ("valid_time", put("upper.nc", "valid_time", np.array([0.0, 6])), "valid_time does not match"),
    ("valid_time", put("upper.nc", "valid_time", calendar="noleap"), "unsupported valid_time calendar"),
    ("latitude", put("surface.nc", "latitude", units="degrees"), "invalid latitude"),
    ("latitude", put("surface.nc", "latitude", np.concatenate([np.arange(40.0), [99.0]])), "regular, monotonic"),
    ("latitude", put("surface.nc", "latitude", np.arange(60.0, 101)), "outside"),
    ("longitude", put("surface.nc", "longitude", np.linspace(0, 360, 360)), "periodic endpoint"),
    ("level", put("upper.nc", "level", np.array([1000.0, 925, 500])), "850 hPa"),
    ("level", put("upper.nc", "level", np.array([850.0, 850, 500])), "invalid pressure level"),
    ("level", drop("upper.nc", "level"), "invalid pressure level"),
    ("msl", put("surface.nc", "msl", units="hPa"), "invalid msl"),
    ("u", drop("upper.nc", "u"), "invalid u"),
    ("v10", put("surface.nc", "v10", dims=("valid_time", "longitude", "latitude")), "invalid v10"),
]


@pytest.mark.parametrize("rule, change, said", BROKEN, ids=range(len(BROKEN)))
def test_every_rule_of_the_contract(tmp_path, rule, change, said):
    path = make(tmp_path, change=change)
    with pytest.raises(ValueError, match=said):
        forecast_files.Forecast(path, "pangu", INIT, 12)
    found = [f for name, upper in (("surface.nc", False), ("upper.nc", True)) for f in forecast_files.problems(netcdf.File(f"{path}/{name}"), "pangu", INIT, 12, upper)]
    assert rule in {r for r, _ in found} and any(said in s for _, s in found)


def test_grids_must_agree_and_models_be_known(tmp_path):
    path = make(tmp_path, change=put("upper.nc", "latitude", np.arange(41.0)))
    with pytest.raises(ValueError, match="grids disagree"):
        forecast_files.Forecast(path, "pangu", INIT, 12)
    with pytest.raises(ValueError, match="unsupported forecast model"):
        forecast_files.Forecast(path, "other", INIT, 12)
    with pytest.raises(ValueError, match="multiple of 6"):
        forecast_files.Forecast(path, "pangu", INIT, 13)


def test_violations_of_many_cases(spark, tmp_path):
    rows = [("pangu", "good", make(tmp_path / "a"), INIT, 12), ("pangu", "bad", make(tmp_path / "b", change=put("upper.nc", "lead_time", units="days")), INIT, 12), ("aurora", "none", str(tmp_path / "c"), INIT, 12)]
    cases = spark.createDataFrame(rows, "model string, forecast_case_id string, path string, init_time timestamp_ntz, forecast_hours int")
    got = {(r.rule, r.key) for r in forecast_files.violations(cases).collect()}
    assert got == {("lead_time", "pangu|bad|upper.nc"), ("unreadable", "aurora|none|surface.nc"), ("unreadable", "aurora|none|atmospheric.nc")}


def test_tracks_from_files_equal_tracks_from_cells(spark, tmp_path):
    """Moving vortices, north, south and over the date line, among random dents; a lost one, a bare one, one without files."""
    rng = np.random.default_rng(8)
    cfg, rows, cells = tracking.TrackerConfig(), [], []
    leads = [6, 12, 18]
    for k, (about, around) in enumerate([(15.0, 130.0), (-20.0, 60.0), (12.0, 179.5), (30.0, -179.0)]):
        y, x = np.arange(about - 12, about + 12.1, 0.5), np.arange(around - 12, around + 12.1, 0.5)
        x = (x + 180) % 360 - 180
        fields = {n: np.zeros((3, len(y), len(x))) for n in forecast_files.FIELDS}
        for i, h in enumerate(leads):
            yy, xx = np.meshgrid(y - about - 0.5 * h / 6, (x - around + h / 6 + 180) % 360 - 180, indexing="ij")
            dy, dx = np.radians(yy) * 6.371e6, np.radians(xx) * 6.371e6 * np.cos(np.radians(yy + about))
            spin = 0.0 if k == 1 and h == 18 else 8e-5 * np.sign(about)
            fields["msl"][i] = 99_000 + 300 * (yy**2 + xx**2) + rng.normal(0, 60, yy.shape)
            fields["u850"][i], fields["v850"][i] = -spin * dy, spin * dx
            fields["u10"][i], fields["v10"][i] = 3 + rng.normal(0, 1, yy.shape), np.full(yy.shape, 4.0)
        rows.append(("pangu", f"c{k}", INIT, 18, about, around))
        for i, h in enumerate(leads):
            cells += [("pangu", f"c{k}", h, float(a), float(b), *(float(fields[n][i, p, q]) for n in forecast_files.FIELDS)) for p, a in enumerate(y) for q, b in enumerate(x)]
    grid_table = spark.createDataFrame(cells, "model string, forecast_case_id string, lead_hours int, latitude double, longitude double, msl double, u850 double, v850 double, u10 double, v10 double")
    cases = spark.createDataFrame(rows, "model string, forecast_case_id string, init_time timestamp_ntz, forecast_hours int, seed_lat double, seed_lon double")
    # a file's longitudes must be regular: those over the date line are written as they run on
    files = forecast_files.write_cases(grid_table.withColumn("longitude", F.when(F.col("forecast_case_id").isin("c2", "c3") & (F.col("longitude") < 0), F.col("longitude") + 360).otherwise(F.col("longitude"))), cases.select("model", "forecast_case_id", "init_time"), str(tmp_path))
    plan = files.join(cases, ["model", "forecast_case_id"])
    more = spark.createDataFrame([("pangu", "bare", str(tmp_path), INIT, 12, None, None), ("pangu", "gone", f"{tmp_path}/nowhere", INIT, 12, 1.0, 2.0)], "model string, forecast_case_id string, path string, init_time timestamp_ntz, forecast_hours int, seed_lat double, seed_lon double")
    shown = lambda df: {(r.forecast_case_id, r.lead_hours): (*(None if v is None else round(v, 9) for v in (r.latitude, r.longitude, r.msl_hpa, r.vmax10_ms)), None if r.cyclonic_vorticity_s is None else round(r.cyclonic_vorticity_s, 12), r.status, r.reason) for r in df.collect()}
    got = shown(forecast_files.track_files(plan.select(*more.columns).unionByName(more), cfg))
    want = shown(tracking.track(cases.drop("init_time"), grid_table, cfg))
    assert {k: v for k, v in got.items() if k[0].startswith("c")} == want and want["c0", 18][5] == "ok"
    assert [got["bare", h][5] for h in (6, 12)] == ["no_seed"] * 2 and [got["gone", h][5] for h in (6, 12)] == ["input_error", "terminated"]


def test_queries_over_files_and_cells_agree(spark):
    from galeframe.plans.all_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    names = ["forecast_case_id", "lead_hours", "latitude", "longitude", "vmax10_ms", "status", "reason"]
    a, b = (sorted(map(str, QUERIES[q](spark, sf).select(*names).collect())) for q in ("e05_tracks_from_files", "e05_j01_tracker"))
    assert a == b and any("status='ok'" in r for r in a)


def test_windows_of_many_centers_in_a_table(spark):
    """Centers at poles, at the date line and between, several a field, equal to a filter of every center with every cell of its field."""
    cells = [(f, float(y), float(x)) for f in (1, 2) for y in np.arange(-90, 91, 4.0) for x in np.arange(0, 360, 5.0)]
    centers = [(1, 1, 89.0, 10.0), (1, 2, -90.0, 0.0), (1, 3, 0.0, 179.9), (1, 4, 0.0, -179.9), (2, 5, 40.0, 355.0), (2, 6, 60.0, -0.1), (3, 7, 0.0, 0.0), (2, 8, None, 1.0)]
    table = spark.createDataFrame(cells, "field int, latitude double, longitude double")
    asked = spark.createDataFrame(centers, "field int, center_id int, c_lat double, c_lon double")
    for radius in (300.0, 1500.0, 25_000.0):
        got = [(r.center_id, r.latitude, round(r.longitude, 6) % 360) for r in grid.windows(asked, table, ["field"], radius, F.lit(8.0), F.lit(10.0)).collect()]
        angle = min(radius / geo.LEAST_RADIUS_KM, np.pi)
        want = set()
        for f, c, y, x in centers[:-1]:
            reach = 180.0 if abs(y) + np.degrees(angle) >= 90 else np.degrees(np.arcsin(min(1.0, np.sin(angle) / np.cos(np.radians(y)))))
            want |= {(c, b, round(a, 6) % 360) for g, b, a in cells if g == f and abs(b - y) <= np.degrees(angle) + 8 + 1e-8 and abs((a - x + 180) % 360 - 180) <= min(180.0, reach + 10 + 1e-8)}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
