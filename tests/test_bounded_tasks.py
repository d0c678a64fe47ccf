"""Work and memory of a task do not grow with the tables."""

import re
from datetime import datetime
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators import inventory, runs, tracking
from galeframe.plans.all_queries import QUERIES
from galeframe.sources import forecast_files, netcdf


def test_f10_rows_of_a_task_do_not_grow_with_a_run(spark, monkeypatch):
    monkeypatch.setattr(inventory, "ROWS_A_TASK", 100, raising=False)
    cases = spark.range(1000).selectExpr("CAST(id AS string) AS case_id", "12 AS forecast_hours")
    results = cases.selectExpr("case_id", "'complete' AS status", "CAST(NULL AS string) AS error")
    timings = spark.range(2000).selectExpr("CAST(id % 1000 AS string) AS case_id", "CAST(IF(id < 1000, 6, 12) AS int) AS lead_hours", "IF(id = 7, 0D, 1D) AS seconds")
    files = spark.range(300).selectExpr("CAST(id AS string) AS path", "id AS length", "id = 5 AS partial")
    found = inventory.run_problems(cases, {"cases": cases.where("case_id <> '3'")}, results, timings.where("case_id <> '4'"), files, files)
    parts = {int(n) for n in re.findall(r"Exchange hashpartitioning\(case_id\S*, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())}
    assert parts == {20}
    assert sorted(tuple(r) for r in found.collect()) == [("bad_seconds", "7", ""), ("cases:missing", "3", ""), ("leads_differ", "4", ""), ("partial_file", "5", "")]


def boxes(n):
    """Boxes of two shapes with many lows, some with gaps, and the places in their middle."""
    rng = np.random.default_rng(4)
    out = []
    for k in range(n):
        y, x = 10 - 30.0 * (k % 2) + np.arange(8) * 0.5, 179 + np.arange(8 + k % 3) * 0.5
        fields = {f: rng.normal(0, 500 if f == "msl" else 1, (len(y), len(x))) for f in tracking._CELL}
        if k % 5 == 0:
            fields["u10"][3:5, 3:5] = np.nan
        out.append(tracking.Window(y, x, fields))
    return out, [(float(w.latitude[4]), float(w.longitude[4])) for w in out]


def test_f11_f14_f15_boxes_are_looked_at_together(monkeypatch):
    windows, places = boxes(300)
    cfg = tracking.TrackerConfig(300.0, 100.0, 4e-5)
    alone = [tracking.next_centers([w], [p], cfg)[0] for w, p in zip(windows, places, strict=True)]
    calls, plain = [], geo.inverse
    monkeypatch.setattr(geo, "inverse", lambda *a: calls.append(1) or plain(*a))
    assert tracking.next_centers(windows, places, cfg) == alone
    assert len(calls) < 15 and {why for _, why in alone} >= {"", "missing_diagnostic_data", "vorticity_below_threshold"}


def test_f11_f14_runs_hold_whole_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 9, 200))
    rows = pa.RecordBatch.from_pydict({"k": keys.astype(str), "v": np.arange(200)})
    for size in (1, 7, 60, 200):
        got = [(c["k"].to_pylist()[a], c["v"].to_pylist()[a:b]) for c, ends in runs.whole((rows.slice(i, size) for i in range(0, 200, size)), ["k"]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [(str(k), np.flatnonzero(keys == k).tolist()) for k in np.unique(keys)]


@pytest.mark.parametrize("name", ["e05_j01_tracker", "e08_d12_outcomes"])
def test_f11_f14_a_box_is_looked_at_once(spark, monkeypatch, name):
    met, plain = spark.sparkContext.accumulator(0), tracking._step

    def counting(*args):
        inner = plain(*args)

        def run(batches):
            def counted():
                for b in batches:
                    met.add(b.num_rows)
                    yield b

            yield from inner(counted())

        return run

    monkeypatch.setattr(tracking, "_step", counting)
    cells = 64 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert 0 < met.value <= cells


def written(spark, folder, n):
    """Files of n cases of two leads, and their rows."""
    cells = spark.range(n * 128).selectExpr(f"CONCAT('c', id % {n}) AS forecast_case_id", f"id DIV {n} AS k", "id").selectExpr(
        "'pangu' AS model", "forecast_case_id", "CAST(6 + 6 * (k DIV 64) AS int) AS lead_hours", "10 + k DIV 8 % 8 / 2D AS latitude", "130 + k % 8 / 2D AS longitude",
        "100000D + id * 7919 % 1009 AS msl", "id % 13 / 1D AS u850", "id % 17 / 1D AS v850", "3D AS u10", "4D AS v10",
    )
    inits = cells.select("model", "forecast_case_id").distinct().selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS init_time")
    files = forecast_files.write_cases(cells, inits, str(folder))
    return files, inits


def test_f13_f15_cases_are_written_from_arrow_batches_and_dealt(spark, tmp_path):
    files, inits = written(spark, tmp_path, 20)
    assert "Pandas" not in files._jdf.queryExecution().executedPlan().toString()
    one = files.join(inits, ["model", "forecast_case_id"]).selectExpr("*", "18 AS forecast_hours", "11.5D AS seed_lat", "131.5D AS seed_lon").coalesce(1)
    found = forecast_files.violations(one)
    assert found.rdd.getNumPartitions() == 8
    assert {r.rule: r.n for r in found.groupBy("rule").agg(F.count("*").alias("n")).collect()} == {"lead_time": 40, "valid_time": 40}


def test_f13_f15_an_axis_is_read_once(spark, tmp_path, monkeypatch):
    path = written(spark, tmp_path, 1)[0].first().path
    read, plain = [], netcdf.values
    monkeypatch.setattr(netcdf, "values", lambda f, v, *a: read.append(v.name) or plain(f, v, *a))
    with forecast_files.Forecast(path, "pangu", datetime(2024, 1, 1), 12) as f:
        assert f.window(1, 11.5, 131.5, 400.0).fields["msl"].shape == (8, 8)
    assert read.count("latitude") == read.count("longitude") == 2 and read.count("level") == 1  # two files


def test_f15_cases_are_followed_side_by_side(spark, tmp_path, monkeypatch):
    rows = written(spark, tmp_path, 40)[0].collect()
    cases = [(r.path, r.model, datetime(2024, 1, 1), 12, 11.5, 131.5) for r in rows] + [(str(tmp_path), "pangu", datetime(2024, 1, 1), 6, None, None), (f"{tmp_path}/gone", "pangu", datetime(2024, 1, 1), 12, 11.5, 131.5)]
    cfg = tracking.TrackerConfig(300.0, 100.0, 1e-6)
    alone = [forecast_files.followed([c], cfg)[0] for c in cases]
    calls, plain = [], geo.inverse
    monkeypatch.setattr(geo, "inverse", lambda *a: calls.append(1) or plain(*a))
    assert forecast_files.followed(cases, cfg) == alone and len(calls) < 20
    assert [[p["status"] for p in c] for c in alone[-2:]] == [["no_seed"], ["input_error", "terminated"]] and any(p["status"] == "ok" for c in alone for p in c)


def test_f15_files_that_begin_alike_are_parsed_once(spark, tmp_path, monkeypatch):
    rows = written(spark, tmp_path, 30)[0].collect()
    other = f"{tmp_path}/other.nc"
    held = Path(f"{rows[0].path}/surface.nc").read_bytes()
    Path(other).write_bytes(held.replace(b"complete", b"partials"))
    parsed, plain = [], netcdf.parse_header
    monkeypatch.setattr(netcdf, "parse_header", lambda *a: parsed.append(1) or plain(*a))
    cases = [(r.path, r.model, datetime(2024, 1, 1), 12, 11.5, 131.5) for r in rows]
    assert any(p["status"] == "ok" for c in forecast_files.followed(cases, tracking.TrackerConfig(300.0, 100.0, 1e-6)) for p in c)
    assert len(parsed) <= 2  # a surface file, an upper one
    with netcdf.File(other) as f:  # as long, but with another header
        assert f.header.attributes["status"] == "partials"
        assert f.header == plain(lambda at, n: held.replace(b"complete", b"partials")[at : at + n], len(held))


def test_f15_a_small_file_is_read_once(spark, tmp_path):
    path = written(spark, tmp_path, 1)[0].first().path
    with netcdf.File(f"{path}/surface.nc") as f:
        f.file.close()
        assert f.column("latitude").tolist() == [10 + k / 2 for k in range(8)] and f.bytes_read == 64


def test_f15_stretches_of_a_file_are_worked_out_once_a_window(spark, tmp_path, monkeypatch):
    path = written(spark, tmp_path, 1)[0].first().path
    found, plain = [], netcdf.byte_ranges
    with forecast_files.Forecast(path, "pangu", datetime(2024, 1, 1), 12) as f:
        monkeypatch.setattr(netcdf, "byte_ranges", lambda v, c: found.append(v.name) or plain(v, c))
        w = f.window(1, 11.5, 131.5, 60.0)
        assert len(found) == 2  # two files
        for name, (own, v) in f.names.items():
            box = [np.array([1])] + [np.array([0])] * (own is f.upper) + [np.flatnonzero(np.isin(f.latitude, w.latitude)), np.flatnonzero(np.isin(f.longitude, w.longitude))]
            np.testing.assert_array_equal(w.fields[name], netcdf.values(own.read, own.header.variables[v], box).filled(np.nan).reshape(w.fields[name].shape))


@pytest.mark.parametrize("stride", [0, 5000])
def test_f15_byte_ranges_hold_the_chosen_cells(stride):
    rng = np.random.default_rng(5)
    for _ in range(200):
        shape = tuple(int(n) for n in rng.integers(1, 6, rng.integers(1, 5)))
        v = netcdf.Variable("a", tuple("abcd"[: len(shape)]), shape, "f4", 100, stride)
        chosen = [np.flatnonzero(rng.random(n) < 0.7) for n in shape]
        steps = [4 * int(np.prod(shape[k + 1 :])) for k in range(len(shape))]
        steps[0] = stride or steps[0]
        want = [100 + sum(i * s for i, s in zip(at, steps, strict=True)) for at in product(*(c.tolist() for c in chosen))]
        ranges = list(netcdf.byte_ranges(v, chosen))
        assert [at + k for at, n in ranges for k in range(0, n, 4)] == want
        assert all(a + n != b for (a, n), (b, _) in zip(ranges, ranges[1:], strict=False))
