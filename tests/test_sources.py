"""File formats, sinks, resume, streaming and the command line."""

import io
import json
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from galeframe.operators.validation import IntegrityError
from galeframe.sources import best_track, bufr, checkpoint, config, shapefile, tables

HEAD = "SID,NAME,BASIN,NATURE,TRACK_TYPE,USA_STATUS,ISO_TIME,LAT,LON,USA_WIND,USA_PRES,USA_ATCF_ID"
UNITS = " , , , , , , ,degrees_north,degrees_east,kts,mb, "


def track_file(tmp_path, *lines):
    p = tmp_path / "t.csv"
    p.write_text("\n".join([HEAD, UNITS, *lines]) + "\n")
    return str(p)


def test_best_track(spark, tmp_path):
    p = track_file(tmp_path, "S1,NA ,NA,TS,main,TS,2022-01-01 03:00:00,1.5,2.5,70,990,al012022", "S1,,NA,TS,MAIN,TS,2022-01-01 00:00:00,1,2,bad, ,AL012022", "S0,X,EP,ET,PROVISIONAL,EX,2022-01-01 00:00:00,1,2,,,")
    got = best_track.read(spark, p).collect()
    assert [(r.SID, r.SOURCE_ROW, r.USA_WIND, r.BASIN, r.TRACK_TYPE_NORMALIZED) for r in got] == [("S0", 2, None, "EP", "provisional"), ("S1", 1, None, "NA", "main"), ("S1", 0, 70.0, "NA", "main")]
    assert best_track.select_track_types(best_track.read(spark, p), ["Main"]).count() == 2
    with pytest.raises(IntegrityError):
        best_track.select_track_types(best_track.read(spark, p), ["spur"])
    truth = best_track.read_truth(spark, p, "2022-01-01 00:00:00", "2022-01-02 00:00:00").collect()
    assert [r.USA_ATCF_ID for r in truth] == ["AL012022"] * 2
    assert best_track.read_catalog(spark, p).where("BASIN = 'NA'").count() == 2 and best_track.read_plan(spark, p).where("USA_PRES = ''").count() >= 1
    bare = track_file(tmp_path, ",N,NA,TS,main,TS,2022-01-01 06:00:00,1,2,5,9,AL012022")
    assert [r.SID for r in best_track.read_truth(spark, bare, "2022-01-01 00:00:00", "2022-01-02 00:00:00").collect()] == [None]


def test_rows_are_numbered_over_blocks_of_a_file(spark, tmp_path):
    p = track_file(tmp_path, *[f"S{k:04d},N,NA,TS,main,TS,2022-01-01 00:00:00,1,{k / 100},70,990,A" for k in range(3000)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = best_track.read(spark, p)
        assert spark.read.csv(p).rdd.getNumPartitions() > 1 and [r.SOURCE_ROW for r in got.orderBy("SID").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("line", ["S1,N,NA,TS,main,TS,2022-01-01 03:00:00,1,2,5,9,A", ",N,NA,TS,main,TS,2022-01-01 00:00:00,1,2,5,9,A", "S2,N,NA,TS,main,TS,never,1,2,5,9,A", "S2,N,NA,TS,main,TS,2022-01-01 00:00:00,,2,5,9,A"])
def test_best_track_rejects(spark, tmp_path, line):
    with pytest.raises(IntegrityError):
        best_track.read(spark, track_file(tmp_path, "S1,N,NA,TS,main,TS,2022-01-01 03:00:00,1,2,5,9,A", line))


def test_cases(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("﻿case_id,storm_id,init_time,forecast_hours,output_interval_hours\nS-CE01-L024,S,2022-01-01T00:00:00Z,12,6\nS-CE01-L048,S,2022-01-02 00:00:00,30,\n")
    assert [(r.forecast_case_id, r.case_id, r.forecast_hours) for r in tables.read_cases(spark, str(p)).collect()] == [("S-CE01-L024", "S-CE01", 12), ("S-CE01-L048", "S-CE01", 30)]
    assert tables.read_cases(spark, str(p), ["S-CE01-L048"]).count() == 1
    with pytest.raises(IntegrityError, match="unknown"):
        tables.read_cases(spark, str(p), ["other"])
    for bad in ("S-CE01-L024,S,2022-01-01,13,6", "S/CE01-L024,S,2022-01-01,12,6", "S-CE01,S,2022-01-01,12,6", "S-CE01-L024,S,x,12,6", "S-CE01-L024,S,2022-01-01,12,3"):
        p.write_text("case_id,storm_id,init_time,forecast_hours,output_interval_hours\n" + bad + "\n")
        with pytest.raises(IntegrityError):
            tables.read_cases(spark, str(p))


def test_forecast_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nid,lat\nx,1.5\n")
    (tmp_path / "b.csv").write_text("id,lat,lead\ny,2.5,6\n")
    got = tables.read_forecasts(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "none.csv")], "id string, lat double, lead int").orderBy("id").collect()
    assert [(r.id, r.lat, r.lead) for r in got] == [("x", 1.5, None), ("y", 2.5, 6)]


def test_runs_and_inventory(spark, tmp_path):
    for name, model in (("r1", "pangu_weather"), ("r2", "aurora")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(json.dumps({"model": model}))
    (tmp_path / "r1" / "x.part").write_text("x")
    assert {r.model for r in tables.discover_runs(spark, str(tmp_path)).collect()} == {"pangu", "aurora"}
    files = {r.path.rsplit("/", 1)[1]: r.partial for r in tables.inventory(spark, str(tmp_path)).collect()}
    assert files["x.part"] and not files["job.json"]
    (tmp_path / "r3").mkdir()
    (tmp_path / "r3" / "job.json").write_text(json.dumps({"model": "pangu"}))
    with pytest.raises(IntegrityError):
        tables.discover_runs(spark, str(tmp_path))


def polygon(rings):
    points = [p for r in rings for p in r]
    starts, at = [], 0
    for r in rings:
        starts.append(at)
        at += len(r)
    body = struct.pack("<i4d", 5, 0, 0, 0, 0) + struct.pack("<ii", len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts)
    return body + b"".join(struct.pack("<2d", *p) for p in points)


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    shapes = [polygon([[*ring, ring[0]]]), polygon([ring, [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (5.0, 5.0)]]), struct.pack("<i", 0)]
    data = b"".join(struct.pack(">ii", i + 1, len(s) // 2) + s for i, s in enumerate(shapes))
    p = tmp_path / "coast.shp"
    p.write_bytes(struct.pack(">i", 9994) + b"\0" * 96 + data)
    spark.dataSource.register(shapefile.ShapefileSource)
    rings = spark.read.format("polygons").option("records_per_partition", 1).load(str(p))
    assert sorted((r.record, r.part, len(r.ring)) for r in rings.collect()) == [(0, 0, 5), (1, 0, 5), (1, 1, 4)]
    assert shapefile.ring_edges(rings).count() == 4 + 4 + 3
    p.write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        shapefile.record_offsets(str(p))


def message(body):
    size = 8 + len(body) + 4
    return b"BUFR" + size.to_bytes(3, "big") + b"\4" + body + b"7777"


def test_bufr_splitting(spark, tmp_path):
    assert bufr.split(message(b"a") + message(b"bcd")) == [message(b"a"), message(b"bcd")]
    for bad in (b"", b"BUFR", message(b"a")[:-1], message(b"a") + b"x", message(b"a")[:-4] + b"8888"):
        with pytest.raises(ValueError):
            bufr.split(bad)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, data in (("x/2022/ok2022010100.bin", message(b"a") * 2), ("x/2022/bad.bin", b"zz")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = bufr.read_archives(spark, str(tmp_path / "a.tar.gz"))
    assert sorted((r.member, r.message_index) for r in got.collect()) == [("x/2022/bad.bin", -1), ("x/2022/ok2022010100.bin", 0), ("x/2022/ok2022010100.bin", 1)]
    assert bufr.decode(got, lambda b: [{"n": len(b)}], "n int").count() == 2 and bufr.name_time("x/ok2022010100.bin") == "2022010100"


def test_decoded_arrays(spark):
    rows = [("m", [0, 6], [10.0, 1e95], [182.0, -50.0], [99_000.0, 2147483647.0], [10.0, float("nan")], [1852.0] * 12 + [0.0] * 11 + [1e95])]
    df = spark.createDataFrame(rows, "message_id string, lead_hours array<int>, latitude array<double>, longitude array<double>, pressure_pa array<double>, wind_ms array<double>, radii_m array<double>")
    a, b = bufr.reshape_points(df).orderBy("lead_hours").collect()
    assert (a.latitude, a.longitude, a.pressure_hpa, a.radius_18ms_ne_km) == (10.0, -178.0, 990.0, 1.852)
    assert (b.latitude, b.pressure_hpa, b.max_wind_ms, b.radius_18ms_ne_km, b.radius_33ms_nw_km) == (None, None, None, 0.0, None)
    with pytest.raises(Exception, match="do not fit"):
        bufr.reshape_points(df.withColumn("wind_ms", F.array(F.lit(1.0)))).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, float("nan"), 2021), ("b", 2.0, 1.0, 2022)], "k string, x double, y double, y0 int").withColumn("init_time", F.make_timestamp_ntz("y0", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    tables.write_by_year(df, str(tmp_path / "years"))
    assert sorted(p.name for p in (tmp_path / "years").glob("year=*")) == ["year=2021", "year=2022"]
    tables.write_ordered(df, ["x", "k"], str(tmp_path / "csv"), decimals=3)
    assert sorted(r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["1.235", "2.000"]
    tables.write_details(df, str(tmp_path / "json"))
    assert {r.k: r.y for r in spark.read.json(str(tmp_path / "json")).collect()} == {"a": None, "b": 1.0}


def test_resume(spark, tmp_path):
    one = checkpoint.fingerprint(inputs=["a"], params={"r": 1})
    assert one == checkpoint.fingerprint(params={"r": 1}, inputs=["a"]) != checkpoint.fingerprint(inputs=["b"], params={"r": 1})
    shape = "model string, c string, fingerprint string, case_status string, n int"
    cases = spark.createDataFrame([("m", "1", one), ("m", "2", one), ("m", "3", one)], "model string, c string, fingerprint string")
    path = str(tmp_path / "done")
    assert checkpoint.pending(cases, checkpoint.stored_results(spark, path, shape), ["model", "c"]).count() == 3
    checkpoint.store(spark.createDataFrame([("m", "1", one, "ok", 1), ("m", "2", one, "input_error", 1), ("m", "3", "other", "ok", 1)], shape), path)
    assert sorted(r.c for r in checkpoint.pending(cases, checkpoint.stored_results(spark, path, shape), ["model", "c"]).collect()) == ["2", "3"]
    checkpoint.store(spark.createDataFrame([("m", "2", one, "ok", 2)], shape), path)
    assert {r.c: r.n for r in checkpoint.latest(checkpoint.stored_results(spark, path, shape), ["model", "c"], "n").collect()} == {"1": 1, "2": 2, "3": 1}
    with pytest.raises(ValueError):
        checkpoint.require_same_run("x", one)


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.json"
    good = {s: {} for s in ("experiment", "period", "case_selection", "verification")} | {"forecast_sampling": {"lead_hours": [24], "cycle_hours": [0]}, "root": "${ROOT_X}/a"}
    p.write_text(json.dumps(good))
    with pytest.raises(config.ConfigError):
        config.load(str(p))
    monkeypatch.setenv("ROOT_X", "/r")
    assert config.validate(config.load(str(p)))["root"] == "/r/a"
    with pytest.raises(config.ConfigError):
        config.validate({})


def test_streams_equal_batch(spark, tmp_path):
    from galeframe.plans import views
    from galeframe.streaming import sessions

    c = views.contacts(spark, "/root/testdata/sf0.001").select("storm_id", "iso_time", "wind_kt")
    c.repartition(3).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(-1, None, 0.0)], "storm_id long, iso_time timestamp_ntz, wind_kt double").withColumn("iso_time", F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")))
    stream = spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))
    q = sessions.episodes(stream).writeStream.format("memory").queryName("eps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    late.select(*c.columns).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark on
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("eps").where("storm_id >= 0").collect()))
    assert got == sorted(map(tuple, sessions.episodes(c).collect()))


def test_streamed_fold(spark, tmp_path):
    from galeframe.streaming import sessions

    steps = spark.createDataFrame([(s, i, float(v)) for s in (1, 2) for i, v in enumerate([10, 20, 200 if s == 1 else 30, 40])], "storm_id long, step int, value double")
    steps.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions.hold_or_lose(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in")), 50.0).writeStream.format("memory").queryName("fold").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.storm_id, r.step): (r.held, r.status) for r in spark.table("fold").collect()}
    assert got[1, 2] == got[1, 3] == (20.0, "lost") and got[2, 3] == (40.0, "ok")


def test_command_line(spark, tmp_path, capsys):
    from galeframe import cli

    p = tmp_path / "c.json"
    p.write_text("{}")
    assert cli.main(["config", "check", str(p)]) == 2
    p.write_text(json.dumps({s: {} for s in ("experiment", "period", "case_selection", "verification")} | {"forecast_sampling": {"lead_hours": [24, 48]}}))
    assert cli.main(["config", "check", str(p)]) == 0
    (tmp_path / "e.csv").write_text("case_id,storm_id,reference_time\nT-CE01,T,2022-01-02T03:00:00Z\n")
    assert cli.main(["catalog", "plan", "--config", str(p), "--events", str(tmp_path / "e.csv"), "--out", str(tmp_path / "plan")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "plan")).count() == 2
    assert cli.main(["catalog", "plan", "--config", str(p), "--events", str(tmp_path / "none.csv"), "--out", str(tmp_path / "x")]) == 2


def test_tracking_resumes_strictly(spark, tmp_path):
    """Broken inputs are run again once repaired, other changes raise, the newest results count."""
    import numpy as np

    from galeframe import cli

    def grid(path, holed):
        ys, xs = np.arange(10.0, 20.1, 0.5), np.arange(125.0, 135.1, 0.5)
        rows = [("m", f"c{k}-L024", 6, float(y), float(x), float(99_000 + 300 * ((y - 15) ** 2 + (x - 130) ** 2)), float(-8e-5 * np.radians(y - 15) * 6.371e6), float(8e-5 * np.radians(x - 130) * 6.371e6 * np.cos(np.radians(y))), 3.0, 4.0) for k in (1, 2) for y in ys for x in xs if not (holed and k == 2 and y == 15 and x == 131)]
        df = spark.createDataFrame(rows, "model string, forecast_case_id string, lead_hours int, latitude double, longitude double, msl double, u850 double, v850 double, u10 double, v10 double")
        df.repartition("forecast_case_id").write.mode("overwrite").partitionBy("forecast_case_id").parquet(path)

    def cases(path, hours):
        spark.createDataFrame([("m", f"c{k}-L024", hours, 15.0, 130.0) for k in (1, 2)], "model string, forecast_case_id string, forecast_hours int, seed_lat double, seed_lon double").write.mode("overwrite").parquet(path)

    g, c, out = (str(tmp_path / n) for n in ("grid", "cases", "out"))
    grid(g, True)
    cases(c, 6)
    run = lambda *more: cli.main(["track", "--grid", g, "--cases", c, "--out", out, *more])
    assert run() == 1 and run() == 2 and run("--resume") == 1
    whole = str(tmp_path / "whole")
    grid(whole, False)
    import glob
    import os
    import shutil

    for f in glob.glob(f"{g}/forecast_case_id=c2-L024/*.parquet"):  # only the broken case's file is repaired
        os.remove(f)
    shutil.copy(glob.glob(f"{whole}/forecast_case_id=c2-L024/*.parquet")[0], f"{g}/forecast_case_id=c2-L024/part-new.parquet")
    assert run("--resume") == 0
    rows = spark.read.parquet(out)
    assert rows.where("forecast_case_id = 'c1-L024'").count() == 1 and rows.where("forecast_case_id = 'c2-L024' AND status = 'ok'").count() == 1
    assert run("--resume", "--search-km", "300") == 2
    cases(c, 12)
    assert run("--resume") == 2
    cases(c, 6)
    shutil.copy(f"{g}/forecast_case_id=c2-L024/part-new.parquet", f"{g}/forecast_case_id=c1-L024/part-more.parquet")
    assert run("--resume") == 2 and spark.read.parquet(out).count() == rows.count()


def test_archives_are_compared_with_what_is_there(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name in ("top/2024/x_ECMP_20240801000000_b.bin", "top/2024/plain.bin"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    inv = bufr.member_inventory(spark, str(tmp_path / "a.tar.gz"))
    rows = {r.member: r for r in inv.collect()}
    first = rows["top/2024/x_ECMP_20240801000000_b.bin"]
    import datetime as dt
    import hashlib

    assert (first.size_bytes, first.sha256, first.declared_init) == (3, hashlib.sha256(b"abc").hexdigest(), dt.datetime(2024, 8, 1)) and rows["top/2024/plain.bin"].declared_init is None
    there = spark.createDataFrame([(first.member, first.sha256), ("top/2024/plain.bin", "0")], "member string, sha256 string")
    assert [r.key for r in bufr.changed_members(inv, there).collect()] == ["top/2024/plain.bin"]
    decoded = spark.createDataFrame([(f"{first.member}#0", dt.datetime(2024, 8, 1)), (f"{first.member}#1", dt.datetime(2024, 8, 2))], "message_id string, init_time timestamp_ntz")
    assert sorted((r.rule, r.key) for r in bufr.wrong_times(inv, decoded).collect()) == [("time_differs", f"{first.member}#1"), ("time_missing_in_name", "top/2024/plain.bin")]


def test_frozen_sources_are_restored(tmp_path):
    import gzip
    import hashlib
    import zipfile

    from galeframe.sources import frozen

    good = hashlib.sha256(b"fixes").hexdigest()
    with gzip.open(tmp_path / "f.gz", "wb") as f:
        f.write(b"fixes")
    target = tmp_path / "raw" / "f.csv"
    with pytest.raises(IntegrityError):
        frozen.restore_gzip(str(tmp_path / "f.gz"), str(target), "0")
    assert not target.exists()
    frozen.restore_gzip(str(tmp_path / "f.gz"), str(target), good)
    frozen.restore_gzip(str(tmp_path / "f.gz"), str(target), good)
    assert target.read_bytes() == b"fixes"
    target.write_bytes(b"other")
    with pytest.raises(IntegrityError):
        frozen.restore_gzip(str(tmp_path / "f.gz"), str(target), good)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("shp/l1.shp", b"rings")
    digest = frozen.sha256(str(tmp_path / "c.zip"))
    frozen.restore_members(str(tmp_path / "c.zip"), str(tmp_path / "coast"), ["shp/l1.shp"], digest)
    assert (tmp_path / "coast" / "shp" / "l1.shp").read_bytes() == b"rings"
    (tmp_path / "coast" / "shp" / "l1.shp").write_bytes(b"sea")
    for d in (digest, "0"):
        with pytest.raises(IntegrityError):
            frozen.restore_members(str(tmp_path / "c.zip"), str(tmp_path / "coast"), ["shp/l1.shp"], d)


def test_large_archives_are_streamed(spark, tmp_path):
    """The same members and messages whether an archive comes whole or as a stream; a truncated stream raises."""
    import io
    import tarfile

    def message(n):
        return b"BUFR" + (12 + n).to_bytes(3, "big") + b"\4" + b"x" * n + b"7777"

    for k in range(2):
        with tarfile.open(tmp_path / f"a{k}.tar.gz", "w:gz") as tar:
            for j in range(30):
                data = message(j) * (j % 3 + 1) if j % 7 else b"no message"
                info = tarfile.TarInfo(f"top/2024/x_20240101{j:02d}0000_{k}.bin")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    glob = f"{tmp_path}/*.tar.gz"
    shown = lambda df: sorted(map(str, df.collect()))
    for read in (bufr.read_archives, bufr.member_inventory):
        whole = shown(read(spark, glob))
        assert len(whole) >= 60 and shown(read(spark, glob, stream_above=0)) == whole
    cut = tmp_path / "cut.tar.gz"
    cut.write_bytes((tmp_path / "a0.tar.gz").read_bytes()[:-200])
    with pytest.raises(Exception, match="(?i)end-of-stream|EOF|unexpected end|truncated|ReadError"):
        bufr.read_archives(spark, str(cut), stream_above=0).collect()
