"""The catalog from a best-track file and a polygon file to its tables, from the command line."""

import json
import struct
from pathlib import Path

from galeframe import cli
from galeframe.functions import geo

HEAD = "SID,NAME,BASIN,NATURE,TRACK_TYPE,USA_STATUS,ISO_TIME,LAT,LON,USA_WIND,USA_PRES," + ",".join(f"USA_R{kt}_{q}" for kt in (34, 50, 64) for q in ("NE", "SE", "SW", "NW"))


def write_land(path):
    """One square of land, 10 degrees wide, as a polygon file of one record."""
    ring = [(-80.0, 25.0), (-80.0, 35.0), (-70.0, 35.0), (-70.0, 25.0), (-80.0, 25.0)]
    body = struct.pack("<i4d2i1i", 5, -80, 25, -70, 35, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = struct.pack(">2i", 1, len(body) // 2) + body
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(record)) // 2) + struct.pack("<2i8d", 1000, 5, -80, 25, -70, 35, 0, 0, 0, 0)
    path.write_bytes(head + record)


def write_tracks(path):
    """Three storms: one makes landfall at noon, one passes 60 km off with wind radii, one is weak; a provisional one far away."""
    rows = [HEAD, ",".join(["", "", "", "", "", "", "", "degrees", "degrees", "kts", "mb"] + ["nmile"] * 12)]

    def storm(sid, name, kind, lat, lons, wind, radius):
        for k, x in enumerate(lons):
            rows.append(",".join([sid, name, "NA", "TS", kind, "TS", f"2024-08-0{1 + k // 4} {k % 4 * 6:02d}:00:00", str(lat), str(x), str(wind), "990"] + [str(radius)] * 4 + [""] * 8))

    storm("S1", "ASHORE", "main", 30.0, [-68.0, -69.0, -69.5, -70.5, -71.0], 90, 50)
    storm("S2", "PASSING", "main", 36.0, [-72.0, -74.0, -76.0], 80, 100)
    storm("S3", "WEAK", "main", 30.0, [-68.0, -71.0], 30, 20)
    storm("S4", "FAR", "PROVISIONAL", 0.0, [20.0, 21.0], 100, 20)
    path.write_text("\n".join(rows) + "\n")


def test_catalog_from_files(spark, tmp_path):
    write_land(tmp_path / "coast.shp")
    write_tracks(tmp_path / "tracks.csv")
    out = str(tmp_path / "out")
    asked = ["catalog", "build", "--tracks", str(tmp_path / "tracks.csv"), "--coast", str(tmp_path / "coast.shp"), "--start", "2024-08-01 00:00:00", "--end", "2024-08-10 00:00:00", "--spacing-km", "50", "--sample-km", "20", "--out", out]
    assert cli.main(asked) == 0
    table = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/{name}").collect()
    cases = {r.name: r for r in table("cases")}
    assert set(cases) == {"ASHORE", "PASSING"}
    a, p = cases["ASHORE"], cases["PASSING"]
    assert (a.reference_event, a.landfall_count, a.exit_count, round(a.latitude, 2), round(a.longitude, 6), a.minimum_coast_distance_km) == ("landfall", 1, 0, 30.0, -70.0, 0.0)
    assert str(a.reference_time) == "2024-08-01 15:00:00" and a.tier == "A"
    assert p.reference_event == "coastal_approach" and p.landfall_count == 0 and p.tier == "C" and p.selection_method == "wind_radius"
    assert abs(p.minimum_coast_distance_km - float(geo.inverse(36.0, -74.0, 35.0, -74.0)[0])) < 0.5
    assert {r.name for r in table("primary_cases")} == {"ASHORE"} == {r.name for r in table("primary_storms")} and len(table("main_cases")) == 2
    storms = table("storms")
    assert [(r.storm_id, r.episode_count, r.highest_tier, r.any_coastline_crossing, r.qc_status) for r in storms] == [("S2", 1, "C", False, "pending"), ("S1", 1, "A", True, "pending")]  # by first contact
    points = table("points")
    assert {r.storm_id for r in points} == {"S1", "S2", "S4"} and any(r.is_land for r in points) and any(r.landfall for r in points)
    told = [json.loads(line) for f in Path(out, "manifest").glob("part-*") for line in f.read_text().splitlines()]
    assert len(told) == 1
    m = told[0]
    assert m["summary"]["case_count"] == 2 and m["summary"]["tier_counts"] == {"A": 1, "C": 1} and m["summary"]["dense_track_point_count"] == len(points) and m["summary"]["landfall_case_count"] == 1 and m["summary"]["basin_counts"] == {"NA": 2}
    assert m["tracks"]["row_count"] == 12 and m["tracks"]["track_type_rows"] == {"PROVISIONAL": 2, "main": 10} and m["tracks"]["any_wind_radius_fraction"] == 1.0 and m["tracks"]["duplicate_storm_time_count"] == 0
    assert m["coast"]["rings"] == 1 and m["settings"]["spacing_km"] == "50.0" and m["track_types"] == ["main", "provisional"]
    assert cli.main(asked) == 2  # its tables are there already
    assert cli.main(["catalog", "build", "--tracks", "x", "--out", out]) == 2 and cli.main(["catalog", "build", "--out", out]) == 2
