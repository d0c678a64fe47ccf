"""Operators on tiny frames with known answers."""

import datetime as dt
import math
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators import crossings, duplicates, ensemble, grid, joins, qc, schedule, sequences, spatial, tracking, validation


def t(text):
    return dt.datetime.fromisoformat(text)


# -- geodesy -------------------------------------------------------------------------------


def test_degree_at_the_equator(spark):
    r = spark.range(1).select(geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("a"), geo.exact_distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert round(r.a, 3) == round(r.b, 3) == 111.319


def test_column_formula_is_within_a_metre(spark):
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-54, 54, 500), rng.uniform(-180, 180, 500)
    rows = [(float(a), float(o), float(np.clip(a + x, -54, 54)), float(o + y)) for a, o, x, y in zip(lat, lon, rng.uniform(-4, 4, 500), rng.uniform(-4, 4, 500), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(F.max(F.abs(geo.distance_km("a", "b", "c", "d") - geo.exact_distance_km("a", "b", "c", "d")))).first()[0]
    assert got < 0.001


def test_direct_and_inverse_agree():
    lat, lon = geo.direct([10.0, -40.0], [179.9, 5.0], [80.0, 200.0], [350.0, 900.0])
    km, bearing = geo.inverse([10.0, -40.0], [179.9, 5.0], lat, lon)
    assert np.allclose(km, [350, 900], atol=1e-6) and np.allclose(bearing, [80, 200], atol=1e-6) and lon[0] < -176


def test_quadrants_are_half_open(spark):
    df = spark.createDataFrame([(b,) for b in (0.0, 89.9, 90.0, 180.0, 270.0, 360.0, -1.0)], "b double")
    assert [r[0] for r in df.select(geo.quadrant("b")).collect()] == ["NE", "NE", "SE", "SW", "NW", "NE", "NW"]


# -- schedules -----------------------------------------------------------------------------


def events(spark, when="2022-01-02 03:00:00"):
    return spark.createDataFrame([("T-CE01", "T", t(when))], "case_id string, storm_id string, reference_time timestamp_ntz")


def test_tie_goes_to_the_earlier_cycle(spark):
    r = schedule.schedule(events(spark), [24]).first()
    assert (r.init_time, r.actual_lead_hours, r.offset_hours, r.status, r.forecast_case_id) == (t("2022-01-01 00:00:00"), 27.0, -3.0, "planned", "T-CE01-L024")


def test_beyond_tolerance(spark):
    r = schedule.schedule(events(spark), [24], tolerance_hours=2).first()
    assert r.init_time is None and r.status == "no_cycle_within_tolerance"
    assert schedule.handoff(schedule.schedule(events(spark), [24])).first().forecast_hours == 30


def test_parameters_are_checked():
    for leads, cycles in (([], [0]), ([48, 24], [0]), ([24], [6, 6]), ([24], [24])):
        with pytest.raises(ValueError):
            schedule.check_parameters(leads, cycles)


# -- joins ---------------------------------------------------------------------------------

COVER = "init_time timestamp_ntz, storm_id string, iso_time timestamp_ntz, w double, p double"


def covered(spark, points, reference="2022-01-01 03:00:00"):
    e = spark.createDataFrame([("c", "s", t(reference))], "case_id string, storm_id string, reference_time timestamp_ntz")
    p = spark.createDataFrame([("s", t(x), w, q) for x, w, q in points], "storm_id string, iso_time timestamp_ntz, w double, p double")
    return joins.coverage_flags(joins.bracket(e, p, "storm_id", "reference_time", "iso_time", ["w", "p"]), "w", "p").first()


def test_brackets(spark):
    r = covered(spark, [("2022-01-01 03:00:00", 10.0, 990.0), ("2022-01-01 00:00:00", None, None)])
    assert r.coverage_method == "exact" and r.forecast_wind_available and r.before == r.after
    r = covered(spark, [("2022-01-01 00:00:00", 10.0, 990.0), ("2022-01-01 06:00:00", None, 980.0)])
    assert (r.coverage_method, r.forecast_available, r.forecast_wind_available, r.forecast_pressure_available) == ("interpolated", True, False, True)
    r = covered(spark, [("2022-01-01 00:00:00", 10.0, 990.0), ("2022-01-01 06:00:01", 9.0, 980.0)])
    assert r.coverage_method == "unavailable" and not r.forecast_available
    assert covered(spark, [("2022-01-01 00:00:00", 1.0, 1.0)]).coverage_method == "unavailable"


def test_identity_rules(spark):
    m = spark.createDataFrame([(1, t("2022-01-01"), 10.0, 20.0), (2, t("2022-01-01"), None, 20.0), (3, t("2022-01-02"), 10.0, 20.0), (4, t("2022-01-01"), 50.0, 20.0), (5, t("2022-01-01"), -30.0, 20.0)], "message_id int, init_time timestamp_ntz, lat double, lon double")
    truth = spark.createDataFrame([("a", t("2022-01-01"), 10.1, 20.0), ("b", t("2022-01-01"), 10.5, 20.0), ("c", t("2022-01-01"), -30.1, 20.0)], "storm_id string, iso_time timestamp_ntz, lat double, lon double")
    got = {r.message_id: (r.identity_status, r.storm_id) for r in joins.identify(m, truth, truth.select("storm_id").where("storm_id = 'c'")).collect()}
    assert got == {1: ("ambiguous_position", None), 2: ("missing_observed_position", None), 3: ("no_truth_at_init", None), 4: ("no_position_match", None), 5: ("matched_cohort", "c")}
    with pytest.raises(Exception, match="claimed twice"):
        joins.one_to_one(spark.createDataFrame([(1, "a"), (2, "a")], "m int, truth string"), ["truth"], "m").collect()


def test_duplicates(spark):
    p = spark.createDataFrame([(1, 6, 1.0), (1, 6, 1.0), (1, 12, 2.0), (2, 12, 2.0), (2, 6, 1.0), (3, 6, 1.0), (4, 6, 9.0), (5, 6, 1.0), (5, 6, 2.0)], "message_id int, lead int, v double")
    sig = duplicates.signatures(p, "message_id", ["lead"], ["v"])
    m = spark.createDataFrame([(1, "s"), (2, "s"), (3, "u"), (4, "u"), (5, "w"), (6, "x")], "message_id int, storm string").join(sig, "message_id", "left")
    got = {r.message_id: (r.duplicate_status, r.canonical_message_id) for r in duplicates.reconcile(m, ["storm"]).collect()}
    bad = ("conflicting_duplicate_forecasts", None)
    assert got == {1: ("unique", 1), 2: ("equivalent_duplicate", 1), 3: bad, 4: bad, 5: bad, 6: ("unique", 6)}


# -- sequences -----------------------------------------------------------------------------


def test_exact_gap_does_not_split(spark):
    df = spark.createDataFrame([(1, i, t(x)) for i, x in enumerate(["2022-01-01 00:00:00", "2022-01-01 06:00:00", "2022-01-01 12:00:01"])], "s int, i int, x timestamp_ntz")
    assert [r.episode_group for r in sequences.sessions(df, "s", "x", "i").orderBy("i").collect()] == [0, 0, 1]


def test_densified_track(spark):
    rows = [("s", 0, t("2022-01-01 00:00:00"), 0.0, 179.5, 50.0, "A"), ("s", 1, t("2022-01-01 03:00:00"), 0.0, -179.5, None, "B"), ("s", 2, t("2022-01-01 12:00:00"), 1.0, -179.0, 70.0, "C")]
    df = spark.createDataFrame(rows, "storm_id string, fix_id int, iso_time timestamp_ntz, lat double, lon double, wind double, kind string")
    got = sequences.densify(df, ["wind"], ["kind"], spacing_km=50.0).orderBy("iso_time").collect()
    assert len(got) == 1 + 3 + 1 and got[0].is_original and got[-1].segment_break_before and got[-1].wind == 70.0
    assert [r.kind for r in got] == ["A", "A", "B", "B", "C"] and [r.wind for r in got] == [50.0, None, None, None, 70.0]
    assert got[3].iso_time == t("2022-01-01 03:00:00") and abs(abs(got[1].lon) - 179.8333) < 1e-3


# -- spatial -------------------------------------------------------------------------------


def square(spark):
    sides = [(0.0, -10.0, 10.0, -10.0), (10.0, -10.0, 10.0, 10.0), (10.0, 10.0, 0.0, 10.0), (0.0, 10.0, 0.0, -10.0)]
    return spark.createDataFrame([(1, i, *s) for i, s in enumerate(sides)], "ring_id int, segment_id long, lon_a double, lat_a double, lon_b double, lat_b double")


def test_landfall_and_exit(spark):
    pairs = spark.createDataFrame([(1, 0.0, -1.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, -1.0), (3, 0.5, 2.0, 0.5, 3.0)], "pair_id int, a_lat double, a_lon double, b_lat double, b_lon double")
    edges = square(spark)
    found = crossings.merge_close(crossings.crossings(pairs, edges))
    got = {r.pair_id: (round(r.fraction, 6), r.crossing_type) for r in crossings.classify(found, pairs, edges).collect()}
    assert got == {1: (0.5, "landfall"), 2: (0.5, "exit")}


def test_boundary_is_land(spark):
    p = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, -0.1), (3, 5.0, 0.0), (4, 10.0, 10.0), (5, 11.0, 5.0)], "point_id int, lat double, lon double")
    assert {r.point_id: r.is_land for r in spatial.covered_by(p, square(spark)).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_close_crossings_merge_one_after_another(spark):
    rows = [(1, 1, 0.1, 0.0, 0.0), (1, 1, 0.2, 0.0, 0.005), (1, 1, 0.3, 0.0, 0.0105), (1, 1, 0.9, 0.0, 1.0)]
    got = crossings.merge_close(spark.createDataFrame(rows, "pair_id int, segment_id int, fraction double, lat double, lon double")).orderBy("fraction").collect()
    assert [round(r.fraction, 6) for r in got] == [0.225, 0.9]


def test_exact_distance_to_a_segment():
    km, f = spatial.exact_segment_distance([0.0, 0.0], [1.0, 0.5], np.array([[0.0, -10.0, 0.0, 10.0]] * 2))
    assert np.allclose(km, geo.inverse([0, 0], [0, 0], [0, 0], [1.0, 0.5])[0], atol=1e-4) and np.allclose(f, 0.5, atol=1e-3)


# -- grids and tracking --------------------------------------------------------------------


@dataclass
class Field:
    """One lead's window: coordinates in rising order, fields by (latitude, longitude)."""

    latitude: np.ndarray
    longitude: np.ndarray
    msl: np.ndarray
    u850: np.ndarray
    v850: np.ndarray
    u10: np.ndarray
    v10: np.ndarray


def curl(f):
    """Relative vorticity by numpy's own gradients."""
    phi, lam = np.radians(f.latitude), np.radians(f.longitude)
    cosine = np.cos(phi)[:, None]
    return (np.gradient(f.v850, lam, axis=1, edge_order=2) - np.gradient(f.u850 * cosine, phi, axis=0, edge_order=2)) / (6.371e6 * cosine)


def lows(msl):
    """Cells that are least of a complete, finite and not flat 3 x 3 neighbourhood."""
    out = np.zeros(msl.shape, bool)
    around = np.lib.stride_tricks.sliding_window_view(msl, (3, 3))
    lo, hi = around.min(axis=(2, 3)), around.max(axis=(2, 3))
    out[1:-1, 1:-1] = np.isfinite(around).all(axis=(2, 3)) & (msl[1:-1, 1:-1] == lo) & (lo < hi)
    return out


def vortex(lat=0.0, lon=0.0, least=99_000.0, spin=8e-5, step=0.25, about=15.0, around=130.0):
    ys, xs = np.arange(about - 9, about + 9.01, step), np.arange(around - 10, around + 10.01, step)
    yy, xx = np.meshgrid(ys, xs, indexing="ij")
    dy, dx = np.radians(yy - (about + lat)) * 6.371e6, np.radians(xx - (around + lon)) * 6.371e6 * np.cos(np.radians(yy))
    msl = least + 300 * ((yy - about - lat) ** 2 + (xx - around - lon) ** 2)
    return Field(ys, xs, msl, -spin * dy, spin * dx, np.full(yy.shape, 3.0), np.full(yy.shape, 4.0))


CELLS = "model string, forecast_case_id string, lead_hours int, latitude double, longitude double, msl double, u850 double, v850 double, u10 double, v10 double"
CASES = "model string, forecast_case_id string, forecast_hours int, seed_lat double, seed_lon double"


def cells_of(spark, found):
    """found: (case, lead, field)."""
    rows = []
    for case, h, f in found:
        for iy, y in enumerate(f.latitude):
            for ix, x in enumerate(f.longitude):
                rows.append(("m", case, h, float(y), float((x + 180) % 360 - 180), *(None if np.isnan(a[iy, ix]) else float(a[iy, ix]) for a in (f.msl, f.u850, f.v850, f.u10, f.v10))))
    return spark.createDataFrame(rows, CELLS)


def tracked(spark, found, cases, cfg=None):
    """(case, lead) -> (latitude, longitude, wind, status, reason)."""
    df = spark.createDataFrame([("m", *c) for c in cases], CASES)
    return {(r.forecast_case_id, r.lead_hours): (r.latitude, r.longitude, r.vmax10_ms, r.status, r.reason) for r in tracking.track(df, cells_of(spark, found), cfg or tracking.TrackerConfig()).collect()}


def brute_track(fields, lat, lon, cfg):
    """Points of a seeded case by plain loops over {lead: Field}."""
    out, lost = [], False
    for h in sorted(fields):
        f = fields[h]
        yy, xx = np.meshgrid(f.latitude, f.longitude, indexing="ij")
        zeta, wind, best, bare = curl(f), np.hypot(f.u10, f.v10), None, False
        if not lost:
            for iy, ix in np.argwhere(lows(f.msl)):
                y, x = f.latitude[iy], f.longitude[ix]
                km = float(geo.inverse(lat, lon, y, x)[0])
                disk = geo.inverse(y, x, yy, xx)[0] <= cfg.diagnostic_radius_km
                if km > cfg.search_radius_km:
                    continue
                if not (np.isfinite(zeta[disk]).all() and np.isfinite(wind[disk]).all()):
                    bare = True
                    continue
                turn = (zeta if (y or lat) >= 0 else -zeta)[disk].max()
                if turn > cfg.vorticity_threshold_s:
                    best = min(best or (np.inf,), (f.msl[iy, ix], km, y, x, wind[disk].max(), turn))
        if best is None:
            out.append((h, None, None, "terminated" if lost else "track_lost"))
            lost = True
        else:
            lat, lon = best[2], best[3]
            out.append((h, round(float(lat), 6), round(float((lon + 180) % 360 - 180), 6), "ok"))
    return out


def test_center_and_its_order(spark):
    flat, missing, three = vortex(step=0.5), vortex(step=0.5), vortex(step=0.5)
    flat.msl[:] = 1e5
    missing.u10[20, 20] = np.nan
    three.msl[:] = 100_000
    for y, x in ((15, 25), (18, 15), (18, 25)):
        three.msl[y, x] = 99_000
    south = vortex(0.5, 0.5, spin=-8e-5, step=0.5, about=-15.0)
    found = [("found", 6, vortex(0.5, 0.5, step=0.5)), ("slow", 6, vortex(spin=0.0, step=0.5)), ("wrong", 6, vortex(spin=-8e-5, step=0.5)), ("flat", 6, flat), ("missing", 6, missing), ("tie", 6, three), ("south", 6, south)]
    got = tracked(spark, found, [(c, 6, -15.0 if c == "south" else 15.0, 130.0) for c, *_ in found])
    assert got["found", 6] == (15.5, 130.5, 5.0, "ok", "") and got["south", 6] == (-14.5, 130.5, 5.0, "ok", "")
    assert {c: got[c, 6][3:] for c in ("slow", "wrong", "flat", "missing")} == {c: ("track_lost", r) for c, r in {"slow": "vorticity_below_threshold", "wrong": "vorticity_below_threshold", "flat": "no_pressure_minimum", "missing": "missing_diagnostic_data"}.items()}
    assert got["tie", 6][:2] == (15.0, 127.5)  # of the two nearest lows the western one; the third is farther


def test_a_lost_track_is_never_found_again(spark):
    good, still = vortex(step=0.5), vortex(spin=0.0, step=0.5)
    holed = cells_of(spark, [("broken", 6, good)]).where("NOT (latitude = 14.0 AND longitude = 131.0)")
    cells = cells_of(spark, [("lost", 6, good), ("lost", 12, still), ("lost", 18, good), ("gap", 6, good), ("gap", 18, good), ("broken", 12, good)]).unionByName(holed)
    cases = spark.createDataFrame([("m", "lost", 18, 15.0, 130.0), ("m", "gap", 18, 15.0, 130.0), ("m", "broken", 12, 15.0, 130.0), ("m", "bare", 12, None, None), ("m", "bare2", 6, float("nan"), 1.0)], CASES)
    got = {}
    for r in tracking.track(cases, cells).orderBy("lead_hours").collect():
        got.setdefault(r.forecast_case_id, []).append(r.status)
    assert got == {"lost": ["ok", "track_lost", "terminated"], "gap": ["ok", "input_error", "terminated"], "broken": ["input_error", "terminated"], "bare": ["no_seed"] * 2, "bare2": ["no_seed"]}
    for bad in (("m", "x", 9, 15.0, 130.0), ("m", "x", 0, 15.0, 130.0), ("m", "x", 6, 95.0, 130.0)):
        with pytest.raises(Exception, match="leads must be|outside the globe"):
            tracking.track(spark.createDataFrame([bad], CASES), cells).collect()


def test_tracks_equal_brute_force(spark):
    """Moving vortices among random dents, north, south and over the date line."""
    rng = np.random.default_rng(3)
    cfg, cases, found, want = tracking.TrackerConfig(), [], [], {}
    for k, (about, around) in enumerate([(15.0, 130.0), (-20.0, 60.0), (12.0, 179.5), (2.0, -179.0)]):
        by = {}
        for h in (6, 12, 18):
            f = vortex(0.5 * h / 6, -1.0 * h / 6, spin=8e-5 * (-1 if about < 0 else 1), step=0.5, about=about, around=around)
            f.msl += rng.normal(0, 60, f.msl.shape)
            f.u10 += rng.normal(0, 2, f.u10.shape)
            if k == 1 and h == 18:
                f.v850[:] = 0
                f.u850[:] = 0
            by[h] = f
            found.append((f"c{k}", h, f))
        cases.append((f"c{k}", 18, about, around))
        want[f"c{k}"] = brute_track(by, about, around, cfg)
    got = tracked(spark, found, cases, cfg)
    shown = {c: [(h, *(None if v is None else round(v, 6) for v in got[c, h][:2]), got[c, h][3]) for h in (6, 12, 18)] for c, *_ in cases}
    assert shown == want and want["c0"][2][3] == "ok"


def test_a_field_around_the_globe_has_no_seam(spark):
    ys, xs = np.arange(0.0, 31.0, 1.0), np.arange(-180.0, 180.0, 1.0)
    yy, xx = np.meshgrid(ys, xs, indexing="ij")
    off = (xx - 179.0 + 180) % 360 - 180
    f = Field(ys, xs, 99_000 + 300 * ((yy - 15) ** 2 + off**2), -8e-5 * np.radians(yy - 15) * 6.371e6, 8e-5 * np.radians(off) * 6.371e6 * np.cos(np.radians(yy)), np.full(yy.shape, 3.0), np.full(yy.shape, 4.0))
    assert tracked(spark, [("c", 6, f)], [("c", 6, 15.0, -179.5)])["c", 6] == (15.0, 179.0, 5.0, "ok", "")


def test_tracks_over_spark_do_not_depend_on_partitions(spark):
    g = cells_of(spark, [("c1-L024", h, vortex(dy, dx, step=0.5)) for h, (dy, dx) in ((6, (0.0, 0.0)), (12, (0.5, -0.75)))])
    cases = spark.createDataFrame([("m", "c1-L024", 18, 15.0, 130.0), ("m", "c2-L024", 6, None, None)], CASES)
    got = sorted(map(tuple, tracking.track(cases, g).collect()))
    assert got == sorted(map(tuple, tracking.track(cases, g.repartition(7)).collect()))
    assert [(r[1][:2], r[2], r[8]) for r in got] == [("c1", 6, "ok"), ("c1", 12, "ok"), ("c1", 18, "input_error"), ("c2", 6, "no_seed")]
    assert got[1][3:5] == (15.5, 129.5)
    out = {r.forecast_case_id: (r.case_status, r.last_ok_lead) for r in tracking.outcomes(tracking.track(cases, g)).collect()}
    assert out == {"c1-L024": ("input_error", 12), "c2-L024": ("no_seed", None)}


def test_grid_forms_agree(spark):
    f = vortex(0.5, 0.25, step=0.5)
    rows = [(1, iy, ix, float(y), float(x), float(f.msl[iy, ix]), float(f.u850[iy, ix]), float(f.v850[iy, ix])) for iy, y in enumerate(f.latitude) for ix, x in enumerate(f.longitude)]
    df = spark.createDataFrame(rows, "k int, iy int, ix int, latitude double, longitude double, msl double, u850 double, v850 double")
    want = curl(f)
    got = np.zeros(want.shape)
    for r in grid.vorticity(df, ["k"]).collect():
        got[r.iy, r.ix] = r.zeta
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert {(r.iy, r.ix) for r in grid.local_minima(df, ["k"]).collect()} == set(map(tuple, np.argwhere(lows(f.msl)).tolist()))


# -- ensembles and rules -------------------------------------------------------------------


def test_scores_of_small_ensembles(spark):
    m = spark.createDataFrame([(1, i, float(v), 2.0) for i, v in enumerate([1, 2, 4])], "f int, member int, value double, truth double")
    pairs = np.abs(np.subtract.outer([1, 2, 4], [1, 2, 4])).mean()
    assert math.isclose(ensemble.crps(m, ["f"]).first().crps, 1.0 - pairs / 2)
    assert math.isclose(ensemble.brier(m, ["f"], 2.0).first().brier, (2 / 3 - 1) ** 2)
    assert ensemble.complete(m, ["f"], 3, ["value"]).first().complete and not ensemble.complete(m, ["f"], 4, ["value"]).first().complete


def test_bootstrap_is_repeatable_and_holds_the_mean(spark):
    rows = [(24, f"s{i % 9}", float((i * 7) % 23 - 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "lead int, storm string, error double")
    a = ensemble.bootstrap_interval(df, ["lead"], "storm", "error", 20220801).first()
    assert a == ensemble.bootstrap_interval(df.repartition(5), ["lead"], "storm", "error", 20220801).first() and a.low < a.mae < a.high


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    rules = validation.unique_key(df, ["k"]), validation.not_null(df, ["v"], ["k"]), validation.foreign_key(df, df.where("k = 1"), ["k"])
    assert sorted(r.rule for r in validation.violations(*rules).collect()) == ["duplicate_key", "missing_parent", "missing_value"]
    with pytest.raises(validation.IntegrityError, match="duplicate_key"):
        validation.require(*rules)
    validation.require(validation.unique_key(df.where("k = 2"), ["k"]))
    with pytest.raises(validation.IntegrityError):
        validation.require(validation.non_empty(df.limit(0)))
    with pytest.raises(validation.IntegrityError):
        validation.require_columns(df, ["x"])


def test_event_rules_pass_good_episodes(spark):
    from galeframe.plans.q_sequences import episode_table

    got = qc.event_checks(episode_table(spark, "/root/testdata/sf0.001"))
    assert got.where("NOT passed").count() == 0 and got.count() > 0


def test_every_pair_of_fields_is_tracked(spark, tmp_path):
    from galeframe.plans.all_queries import QUERIES

    rng = np.random.default_rng(7)
    ids = [0, 1, 198, 199, 200, 201, 1002, 1003]
    spark.createDataFrame([(i, rng.normal(size=64).tolist(), 0) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cases = {f"F{i // 2}" for i in ids}
    points = QUERIES["e05_j01_tracker"](spark, str(tmp_path)).collect()
    assert sorted((r.forecast_case_id, r.lead_hours) for r in points) == sorted((c, h) for c in cases for h in (6, 12))
    assert {r.forecast_case_id for r in points if r.status == "no_seed"} == {"F0"}
    assert {r.forecast_case_id: r.planned_points for r in QUERIES["e08_d12_outcomes"](spark, str(tmp_path)).collect()} == dict.fromkeys(cases, 2)
