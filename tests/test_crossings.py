"""Crossings on geodesics against bisection along each track pair, long pairs and edges included."""

import numpy as np
import pytest

from galeframe.functions import geo
from galeframe.operators import crossings, spatial

PAIRS = "pair_id int, a_lat double, a_lon double, b_lat double, b_lon double"
EDGES = "ring_id int, segment_id long, lon_a double, lat_a double, lon_b double, lat_b double"

BEHIND = 4500.0


def turn(y0, x0, y, x, way):
    """How far the bearing of a place lies from a way, in (-180, 180]; its sign is the side."""
    return (geo.inverse(y0, x0, y, x)[1] - way + 180) % 360 - 180


def brute(pairs, edges):
    """(pair, edge) -> fraction of every crossing, by the side of the edge's geodesic on which a place of the pair lies."""
    out = {}
    for i, ya, xa, yb, xb in pairs:
        km, way = geo.inverse(ya, xa, yb, xb)
        f = np.linspace(0, 1, 401)
        y, x = geo.direct(ya, xa, way, km * f)
        for _, j, lon_a, lat_a, lon_b, lat_b in edges:
            size, to = geo.inverse(lat_a, lon_a, lat_b, lon_b)
            y0, x0 = geo.direct(lat_a, lon_a, to + 180, BEHIND)  # seen from far behind the edge, its whole length lies ahead
            to = geo.inverse(y0, x0, lat_a, lon_a)[1]
            side = turn(y0, x0, y, x, to)
            for k in np.flatnonzero((np.sign(side[1:]) != np.sign(side[:-1])) & (np.abs(side[1:]) < 90) & (np.abs(side[:-1]) < 90)):
                lo, hi = f[k], f[k + 1]
                for _ in range(60):
                    mid = (lo + hi) / 2
                    left = np.sign(turn(y0, x0, *geo.direct(ya, xa, way, km * mid), to)) == np.sign(side[k])
                    lo, hi = (mid, hi) if left else (lo, mid)
                at = geo.direct(ya, xa, way, km * lo)
                if 0 <= geo.inverse(y0, x0, *at)[0] - BEHIND <= size:
                    out[i, j] = (lo, *map(float, at))
    return out


def test_a_pair_of_502_km_over_a_meridian(spark):
    pairs = spark.createDataFrame([(1, 50.0, -40.0, 50.0, -33.0)], PAIRS)
    edges = spark.createDataFrame([(1, 1, -36.0, 20.0, -36.0, 60.0)], EDGES)
    r = crossings.crossings(pairs, edges).collect()
    assert len(r) == 1
    way, km = geo.inverse(50, -40, 50, -33)[::-1]
    lo, hi = 0.0, km
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if geo.direct(50, -40, way, mid)[1] < -36 else (lo, mid)
    y, x = geo.direct(50, -40, way, lo)
    assert geo.inverse(r[0].lat, r[0].lon, y, x)[0] < 1e-3 and abs(r[0].fraction - lo / km) < 1e-7 and abs(r[0].lat - 50.0517) < 1e-3


@pytest.mark.parametrize("piece_km", [20.0, 100.0, 400.0])
def test_equal_to_bisection(spark, piece_km):
    """Pairs of metres to 4000 km, edges of metres to 40 degrees, over the date line and near the poles."""
    rng = np.random.default_rng(5)
    pairs, edges = [], []
    for k in range(60):
        y, x = rng.uniform(-80, 84), rng.choice([0.0, 179.0, -140.0]) + rng.uniform(-3, 3)
        far, way = 10 ** rng.uniform(-1, 3.6), rng.uniform(0, 360)
        b = geo.direct(y, x, way, far)
        pairs.append((k, float(y), float((x + 180) % 360 - 180), float(b[0]), float(b[1])))
        # an edge through some place of the pair, and one that stops short of it
        at = geo.direct(y, x, way, far * rng.uniform(0.1, 0.9))
        out = rng.uniform(0, 360)
        for m, gone in enumerate((1.0, 0.2)):
            size = 10 ** rng.uniform(-1, 3.3)
            a, c = geo.direct(*at, out + 60 * m, size * 0.3), geo.direct(*at, out + 60 * m, size * (0.3 - gone))
            edges.append((k, 2 * k + m, float(a[1]), float(a[0]), float(c[1]), float(c[0])))
    edges += [(99, 900, -170.0, 0.0, -130.0, 0.0), (99, 901, 160.0, 10.0, -160.0, 50.0), (99, 902, -20.0, -70.0, 20.0, -70.0)]
    want = brute(pairs, edges)
    got = crossings.crossings(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(edges, EDGES), piece_km=piece_km).collect()
    assert len(want) > 60 and {(r.pair_id, r.segment_id) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert geo.inverse(r.lat, r.lon, *want[r.pair_id, r.segment_id][1:])[0] < 1e-3


def test_what_does_not_count(spark):
    """No length, no coordinates, stretches on each other, parallels apart; a shared end counts."""
    pairs = spark.createDataFrame([(1, 10.0, 10.0, 10.0, 10.0), (2, None, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 0.0, 5.0), (4, 1.0, 1.0, 1.0, 2.0), (5, 5.0, 5.0, 6.0, 6.0), (6, float("nan"), 0.0, 1.0, 1.0)], PAIRS)
    edges = spark.createDataFrame([(1, 1, 1.0, 0.0, 4.0, 0.0), (1, 2, 10.0, 10.0, 10.0, 10.0), (1, 3, 5.0, 5.0, 5.0, 9.0), (1, 4, None, 0.0, 1.0, 1.0)], EDGES)
    got = {(r.pair_id, r.segment_id): r.fraction for r in crossings.crossings(pairs, edges).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(5, 3): 0.0}
    assert crossings.crossings(pairs.limit(0), edges).count() == 0 and crossings.crossings(pairs, edges.limit(0)).count() == 0


def test_middle_over_the_date_line(spark):
    rows = [(1, 1, 0.5, 0.0, 179.999), (1, 2, 0.6, 0.0, -179.999)]
    r = crossings.merge_close(spark.createDataFrame(rows, "pair_id int, segment_id long, fraction double, lat double, lon double")).collect()
    assert len(r) == 1 and abs(abs(r[0].lon) - 180) < 1e-6


def test_kinds_on_long_pairs(spark):
    """A square of 30 degrees, its sides straight in the plane of its file: in and out again on one pair of 5000 km."""
    ring = [(0.0, 40.0), (30.0, 40.0), (30.0, 60.0), (0.0, 60.0)]
    edges = spark.createDataFrame([(1, k, *ring[k], *ring[(k + 1) % 4]) for k in range(4)], EDGES)
    edges = crossings.plane_edges(edges)
    pairs = spark.createDataFrame([(1, 50.0, -20.0, 50.0, 50.0), (2, 38.0, 15.0, 42.0, 15.0), (3, 42.0, 15.0, 39.9, 15.0)], PAIRS)
    found = crossings.merge_close(crossings.crossings(pairs, edges))
    got = {(r.pair_id, r.crossing_type): (r.lat, r.lon) for r in crossings.classify(found, pairs, edges).collect()}
    assert set(got) == {(1, "landfall"), (1, "exit"), (2, "landfall"), (3, "exit")}
    assert abs(got[1, "landfall"][1]) < 1e-6 and abs(got[1, "exit"][1] - 30) < 1e-6 and abs(got[2, "landfall"][0] - 40) < 1e-4 and abs(got[3, "exit"][0] - 40) < 1e-4
    land = spatial.covered_by(spark.createDataFrame([(1, 40.001, 15.0), (2, 39.999, 15.0)], "point_id int, lat double, lon double"), edges)
    assert {r.point_id: r.is_land for r in land.collect()} == {1: True, 2: False}
