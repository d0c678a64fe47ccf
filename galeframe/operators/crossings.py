"""Where tracks cross coasts, along geodesics: places, merging of close ones, landfall, exit or tangent.

Both a track pair and a coast segment are geodesics, however long. They are cut into pieces of
bounded length, which meet by an equi-join on the cells of a longitude-latitude grid and by their
boxes; a great circle through each piece tells which of them can cross, and Newton's iteration on
the ellipsoid places the crossing on both geodesics, to less than a millimetre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators.spatial import covered_by

_GUESS_KM = 1.0  # a great circle over reduced latitudes is off by less, over pieces of some 100 km
_RESIDUAL_KM = 1e-6
_ROWS = 1 << 16
_ENDS = ("lat_a", "lon_a", "lat_b", "lon_b")
_PIECE = "way double, km double, s0 double, s1 double, y0 double, x0 double, y1 double, x1 double"


def _cut(piece_km: float, flat: float):
    """For mapInArrow: rows id and ends to rows id and the geodesic's pieces: bearing, length, from and to (km), ends of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ya, xa, yb, xb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _ENDS)
            km, way = geo.inverse(ya, xa, yb, xb, flat)
            n = np.maximum(1, np.ceil(km / piece_km)).astype(np.int64)
            total = np.cumsum(n)
            for start in range(0, int(total[-1]), _ROWS):
                at = np.arange(start, min(start + _ROWS, int(total[-1])))
                row = np.searchsorted(total, at, "right")
                k = at - (total[row] - n[row])
                s0, s1 = km[row] * k / n[row], km[row] * (k + 1) / n[row]
                y0, x0 = geo.direct(ya[row], xa[row], way[row], s0, flat)
                y1, x1 = geo.direct(ya[row], xa[row], way[row], s1, flat)
                columns = [batch.column(0).take(pa.array(row)), *(batch.column(c).take(pa.array(row)) for c in _ENDS[:2]), *map(pa.array, (way[row], km[row], s0, s1, y0, x0, y1, x1))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *_ENDS[:2], *(c.split()[0] for c in _PIECE.split(", "))])

    return run


def _pieces(rows: DataFrame, id_: str, ends: tuple[str, ...], piece_km: float, flat: float, side: str) -> DataFrame:
    """The pieces of geodesics with their boxes: box.lo, hi (latitudes), mid, half (longitudes), all columns with the prefix side."""
    plain = rows.select(F.col(id_).alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip(ends, _ENDS, strict=True)))
    plain = plain.where(geo.valid_position("lat_a", "lon_a") & geo.valid_position("lat_b", "lon_b"))
    schema = f"id {rows.schema[id_].dataType.simpleString()}, lat_a double, lon_a double, {_PIECE}"
    cut = plain.mapInArrow(_cut(piece_km, flat), schema)
    # no place of a piece is farther from one of its ends than half its length
    pad = F.degrees((F.col("s1") - F.col("s0")) / 2.0 / geo.LEAST_RADIUS_KM) + 1e-6
    lo, hi = F.least("y0", "y1") - pad, F.greatest("y0", "y1") + pad
    far = F.greatest(F.abs(lo), F.abs(hi))
    x1 = geo.unwrap_longitude("x1", "x0")
    half = F.when(far >= 89.0, 180.0).otherwise(F.least(F.lit(180.0), F.abs(x1 - F.col("x0")) / 2.0 + pad / F.cos(F.radians(far))))
    box = F.struct(lo.alias("lo"), hi.alias("hi"), geo.wrap_longitude((F.col("x0") + x1) / 2.0).alias("mid"), half.alias("half"))
    return cut.withColumn("box", box).select(*(F.col(c).alias(f"{side}_{c}") for c in [*cut.columns, "box"]))


def _celled(pieces: DataFrame, side: str, cell_deg: float) -> DataFrame:
    """pieces once for each cell that their box touches, as cy, cx."""
    b, wide = f"{side}_box", int(round(360 / cell_deg))
    cell = lambda v: F.floor(v / cell_deg).cast("int")
    left = F.col(f"{b}.mid") - F.col(f"{b}.half") + 180.0
    columns = F.array_distinct(F.transform(F.sequence(cell(left), F.least(cell(left + 2 * F.col(f"{b}.half")), cell(left) + wide)), lambda c: F.pmod(c, F.lit(wide))))
    return pieces.withColumn("cy", F.explode(F.sequence(cell(F.col(f"{b}.lo")), cell(F.col(f"{b}.hi"))))).withColumn("cx", F.explode(columns))


def _unit(lat: np.ndarray, lon: np.ndarray, flat: float) -> np.ndarray:
    """Unit vectors over reduced latitudes."""
    beta, lam = np.arctan((1 - flat) * np.tan(np.radians(lat))), np.radians(lon)
    return np.stack([np.cos(beta) * np.cos(lam), np.cos(beta) * np.sin(lam), np.sin(beta)], axis=-1)


def _guess(p: dict[str, np.ndarray], flat: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows whose pieces may cross, km along each geodesic where) by great circles."""
    a0, a1, b0, b1 = (_unit(p[f"{s}_y{k}"], p[f"{s}_x{k}"], flat) for s in "pc" for k in (0, 1))
    n, m = np.cross(a0, a1), np.cross(b0, b1)
    both = np.cross(n, m)
    with np.errstate(invalid="ignore", divide="ignore"):
        size = np.linalg.norm(both, axis=-1)
        at = both / size[:, None]
        at *= np.where((at * (a0 + a1)).sum(axis=-1) < 0, -1.0, 1.0)[:, None]
        turn = size / (np.linalg.norm(n, axis=-1) * np.linalg.norm(m, axis=-1))
        slack = _GUESS_KM / np.maximum(turn, 1e-3)  # flat angles make the place uncertain

        def along(u0: np.ndarray, normal: np.ndarray) -> np.ndarray:
            return geo.SPHERE_KM * np.arctan2((np.cross(u0, at) * normal).sum(axis=-1) / np.linalg.norm(normal, axis=-1), (u0 * at).sum(axis=-1))

        s, t = p["p_s0"] + along(a0, n), p["c_s0"] + along(b0, m)
        near = (s >= p["p_s0"] - slack) & (s <= p["p_s1"] + slack) & (t >= p["c_s0"] - slack) & (t <= p["c_s1"] + slack)
    rows = np.flatnonzero(near)
    return rows, np.clip(s[rows], p["p_s0"][rows], p["p_s1"][rows]), np.clip(t[rows], p["c_s0"][rows], p["c_s1"][rows])


def _newton(p: dict[str, np.ndarray], s: np.ndarray, t: np.ndarray, flat: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(s, t, distance left, lat, lon): km along both geodesics where they meet, from a guess."""
    gap = np.full(len(s), np.inf)
    y, x = np.full(len(s), np.nan), np.full(len(s), np.nan)
    for _ in range(12):
        y, x, north_a = geo.direct(p["p_lat_a"], p["p_lon_a"], p["p_way"], s, flat, final=True)
        v, w, north_b = geo.direct(p["c_lat_a"], p["c_lon_a"], p["c_way"], t, flat, final=True)
        gap, to = geo.inverse(y, x, v, w, flat)
        if not len(gap) or np.nanmax(gap, initial=0.0) < _RESIDUAL_KM / 10:
            break
        to, a = np.radians(to), np.radians(north_a)
        b = np.radians(north_b) - np.radians((w - x + 180) % 360 - 180) * np.sin(np.radians((y + v) / 2))  # meridians lean towards each other
        with np.errstate(invalid="ignore", divide="ignore"):
            turn = np.sin(a - b)
            s = s + np.clip(gap * np.sin(to - b) / turn, -200, 200)
            t = t + np.clip(gap * np.sin(to - a) / turn, -200, 200)
    return s, t, gap, y, x


def _met(flat: float):
    """For mapInArrow: candidate pieces to the crossings that lie on both."""
    names = ["pair_id", "segment_id", "fraction", "lat", "lon"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("p_id", "c_id")}
            rows, s, t = _guess(p, flat)
            s, t, gap, y, x = _newton({c: v[rows] for c, v in p.items()}, s, t, flat)
            own = {c: v[rows] for c, v in p.items()}
            ok = (gap < _RESIDUAL_KM) & (s > own["p_s0"] - 1e-6) & (s < own["p_s1"] + 1e-6) & (t > own["c_s0"] - 1e-6) & (t < own["c_s1"] + 1e-6)
            hit = np.flatnonzero(ok)
            kept = pa.array(rows[hit])
            fraction = np.clip(s[hit] / np.maximum(own["p_km"][hit], 1e-12), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("p_id").take(kept), batch.column("c_id").take(kept), pa.array(fraction), pa.array(y[hit]), pa.array(x[hit])], names=names)

    return run


def crossings(pairs: DataFrame, segments: DataFrame, cell_deg: float = 1.0, piece_km: float = 100.0, flattening: float = geo.FLAT) -> DataFrame:
    """Where track pairs (pair_id, a_lat, a_lon, b_lat, b_lon) cross coast segments: pair_id, segment_id, fraction along the pair, lat, lon.

    Pairs and segments are geodesics of the ellipsoid (of the sphere for a flattening of 0), which
    meet once at most; stretches that lie on each other, and pairs or segments without length, do
    not count. Rows without valid coordinates are left out. piece_km up to some hundreds.
    """
    track = _pieces(pairs, "pair_id", ("a_lat", "a_lon", "b_lat", "b_lon"), piece_km, flattening, "p")
    coast = _pieces(segments, "segment_id", ("lat_a", "lon_a", "lat_b", "lon_b"), piece_km, flattening, "c")
    both = _celled(track, "p", cell_deg).join(_celled(coast, "c", cell_deg), ["cy", "cx"])
    b: dict[str, Column] = {f"{s}{k}": F.col(f"{s}_box.{k}") for s in "pc" for k in ("lo", "hi", "mid", "half")}
    apart = F.abs(geo.wrap_longitude(b["pmid"] - b["cmid"]))
    both = both.where((b["plo"] <= b["chi"]) & (b["clo"] <= b["phi"]) & (apart <= b["phalf"] + b["chalf"])).drop("cy", "cx", "p_box", "c_box")
    id_ = lambda df, c: df.schema[c].dataType.simpleString()
    met = both.mapInArrow(_met(flattening), f"pair_id {id_(pairs, 'pair_id')}, segment_id {id_(segments, 'segment_id')}, fraction double, lat double, lon double")
    # one crossing may be found from several cells and from both pieces that end in it
    return met.groupBy("pair_id", "segment_id").agg(F.min(F.struct("fraction", "lat", "lon")).alias("_m")).select("pair_id", "segment_id", "_m.fraction", "_m.lat", "_m.lon")


def plane_edges(edges: DataFrame, most_deg: float = 0.25) -> DataFrame:
    """Edges that run straight in longitude and latitude, as polygon files mean them, cut into sides of most_deg at most, with a segment_id of their own; other columns stay.

    A geodesic along such a side strays from it by a metre or two, so that crossings, distances and
    covered_by() see one coast.
    """
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lat_b") - F.col("lat_a")), F.abs(F.col("lon_b") - F.col("lon_a"))) / most_deg).cast("int"))
    each = edges.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    ends = {"lat_a": at("lat_a", "lat_b", F.col("_k")), "lon_a": at("lon_a", "lon_b", F.col("_k")), "lat_b": at("lat_a", "lat_b", F.col("_k") + 1), "lon_b": at("lon_a", "lon_b", F.col("_k") + 1)}
    return each.withColumns({**ends, "segment_id": F.xxhash64("segment_id", "_k")}).drop("_n", "_k")


def merge_close(found: DataFrame, limit_km: float = 1.0) -> DataFrame:
    """Crossings of one pair with neighbours less than limit_km apart merged into their middle, one after another along the pair.

    Each merge compares with the merged place, so this is a fold over a pair's few crossings.
    """
    cells = F.array_sort(F.collect_list(F.struct("fraction", "segment_id", "lat", "lon")))

    def step(held: Column, c: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        near = (F.size(held) > 0) & (geo.distance_km(last["lat"], last["lon"], c["lat"], c["lon"]) < limit_km)
        lon = geo.wrap_longitude((last["lon"] + geo.unwrap_longitude(c["lon"], last["lon"])) / 2.0)
        mean = F.struct(((last["fraction"] + c["fraction"]) / 2.0).alias("fraction"), last["segment_id"].alias("segment_id"), ((last["lat"] + c["lat"]) / 2.0).alias("lat"), lon.alias("lon"))
        return F.when(near, F.concat(F.slice(held, F.lit(1), F.greatest(F.lit(0), F.size(held) - 1)), F.array(mean))).otherwise(F.concat(held, F.array(c)))

    empty = F.slice(F.col("_all"), 1, 0)
    folded = found.groupBy("pair_id").agg(cells.alias("_all")).withColumn("_m", F.explode(F.aggregate("_all", empty, step)))
    return folded.select("pair_id", "_m.segment_id", "_m.fraction", "_m.lat", "_m.lon")


def classify(found: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """found with crossing_type: landfall (sea before, land after), exit (land before, sea after), else tangent; the ground is looked up midway to the neighbouring crossings, on the pair's geodesic."""
    w = Window.partitionBy("pair_id").orderBy("fraction", "segment_id")
    f = found.withColumns({"_b": (F.coalesce(F.lag("fraction").over(w), F.lit(0.0)) + F.col("fraction")) / 2.0, "_a": (F.coalesce(F.lead("fraction").over(w), F.lit(1.0)) + F.col("fraction")) / 2.0, "_n": F.row_number().over(w)})
    f = f.join(pairs.select("pair_id", "a_lat", "a_lon", "b_lat", "b_lon"), "pair_id")
    probe = f.withColumns({"km": geo.exact_distance_km("a_lat", "a_lon", "b_lat", "b_lon"), "way": geo.exact_bearing_deg("a_lat", "a_lon", "b_lat", "b_lon")})
    probe = probe.withColumn("s", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("_b").alias("t")), F.struct(F.lit("after").alias("side"), F.col("_a").alias("t")))))
    probe = probe.withColumn("place", geo.destination("a_lat", "a_lon", "way", F.col("km") * F.col("s.t")))
    ground = covered_by(probe.select(F.struct("pair_id", "_n", F.col("s.side").alias("side")).alias("point_id"), F.col("place.latitude").alias("lat"), F.col("place.longitude").alias("lon")), edges)
    sides = ground.groupBy(F.col("point_id.pair_id").alias("pair_id"), F.col("point_id._n").alias("_n")).agg(F.max(F.when(F.col("point_id.side") == "before", F.col("is_land"))).alias("_lb"), F.max(F.when(F.col("point_id.side") == "after", F.col("is_land"))).alias("_la"))
    kind = F.when(~F.col("_lb") & F.col("_la"), "landfall").when(F.col("_lb") & ~F.col("_la"), "exit").otherwise("tangent")
    return f.join(sides, ["pair_id", "_n"]).withColumn("crossing_type", kind).drop("_b", "_a", "_n", "_lb", "_la", "a_lat", "a_lon", "b_lat", "b_lon")
