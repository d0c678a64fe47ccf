"""The seeded cyclone tracker.

A track is followed lead by lead, all cases at once. The state is one place a case. A step joins the
places with the cells of their own fields at that lead, by tiles, so that it reads a box of bounded
size however late the lead, and a small numpy function picks the lows where the tracks go on, those of
a batch of boxes at once. Each step's points are checkpointed: lost executors repeat one step, and the next starts from a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from galeframe.functions import geo
from galeframe.operators import grid as g
from galeframe.operators import runs
from galeframe.operators.lineage import kept

POINT = "lead_hours int, latitude double, longitude double, msl_hpa double, vmax10_ms double, cyclonic_vorticity_s double, status string, reason string"
KEYS = ("model", "forecast_case_id")
FIELD = (*KEYS, "lead_hours")
STEP_HOURS = 6
HALO_CELLS = 2


@dataclass(frozen=True)
class TrackerConfig:
    """Search radius (inclusive), radius of the disk for diagnostics, and the vorticity that must be exceeded."""

    search_radius_km: float = 445.0
    diagnostic_radius_km: float = 278.0
    vorticity_threshold_s: float = 5e-5

    def __post_init__(self):
        if min(self.search_radius_km, self.diagnostic_radius_km) <= 0 or self.vorticity_threshold_s < 0:
            raise ValueError("radii must be positive and the threshold not negative")


def planned(cases: DataFrame) -> DataFrame:
    """A row for each lead 6, 12 .. forecast_hours of a case, with its seed; a horizon that is not in whole steps, or a seed off the globe, raises at run time."""
    hours = F.col("forecast_hours").cast("int")
    leads = F.when((hours >= STEP_HOURS) & (hours % STEP_HOURS == 0), F.sequence(F.lit(STEP_HOURS), F.greatest(hours, F.lit(STEP_HOURS)), F.lit(STEP_HOURS))).otherwise(F.raise_error(F.lit("leads must be every six hours from 6")).cast("array<int>"))
    there = F.col("seed_lat").isNotNull() & F.col("seed_lon").isNotNull() & ~F.isnan("seed_lat") & ~F.isnan("seed_lon")
    on_globe = (F.abs("seed_lat") < 90) & (F.abs("seed_lon") < float("inf"))
    lat = F.when(there & ~on_globe, F.raise_error(F.lit("the seed lies outside the globe")).cast("double")).when(there, F.col("seed_lat"))
    return cases.select(*KEYS, F.explode(leads).alias("lead_hours"), lat.alias("seed_lat"), F.when(there, F.col("seed_lon")).alias("seed_lon"))


def fields(cells: DataFrame) -> DataFrame:
    """One row a field: whether each pair of its latitudes and longitudes has one cell, and the largest steps between them, dy and dx."""
    step = lambda a: F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - 1)), lambda k: F.get(a, k) - F.get(a, k - 1))), F.lit(0.0))
    held = cells.groupBy(*FIELD).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("latitude")).alias("ys"), F.array_sort(F.collect_set("longitude")).alias("xs"))
    return held.select(*FIELD, (F.col("n") == F.size("ys") * F.size("xs")).alias("whole"), step(F.col("ys")).alias("dy"), step(F.col("xs")).alias("dx"))


@dataclass
class Window:
    """A part of a field: latitudes in the file's order, longitudes rising and unwrapped around the centre, fields by (latitude, longitude); missing is NaN."""

    latitude: np.ndarray
    longitude: np.ndarray
    fields: dict[str, np.ndarray]


def _vorticity(y: np.ndarray, x: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(dv/dlon - d(u cos lat)/dlat) / (a cos lat) of fields of the same axes (field, y, x), second order to the edges; NaN at poles."""
    if min(len(y), len(x)) < 3:
        raise ValueError("vorticity needs three latitudes and longitudes at least")
    cosine = np.cos(np.radians(y))[:, None]
    turn = np.gradient(v, np.radians(x), axis=2, edge_order=2) - np.gradient(u * cosine, np.radians(y), axis=1, edge_order=2)
    return np.where(np.abs(cosine) > 1e-10, turn / (g.EARTH_M * np.where(np.abs(cosine) > 1e-10, cosine, 1.0)), np.nan)


def _lows(p: np.ndarray) -> np.ndarray:
    """Where a cell of a field (field, y, x) is lowest of a complete, finite 3 x 3 neighbourhood that is not flat."""
    out = np.zeros(p.shape, bool)
    if min(p.shape[1:]) < 3:
        return out
    around = np.lib.stride_tricks.sliding_window_view(p, (3, 3), axis=(1, 2))
    least, most = around.min(axis=(3, 4)), around.max(axis=(3, 4))
    with np.errstate(invalid="ignore"):
        out[:, 1:-1, 1:-1] = np.isfinite(around).all(axis=(3, 4)) & (p[:, 1:-1, 1:-1] == least) & (least < most)
    return out


def _alike(which: Sequence[int], kind: Callable[[int], Hashable]) -> list[list[int]]:
    """Numbers of windows in groups of one kind."""
    out: dict[Hashable, list[int]] = {}
    for k in which:
        out.setdefault(kind(k), []).append(k)
    return list(out.values())


def _candidates(windows: Sequence[Window], places: np.ndarray, cfg: TrackerConfig) -> dict[int, list[tuple[float, float, float]]]:
    """Lows (latitude, longitude, pressure) of each window that has some within the search radius of its place, in the order in which they are tried."""
    found = []
    for at in _alike(range(len(windows)), lambda k: windows[k].fields["msl"].shape):
        p = np.stack([windows[k].fields["msl"] for k in at])
        n, iy, ix = np.nonzero(_lows(p))
        y, x = (np.stack([getattr(windows[k], axis) for k in at])[n, i] for axis, i in (("latitude", iy), ("longitude", ix)))
        found.append((np.array(at)[n], y, x, p[n, iy, ix]))
    k, y, x, p = (np.concatenate(c) for c in zip(*found, strict=True))
    km = geo.inverse(places[k, 0], places[k, 1], y, x)[0]
    out: dict[int, list[tuple[float, float, float]]] = {}
    for i in np.lexsort((x, y, km, p)):
        if km[i] <= cfg.search_radius_km:
            out.setdefault(int(k[i]), []).append((float(y[i]), float(x[i]), float(p[i])))
    return out


def next_centers(windows: Sequence[Window], places: Sequence[tuple[float, float]], cfg: TrackerConfig) -> list[tuple[dict | None, str]]:
    """For each window and the place where its track stands: (the low where it goes on, why there is none). That is the first in order of pressure, distance, latitude and longitude within the search radius whose disk is complete and turns fast enough."""
    out: list[tuple[dict | None, str]] = [(None, "no_pressure_minimum")] * len(windows)
    if not windows:
        return out
    lows = _candidates(windows, np.array(places, float).reshape(-1, 2), cfg)
    turns: dict[int, np.ndarray] = {}
    for at in _alike(list(lows), lambda k: (windows[k].latitude.tobytes(), windows[k].longitude.tobytes())):
        w = windows[at[0]]
        turns |= dict(zip(at, _vorticity(w.latitude, w.longitude, *(np.stack([windows[k].fields[f] for k in at]) for f in ("u850", "v850"))), strict=True))
    band = math.degrees(cfg.diagnostic_radius_km / geo.LEAST_RADIUS_KM)
    out = [(None, "vorticity_below_threshold") if k in lows else o for k, o in enumerate(out)]
    tried = 0
    while lows:
        rows = {k: np.abs(windows[k].latitude - c[tried][0]) <= band for k, c in lows.items()}
        yy = [np.repeat(windows[k].latitude[r], len(windows[k].longitude)) for k, r in rows.items()]
        xx = [np.tile(windows[k].longitude, int(r.sum())) for k, r in rows.items()]
        size = [len(v) for v in yy]
        at = [np.repeat([c[tried][i] for c in lows.values()], size) for i in (0, 1)]
        near = np.split(geo.inverse(*at, np.concatenate(yy), np.concatenate(xx))[0] <= cfg.diagnostic_radius_km, np.cumsum(size)[:-1])
        for (k, r), disk in zip(rows.items(), near, strict=True):
            (y, x, p), w = lows[k][tried], windows[k]
            turn = turns[k][r].ravel()[disk]
            wind = np.hypot(w.fields["u10"][r].ravel()[disk], w.fields["v10"][r].ravel()[disk])
            if not np.isfinite(turn).all() or not np.isfinite(wind).all():
                out[k] = None, "missing_diagnostic_data"
                continue
            cyclonic = float((turn if (y or places[k][0]) >= 0 else -turn).max())
            if cyclonic > cfg.vorticity_threshold_s:
                out[k] = {"latitude": y, "longitude": (x + 180) % 360 - 180, "msl_hpa": p / 100, "vmax10_ms": float(wind.max()), "cyclonic_vorticity_s": cyclonic}, ""
        tried += 1
        lows = {k: c for k, c in lows.items() if out[k][0] is None and tried < len(c)}
    return out


_CELL = ("msl", "u850", "v850", "u10", "v10")


def _window_of(cells: dict[str, np.ndarray], rows: slice) -> Window:
    """A box of cells, sorted by latitude and longitude, as arrays."""
    y = np.unique(cells["latitude"][rows])
    x = np.unique(cells["longitude"][rows])
    return Window(y, x, {f: cells[f][rows].reshape(len(y), len(x)) for f in _CELL})


def _step(cfg: TrackerConfig, shape: pa.Schema):
    """For mapInArrow: the boxes of cases at one lead, cells sorted by case, latitude and longitude, to their points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bounds in runs.whole(batches, KEYS):
            cells = {c: columns[c].to_numpy(zero_copy_only=False).astype(float) for c in ("c_lat", "c_lon", "latitude", "longitude", *_CELL)}
            first = bounds[:-1]
            windows = [_window_of(cells, slice(a, b)) for a, b in zip(first, bounds[1:], strict=True)]
            found = next_centers(windows, list(zip(cells["c_lat"][first].tolist(), cells["c_lon"][first].tolist(), strict=True)), cfg)
            out = {k: columns[k].take(pa.array(first)).cast(shape.field(k).type) for k in FIELD}
            out |= {f.name: pa.array([at and at[f.name] for at, _ in found], f.type) for f in shape if f.name not in (*FIELD, "status", "reason")}
            out |= {"status": ["ok" if at else "track_lost" for at, _ in found], "reason": [why for _, why in found]}
            yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in shape}, schema=shape)

    return run


def track(cases: DataFrame, grid: DataFrame, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """model, forecast_case_id and a point for each lead of 6 .. forecast_hours.

    cases: model, forecast_case_id, forecast_hours, seed_lat, seed_lon; grid: the cells of all
    forecasts (model, forecast_case_id, lead_hours, latitude, longitude and the fields). A track
    starts at its seed, moves to the first low in order of pressure, distance, latitude and longitude
    that lies within the search radius and turns fast enough, and is never found again once lost; a
    lead whose field is absent or incomplete ends it too. Cases without a seed never meet the grid.
    The steps run at once, the last only when the points are asked for.
    """
    plan = planned(cases)
    spark = plan.sparkSession
    sown = kept(plan.where("seed_lat IS NOT NULL"))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude", "msl_hpa", "vmax10_ms", "cyclonic_vorticity_s")]
    bare = plan.where("seed_lat IS NULL").select(*FIELD, *nothing, F.lit("no_seed").alias("status"), F.lit("no_exact_main_best_track_at_initialization").alias("reason"))
    cells = grid.select(*FIELD, "latitude", "longitude", *_CELL).join(sown.select(*FIELD, "seed_lon"), list(FIELD))
    shapes = kept(fields(cells.withColumn("longitude", geo.unwrap_longitude("longitude", "seed_lon"))))
    last = sown.agg(F.max("lead_hours")).first()[0] or 0
    shape = f"model string, forecast_case_id string, {POINT}"
    places = sown.where(F.col("lead_hours") == STEP_HOURS).select(*KEYS, F.col("seed_lat").alias("c_lat"), F.col("seed_lon").alias("c_lon"))
    steps = [spark.createDataFrame([], shape)]
    for h in range(STEP_HOURS, last + 1, STEP_HOURS):
        due = sown.where(F.col("lead_hours") == h).select(*FIELD).join(places, list(KEYS)).join(shapes, list(FIELD), "left")
        boxes = g.windows(due.where("whole"), grid.where(F.col("lead_hours") == h).select(*FIELD, "latitude", "longitude", *_CELL), FIELD, cfg.search_radius_km + cfg.diagnostic_radius_km, F.col("dy") * HALO_CELLS, F.col("dx") * HALO_CELLS)
        met = runs.dealt(boxes.select(*FIELD, "c_lat", "c_lon", "latitude", "longitude", *_CELL), KEYS, ("latitude", "longitude")).mapInArrow(_step(cfg, to_arrow_schema(steps[0].schema)), shape)
        error = F.when(F.col("whole").isNull(), "no field").when(~F.col("whole"), "the grid has missing or repeated cells")
        points = due.select(*FIELD, error.alias("_e")).join(met.withColumnRenamed("status", "_s").withColumnRenamed("reason", "_r"), list(FIELD), "left")
        status = F.when(F.col("_e").isNotNull(), "input_error").otherwise(F.coalesce("_s", F.lit("track_lost")))
        reason = F.when(F.col("_e").isNotNull(), F.concat(F.lit(f"input_error_at_{h}h: "), F.col("_e"))).otherwise(F.coalesce("_r", F.lit("no_pressure_minimum")))
        points = points.withColumns({"status": status, "reason": reason}).drop("_e", "_s", "_r").select(*steps[0].columns)
        points = points if h == last else kept(points)
        steps.append(points)
        if h == last:
            break
        places = points.where("status = 'ok'").select(*KEYS, F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))
        if places.limit(1).isEmpty():
            break
    followed = reduce(DataFrame.unionByName, steps)
    # nothing is over after the last lead: the last step, which runs when it is asked for, is not asked for twice
    ends = reduce(DataFrame.unionByName, steps[: last // STEP_HOURS] or steps).where("status <> 'ok'").select(*KEYS, F.col("lead_hours").alias("_end"), F.when(F.col("status") == "input_error", F.col("reason")).otherwise(F.concat(F.lit("tracking_stopped_at_"), F.col("lead_hours"), F.lit("h: "), F.col("reason"))).alias("reason"))
    over = sown.select(*FIELD).join(ends, list(KEYS)).where("lead_hours > _end").select(*FIELD, *nothing, F.lit("terminated").alias("status"), "reason")
    return followed.unionByName(over).unionByName(bare)


def outcomes(points: DataFrame) -> DataFrame:
    """One row a case: counts of statuses, last lead tracked, first failure; the case's status is the first that is not ok."""
    bad = F.col("status") != "ok"
    return points.groupBy("model", "forecast_case_id").agg(
        F.count("*").cast("long").alias("planned_points"), F.count_if(~bad).alias("ok_points"), F.max(F.when(~bad, F.col("lead_hours"))).alias("last_ok_lead"),
        F.min(F.when(bad, F.struct("lead_hours", "status", "reason"))).alias("_b"),
    ).select("model", "forecast_case_id", "planned_points", "ok_points", "last_ok_lead", F.coalesce("_b.status", F.lit("complete")).alias("case_status"), F.coalesce("_b.reason", F.lit("")).alias("case_reason"))
