"""python -m galeframe.cli config check | catalog build | catalog plan | track"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from galeframe.operators import aggregates, schedule, sequences, tracking
from galeframe.operators.validation import IntegrityError, require_columns
from galeframe.pipelines import catalog, catalog_tables
from galeframe.sources import checkpoint, config, tables


def _spark() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config_check(a: argparse.Namespace) -> int:
    config.validate(config.load(a.path))
    return 0


def _build(a: argparse.Namespace) -> int:
    """Best tracks (CSV) and land (a polygon file), or contact rows and dense rows (Parquet), to the catalog's tables."""
    spark = _spark()
    if a.tracks:
        if not (a.coast and a.start and a.end):
            raise config.ConfigError("--tracks needs --coast, --start and --end")
        cfg = catalog.CatalogConfig(a.start, a.end, a.strong_kt, a.gap_hours, a.padding_hours, a.spacing_km, sample_km=a.sample_km)
        catalog_tables.write(spark, a.tracks, catalog_tables.land_edges(spark, a.coast, a.min_area), cfg, a.out, a.track_types.split(","))
        return 0
    if not (a.contacts and a.dense):
        raise config.ConfigError("give --tracks and --coast, or --contacts and --dense")
    contacts, dense = spark.read.parquet(a.contacts), spark.read.parquet(a.dense)
    grouped = sequences.sessions(contacts, "storm_id", "iso_time", "fix_id", a.gap_hours)
    tables.write_catalog(aggregates.episodes(grouped, dense, a.padding_hours, a.strong_kt), a.out)
    return 0


def _plan(a: argparse.Namespace) -> int:
    """Events (CSV) to a schedule of forecast cases."""
    s = config.validate(config.load(a.config))["forecast_sampling"]
    spark = _spark()
    events = require_columns(spark.read.option("header", True).csv(a.events), ["case_id", "storm_id", "reference_time"])
    events = events.withColumn("reference_time", F.to_timestamp("reference_time").cast("timestamp_ntz"))
    plan = schedule.schedule(events, s["lead_hours"], s.get("cycle_hours", (0, 6, 12, 18)), s.get("tolerance_hours", 3.0))
    plan.write.option("header", True).csv(a.out)
    return 0


def _track(a: argparse.Namespace) -> int:
    """Cases with seeds and grids (Parquet) to tracks. 1 if any input is broken.

    With --resume, results of the same run are kept: one whose case or grid files changed raises
    before anything is written, and cases with broken inputs are run again.
    """
    spark = _spark()
    cfg = tracking.TrackerConfig(a.search_km, a.disk_km, a.vorticity)
    keys = ["model", "forecast_case_id"]
    cases, grid = spark.read.parquet(a.cases).select(*keys, "forecast_hours", "seed_lat", "seed_lon"), spark.read.parquet(a.grid)
    chosen = cases.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cases.columns).cast("decimal(38,0)")).cast("string").alias("h")).first()
    run = checkpoint.fingerprint(config=vars(cfg), cases=[chosen["n"], chosen["h"]], form=1)
    shape = f"model string, forecast_case_id string, {tracking.POINT}, run string, fingerprint string, case_status string, written timestamp"
    done = checkpoint.stored_results(spark, a.out, shape)
    if not a.resume and not done.isEmpty():
        raise IntegrityError(f"{a.out} holds results; take another folder or --resume")
    for row in done.select("run").distinct().limit(2).collect():
        checkpoint.require_same_run(row["run"], run)
    marked = checkpoint.case_fingerprints(cases, grid, keys, run)
    now = checkpoint.latest(done, [*keys, "lead_hours"], "written")
    checkpoint.require_same_inputs(marked, now, keys)
    due = checkpoint.pending(marked, now, keys)
    points = tracking.track(due, grid, cfg)
    status = tracking.outcomes(points).select(*keys, "case_status")
    checkpoint.store(points.join(status, keys).join(due.select(*keys, "fingerprint"), keys).withColumns({"run": F.lit(run), "written": F.current_timestamp()}), a.out)
    held = checkpoint.latest(checkpoint.stored_results(spark, a.out, shape), [*keys, "lead_hours"], "written")
    return int(not held.where("case_status = 'input_error'").isEmpty())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="galeframe")
    top = p.add_subparsers(required=True)
    c = top.add_parser("config").add_subparsers(required=True).add_parser("check")
    c.add_argument("path")
    c.set_defaults(run=_config_check)
    of_catalog = top.add_parser("catalog").add_subparsers(required=True)
    b = of_catalog.add_parser("build")
    b.add_argument("--out", required=True)
    for name in ("--tracks", "--coast", "--start", "--end", "--contacts", "--dense"):
        b.add_argument(name)
    b.add_argument("--track-types", default="main,provisional")
    for name, value in (("--gap-hours", 6.0), ("--padding-hours", 6.0), ("--strong-kt", 64.0), ("--spacing-km", 10.0), ("--sample-km", 5.0), ("--min-area", 0.0)):
        b.add_argument(name, type=float, default=value)
    b.set_defaults(run=_build)
    s = of_catalog.add_parser("plan")
    for name in ("--config", "--events", "--out"):
        s.add_argument(name, required=True)
    s.set_defaults(run=_plan)
    t = top.add_parser("track")
    for name in ("--cases", "--grid", "--out"):
        t.add_argument(name, required=True)
    for name, value in (("--search-km", 445.0), ("--disk-km", 278.0), ("--vorticity", 5e-5)):
        t.add_argument(name, type=float, default=value)
    t.add_argument("--resume", action="store_true")
    t.set_defaults(run=_track)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (config.ConfigError, IntegrityError, AnalysisException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
