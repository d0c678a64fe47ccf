"""The catalog from its files to its tables: best-track CSV and land polygons in, cases, storms, points and a manifest out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators import rollups
from galeframe.operators.crossings import plane_edges
from galeframe.operators.lineage import kept
from galeframe.pipelines import catalog
from galeframe.sources import best_track, scans, shapefile

#: The table of the catalog that each name stands for: which cases, or which storms' cases.
VIEWS = {"cases": "true", "primary_cases": "primary_sample", "main_cases": "NOT provisional_track", "main_primary_cases": "primary_sample AND NOT provisional_track"}


def fixes_of(tracks: DataFrame) -> DataFrame:
    """Best-track rows under the names that the catalog uses."""
    named = {"storm_id": "SID", "fix_id": "SOURCE_ROW", "iso_time": "ISO_TIME", "lat": "LAT", "lon": "LON", "wind_kt": "USA_WIND", "name": "NAME", "basin": "BASIN", "nature": "NATURE", "track_type": "TRACK_TYPE_NORMALIZED"}
    radii = {f"r{kt}_{q}": f"USA_R{kt}_{q.upper()}" for kt in catalog.KNOTS for q in catalog.QUADRANTS}
    return tracks.select(*[F.col(c).alias(n) for n, c in named.items()], *[(F.col(c) if c in tracks.columns else F.lit(None)).cast("double").alias(n) for n, c in radii.items()])


def land_edges(spark: SparkSession, path: str, min_area: float = 0.0) -> DataFrame:
    """The sides of the land rings of a polygon file, cut short."""
    rings = scans.opened(spark, shapefile.ShapefileSource, path, min_area=str(min_area))
    return plane_edges(shapefile.ring_edges(rings))


def _flat(df: DataFrame) -> DataFrame:
    """Columns that CSV can hold."""
    return df.select(*[F.col(c) for c, t in df.dtypes if not t.startswith(("struct", "array", "map"))])


def write(spark: SparkSession, tracks: str, edges: DataFrame, cfg: catalog.CatalogConfig, out: str, kinds: Sequence[str] = ("main", "provisional")) -> DataFrame:
    """Build the catalog and write its tables as folders under out, which must not hold them yet; gives the manifest.

    Folders: cases, primary_cases, main_cases, main_primary_cases, storms, primary_storms (CSV with
    headers), points (gzipped CSV), manifest (one JSON record: what was read, the quality of the
    source, the settings, the twenty measures). Cases and points are computed once.
    """
    everything = kept(best_track.read(spark, tracks))
    made = catalog.build(fixes_of(best_track.select_track_types(everything, kinds)), edges, cfg)
    cases, points = kept(made["cases"]), made["points"]
    put = lambda df, name, **options: _flat(df).write.mode("errorifexists").option("header", True).options(**options).csv(f"{out}/{name}")
    for name, which in VIEWS.items():
        put(cases.where(which), name)
    storms = kept(rollups.storm_catalog(cases))
    put(storms, "storms")
    put(storms.where("primary_sample"), "primary_storms")
    put(points, "points", compression="gzip")
    radii = [c for c in best_track.RADII if c in everything.columns]
    quality = rollups.source_measures(everything, "SID", "ISO_TIME", "USA_WIND", tuple(c if c in everything.columns else o for c, o in (("USA_LAT", "LAT"), ("USA_LON", "LON"))), radii or ["USA_WIND"], "TRACK_TYPE")
    digest = everything.agg(F.sum(F.xxhash64(*everything.columns).cast("decimal(38,0)")).cast("string").alias("rows_digest"))
    coast = edges.agg(F.count("*").alias("sides"), F.countDistinct("ring_id").alias("rings"), F.sum(F.xxhash64("lon_a", "lat_a", "lon_b", "lat_b").cast("decimal(38,0)")).cast("string").alias("sides_digest"))
    whole = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    settings = F.create_map(*(F.lit(x) for k, v in vars(cfg).items() for x in (k, str(v))))
    record = whole(rollups.catalog_measures(cases, points), "summary").join(whole(quality.join(digest), "tracks")).join(whole(coast, "coast"))
    record = record.select(F.lit(tracks).alias("tracks_path"), F.array(*[F.lit(k) for k in kinds]).alias("track_types"), settings.alias("settings"), "tracks", "coast", "summary")
    record.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{out}/manifest")
    return spark.read.schema(record.schema).json(f"{out}/manifest")
