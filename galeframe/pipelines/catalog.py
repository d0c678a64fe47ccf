"""From best tracks and a coast to episodes of coastal contact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import aggregates, joins, sequences, spatial
from galeframe.operators import crossings as crossing
from galeframe.operators.lineage import kept

QUADRANTS = ("ne", "se", "sw", "nw")
KNOTS = (34, 50, 64)
RADII = tuple(f"r{kt}_{q}" for kt in KNOTS for q in QUADRANTS)


@dataclass(frozen=True)
class CatalogConfig:
    """The study period (ISO text, both ends included) and the limits of the catalog."""

    start: str
    end: str
    threshold_kt: float = 64.0
    episode_gap_hours: float = 6.0
    padding_hours: float = 6.0
    spacing_km: float = 10.0
    step_hours: float = 1.0
    track_gap_hours: float = 6.0
    proxy_km: float = 100.0
    sample_km: float = 5.0
    candidates: int = 16

    def period(self) -> tuple[Column, Column]:
        return F.to_timestamp_ntz(F.lit(self.start)), F.to_timestamp_ntz(F.lit(self.end))


def coast_distance(points: DataFrame, segments: DataFrame, samples: DataFrame, k: int, point_id: str = "point_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """point_id, distance_km, coast_lat, coast_lon of the nearest place on the coast, among the k segments whose samples are nearest."""
    return spatial.nearest_place(points, samples, segments, k, point_id, lat, lon).select(point_id, "distance_km", "coast_lat", "coast_lon")


def strong_storms(fixes: DataFrame, cfg: CatalogConfig) -> DataFrame:
    """storm_id, lifetime_vmax, track_types, provisional_track of storms that reach the threshold in their life and meet the padded period: one aggregate."""
    (start, end), pad, at = cfg.period(), int(cfg.padding_hours * scalar.HOUR_US), scalar.micros("iso_time")
    life = fixes.groupBy("storm_id").agg(F.max(scalar.finite("wind_kt")).alias("lifetime_vmax"), scalar.sorted_join("track_type").alias("track_types"), F.bool_or(F.lower("track_type") != "main").alias("provisional_track"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    met = (F.col("_hi") >= scalar.micros(start) - pad) & (F.col("_lo") <= scalar.micros(end) + pad)
    return life.where((F.col("lifetime_vmax") >= cfg.threshold_kt) & met).drop("_lo", "_hi")


def crossings(fixes: DataFrame, edges: DataFrame, cfg: CatalogConfig) -> DataFrame:
    """storm_id, crossing_time, crossing_type, lat, lon of the tracks' crossings of the coast."""
    p = sequences.consecutive_pairs(fixes, "storm_id", "iso_time", "fix_id", ["lat", "lon"], cfg.track_gap_hours).where("NOT gap")
    p = p.withColumn("pair_id", F.struct("storm_id", "segment"))
    pairs = p.select("pair_id", "a_lat", "a_lon", "b_lat", "b_lon")
    kinds = crossing.classify(crossing.merge_close(crossing.crossings(pairs, edges)), pairs, edges)
    when = scalar.micros("a_iso_time") + F.round((scalar.micros("b_iso_time") - scalar.micros("a_iso_time")) * F.col("fraction")).cast("long")
    timed = kinds.join(p.select("pair_id", "a_iso_time", "b_iso_time"), "pair_id")
    return timed.select("pair_id.storm_id", F.timestamp_micros(when).cast("timestamp_ntz").alias("crossing_time"), "crossing_type", "lat", "lon")


_POINT = ["source_segment", "fraction"]
_CONTACT = ["distance_km", "lat", "lon", "coast_lat", "coast_lon", "surface", "r34", "r50", "r64", "proxy", "landfall"]


def dense_points(fixes: DataFrame, edges: DataFrame, cfg: CatalogConfig) -> DataFrame:
    """The resampled tracks with ground, nearest coast, radii towards it and the contact flags but that of landfall."""
    dense = sequences.densify(fixes, ["wind_kt", *RADII], ["name", "basin", "nature", "track_type"], spacing_km=cfg.spacing_km, step_hours=cfg.step_hours, gap_hours=cfg.track_gap_hours)
    dense = spatial.with_shore(dense, edges, spatial.samples(edges, cfg.sample_km), cfg.candidates, ["storm_id", *_POINT])
    dense = dense.withColumn("bearing", geo.bearing_deg("lat", "lon", "coast_lat", "coast_lon"))
    for kt in KNOTS:
        radius = geo.quadrant_radius_km("bearing", *[f"r{kt}_{q}" for q in QUADRANTS])
        dense = dense.withColumn(f"r{kt}_km", radius).withColumn(f"r{kt}", ~F.col("is_land") & F.coalesce(F.col("distance_km") <= F.col(f"r{kt}_km"), F.lit(False)))
    proxy = ~F.col("is_land") & F.col("r34_km").isNull() & (F.col("distance_km") <= cfg.proxy_km)
    return dense.withColumns({"proxy": proxy, "r34_any": F.coalesce(*[f"r34_{q}" for q in QUADRANTS]).isNotNull()})


def build(fixes: DataFrame, edges: DataFrame, cfg: CatalogConfig, radii: bool = True) -> dict[str, DataFrame]:
    """cases, points and crossings.

    fixes: storm_id, fix_id, iso_time, lat, lon, wind_kt, twelve radii, name, basin, nature,
    track_type; edges: sides of land rings (ring_id, segment_id, lon_a, lat_a, lon_b, lat_b). A case
    is an episode of contact whose padded peak reaches the threshold and whose reference time, its
    first landfall or else its closest approach, lies in the period. radii: whether points come with
    their radii and the bearing of the coast, which make up half of what is kept of them.

    Points are kept once. What later steps need of them comes with the time they are met by or with
    the contacts, which are few, so that points are looked up by their ids for landfall only.
    """
    storms = kept(strong_storms(fixes, cfg))
    strong = fixes.join(storms.select("storm_id", "lifetime_vmax"), "storm_id")
    found = kept(crossings(strong, edges, cfg))
    dense = dense_points(strong, edges, cfg)
    dense = kept(dense if radii else dense.drop("bearing", *RADII, *[f"r{kt}_km" for kt in KNOTS])).withColumn("surface", scalar.surface("is_land"))
    same = ["storm_id", *_POINT]
    at = dense.select("storm_id", "iso_time", F.struct(*_POINT, "wind_kt").alias("point"))
    met = kept(joins.nearest_in_time(found, at, "storm_id", "crossing_time", "iso_time", "point").where("nearest IS NOT NULL"))
    with_wind = met.select(*found.columns, "nearest.wind_kt")
    hit = met.where("crossing_type = 'landfall'").select("storm_id", *[f"nearest.{c}" for c in _POINT]).distinct().withColumn("_hit", F.lit(True))
    # hit has one row an id at most, so that whoever does not ask for landfall does not pay for this join
    points = dense.withColumn("point_id", F.struct(*same)).join(hit, same, "left")
    points = points.select("point_id", *[c for c in dense.columns if c != "surface"], F.coalesce("_hit", F.lit(False)).alias("landfall"), "surface")
    contacts = kept(points.where("r34 OR proxy OR landfall").select("storm_id", "iso_time", F.col("point_id").alias("fix_id"), "wind_kt", *_CONTACT))
    contacts = sequences.sessions(contacts, "storm_id", "iso_time", "fix_id", cfg.episode_gap_hours)
    cases = kept(aggregates.episodes(contacts, dense, cfg.padding_hours, cfg.threshold_kt, with_wind, cfg.period()))
    place = contacts.select(F.col("fix_id").alias("closest_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("coast_lat").alias("_clat"), F.col("coast_lon").alias("_clon"), F.col("surface").alias("surface_at_closest"))
    shore = found.where("crossing_type = 'landfall'").groupBy("storm_id", F.col("crossing_time").alias("reference_time")).agg(F.min("lat").alias("_xlat"), F.min_by("lon", "lat").alias("_xlon"))
    at = dense.select("storm_id", "iso_time", F.struct(*_POINT, "name", "basin", F.col("wind_kt").alias("reference_vmax_kt"), F.col("nature").alias("nature_at_reference")).alias("point"))
    near = joins.nearest_in_time(cases.select("case_id", "storm_id", "reference_time"), at, "storm_id", "reference_time", "iso_time", "point")
    named = near.where("nearest IS NOT NULL").select("case_id", "nearest.*").drop(*_POINT)
    life = storms.select("storm_id", F.col("lifetime_vmax").alias("lifetime_vmax_kt"), "track_types", "provisional_track")
    out = cases.join(place, "closest_id").join(shore, ["storm_id", "reference_time"], "left").join(named, "case_id").join(life, "storm_id")
    land = F.col("reference_event") == "landfall"
    pick = lambda a, b: F.when(land, F.col(a)).otherwise(F.col(b))
    out = out.withColumns({"latitude": pick("_xlat", "_lat"), "longitude": pick("_xlon", "_lon"), "nearest_coast_latitude": pick("_xlat", "_clat"), "nearest_coast_longitude": pick("_xlon", "_clon"), "minimum_coast_distance_km": F.when(land, 0.0).otherwise(F.col("closest_km")), "primary_sample": F.col("tier").isin("A", "B"), "qc_status": F.lit("pending")})
    return {"cases": out.drop("closest_id", "_lat", "_lon", "_clat", "_clon", "_xlat", "_xlon"), "points": points, "crossings": found}
