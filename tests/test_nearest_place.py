"""One row a point leaves the search for the nearest place of a coast."""

import pytest
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators import spatial
from galeframe.pipelines import catalog


def _tables(spark):
    points = spark.range(400).selectExpr("id AS point_id", "-80 + (id * 37) % 160 + id / 1000 AS lat", "-180 + (id * 53) % 360 + id / 500 AS lon")
    edge = spark.range(60).selectExpr("id AS segment_id", "-180.0D + id * 6 AS lon_a", "-40.0D + (id * 7) % 80 AS lat_a", "-180.0D + id * 6 + 5 AS lon_b", "-38.0D + (id * 7) % 80 AS lat_b")
    return points, edge


@pytest.mark.parametrize("k", [1, 4, 100])
def test_f1_f2_f16_the_same_place_as_of_all_candidates(spark, k):
    points, edges = _tables(spark)
    some = spatial.samples(edges, 200.0)
    want = {r.point_id: r for r in spatial.distance_to_segments(spatial.nearest_segments(points, some, k, carry=["lat", "lon"]), edges).collect()}
    got = spatial.nearest_place(points, some, edges, k).join(edges, "segment_id").join(points, "point_id").withColumn("km", geo.distance_km("lat", "lon", "coast_lat", "coast_lon")).collect()
    assert len(got) == len(want) == 400
    for r in got:
        w = want[r.point_id]
        assert r.segment_id == w.segment_id and r.distance_km == pytest.approx(w.distance_km, abs=1e-9) and r.fraction == pytest.approx(w.fraction, abs=1e-9)
        assert r.coast_lat == pytest.approx(r.lat_a + r.fraction * (r.lat_b - r.lat_a), abs=1e-12)


def test_f1_f2_one_row_a_point_leaves_the_search(spark, monkeypatch):
    left, plain = spark.sparkContext.accumulator(0), spatial._compared

    def counting(*args):
        inner = plain(*args)

        def run(batches):
            for b in inner(batches):
                left.add(b.num_rows)
                yield b

        return run

    monkeypatch.setattr(spatial, "_compared", counting)
    points, edges = _tables(spark)
    assert catalog.coast_distance(points, edges, spatial.samples(edges, 200.0), 8).agg(F.count_if(F.col("distance_km") >= 0)).first()[0] == 400
    assert left.value == 400
