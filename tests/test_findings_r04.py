"""What the fourth round of findings showed."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.operators import lineage, spatial
from galeframe.pipelines import catalog
from galeframe.plans import q_pipelines

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}


def test_f1_shuffle_files_go_when_a_table_is_kept(spark):
    before, setting = shuffle_files(spark), spark.conf.get(lineage._CLEANUP, None)
    held = lineage.kept(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(3, "count"))
    until = time.monotonic() + 20
    while shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and held.count() == 10 and spark.conf.get(lineage._CLEANUP, None) == setting


def test_f1_tracks_are_shuffled_once_before_points_are_kept(spark):
    fixes, edges = q_pipelines.catalog_inputs(spark, SF)
    dense = catalog.dense_points(fixes.repartition(2), edges, q_pipelines.PERIOD)
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan


@pytest.mark.parametrize("k", [1, 4, 64])
def test_f1_a_small_coast_gives_what_cells_give(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    rings = [(-180.0, -20.0, 12.0), (170.0, 10.0, 10.0), (0.0, 60.0, 29.0), (-3.0, -2.0, 6.0), (1.0, 0.0, 1.0)]
    rows = []
    for ring, (x, y, size) in enumerate(rings):
        for i, (a, b, c, d) in enumerate([(x, y, x + size, y), (x + size, y, x + size, y + size), (x + size, y + size, x, y + size), (x, y + size, x, y)]):
            rows += [(ring, 1000 * ring + 100 * i + j, a + (c - a) * j / 9, b + (d - b) * j / 9, a + (c - a) * (j + 1) / 9, b + (d - b) * (j + 1) / 9) for j in range(9)]
    edges = spark.createDataFrame(rows, "ring_id int, segment_id long, lon_a double, lat_a double, lon_b double, lat_b double")
    places = [(float(y), float(x)) for y, x in zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150), strict=True)]
    places += [(r[3], r[2]) for r in rows[::7]] + [(0.5, 1.5), (15.0, 180.0), (15.0, -180.0), (15.0, 179.9), (90.0, 0.0), (-90.0, 7.0), (-10.0, 180.0), (5.0, 540.0), (None, 1.0), (float("nan"), 1.0)]
    points = spark.createDataFrame([(i, f"p{i}", y, x) for i, (y, x) in enumerate(places)], "i int, name string, lat double, lon double").repartition(3)
    coast = spatial.samples(edges, 100.0)
    shored = lambda: {r.i: r for r in spatial.with_shore(points, edges, coast, k, ["i"]).collect()}
    here = shored()
    monkeypatch.setattr(spatial, "_WHOLE", 3)
    far = shored()
    assert here == far and len(here) == len(places) - 2 and 10 < sum(r.is_land for r in here.values()) < len(here)
    none = edges.where("ring_id < 0")
    assert spatial.with_shore(points, none, spatial.samples(none), k, ["i"]).count() == 0
