"""Polygon files: what partitions read, filters on area, rings that cross themselves."""

import struct

import pytest

from galeframe.operators import spatial
from galeframe.pipelines import catalog_tables
from galeframe.sources import scans, shapefile


def record(ring):
    return struct.pack("<i4d", 5, 0, 0, 0, 0) + struct.pack("<iii", 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)


def write(folder, rings, areas=None, index=False):
    shapes, body, places = [record(r) for r in rings], b"", b""
    for i, s in enumerate(shapes):
        places += struct.pack(">ii", (100 + len(body)) // 2, len(s) // 2)
        body += struct.pack(">ii", i + 1, len(s) // 2) + s
    head = struct.pack(">i", 9994) + b"\0" * 96
    (folder / "a.shp").write_bytes(head + body)
    if index:
        (folder / "a.shx").write_bytes(head + places)
    if areas is not None:
        fields = b"".join(name.ljust(11, b"\0") + b"N" + bytes(4) + bytes([width]) + bytes(15) for name, width in ((b"ID", 4), (b"area", 8)))
        rows = b"".join(b" " + b"%4d" % i + (b" " * 8 if a is None else b"%8.2f" % a) for i, a in enumerate(areas))
        (folder / "a.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(areas), 32 + len(fields) + 1, 13) + fields + b"\r" + rows)
    return str(folder / "a.shp")


def square(x, y, side=1.0):
    return [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]


@pytest.mark.parametrize("index", [False, True])
def test_filters_choose_records(spark, tmp_path, index):
    path = write(tmp_path, [square(k, 0) for k in range(6)], [5.0, 50.0, None, 7.5, 100.0, 0.25], index)
    for at in (path, f"file://{path}"):
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        df = scans.opened(spark, shapefile.ShapefileSource, at, records_per_partition=2)
        got = lambda d: sorted(r.record for r in d.collect())
        assert got(df) == [0, 1, 2, 3, 4, 5] and df.rdd.getNumPartitions() == 3
        large = scans.opened(spark, shapefile.ShapefileSource, at, {"area": (7.5, 50)}, records_per_partition=2)
        assert got(large) == [1, 3] and large.rdd.getNumPartitions() == 1
        assert got(df.where("area > 60").unionByName(df)) == [0, 1, 2, 3, 4, 4, 5] and got(df) == [0, 1, 2, 3, 4, 5]
        assert got(df.where("area = 5 OR area > 60")) == [0, 4] and got(df.where("area IS NULL")) == [2] and got(df.where("area > 1e9")) == []
        assert got(spark.read.format("polygons").option("min_area", 7.5).load(at)) == [1, 2, 3, 4]
        scans.register(spark, shapefile.ShapefileSource, pushdown=True)
        pushed = spark.read.format("polygons").option("pushdown", True).option("records_per_partition", 2).load(at).where("area >= 7.5 AND area < 100")
        assert got(pushed) == [1, 3] and pushed.rdd.getNumPartitions() == 1
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_partitions_read_their_own_bytes(tmp_path, monkeypatch):
    path = write(tmp_path, [square(k, 0) for k in range(6)], [1.0] * 6, True)
    reader = shapefile._Reader({"path": path, "records_per_partition": "2"})
    parts = reader.partitions()
    opened, asked = [], []

    class Counted:
        def __init__(self, name):
            opened.append(name)
            self.f = open(name, "rb")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            asked.append(n)
            return self.f.read(n)

    monkeypatch.setattr(shapefile, "_open", Counted)
    assert [r[0] for r in reader.read(parts[1])] == [2, 3]
    assert opened == [path] and asked == [len(record(square(0, 0)))] * 2


def test_a_file_cut_off_raises(tmp_path):
    path = write(tmp_path, [square(0, 0), square(1, 0)])
    data = (tmp_path / "a.shp").read_bytes()
    (tmp_path / "a.shp").write_bytes(data[:-4])
    with pytest.raises(ValueError, match="beyond"):
        shapefile.record_offsets(path)


RINGS = {
    "bow-tie": [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)],
    "spike": [(10, 0), (10, 2), (12, 2), (12, 0), (11, 0), (11, -2), (11, 0), (10, 0)],
    "touching hole": [(20, 0), (20, 4), (24, 4), (24, 0), (22, 0), (23, 2), (21, 2), (22, 0), (20, 0)],
    "twice around": [(30, 0), (30, 4), (34, 4), (34, 0), (30, 0), (31, 1), (31, 3), (33, 3), (33, 1), (31, 1), (30, 0)],
}
POINTS = [
    (1, 0.5, 0.25, False), (2, 0.25, 1.0, True), (3, 1.75, 1.0, True), (4, 1.0, 1.0, True), (5, 1.0, 0.5, False),  # lobes left and right, meeting in the middle
    (6, 11.0, 1.0, True), (7, 11.0, -1.0, True), (8, 11.1, -1.0, False), (9, 11.0, -2.1, False),
    (10, 22.0, 1.5, False), (11, 22.0, 0.0, True), (12, 20.5, 1.0, True), (13, 22.0, 3.0, True), (14, 21.0, 2.0, True),
    (15, 30.5, 2.0, True), (16, 32.0, 2.0, False), (17, 31.0, 2.0, True),
]


def test_rings_that_cross_themselves(spark, tmp_path):
    scans.register(spark, shapefile.ShapefileSource)
    path = write(tmp_path, [[(float(x), float(y)) for x, y in r] for r in RINGS.values()])
    edges = shapefile.ring_edges(spark.read.format("polygons").load(path))
    p = spark.createDataFrame([(i, float(y), float(x)) for i, x, y, _ in POINTS], "point_id int, lat double, lon double")
    want = {i: land for i, _, _, land in POINTS}
    assert {r.point_id: r.is_land for r in spatial.covered_by(p, edges).collect()} == want
    # the catalog's edges, cut short, cover the same
    assert {r.point_id: r.is_land for r in spatial.covered_by(p, catalog_tables.land_edges(spark, path)).collect()} == want
