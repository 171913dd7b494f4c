"""Files written by the tests themselves, read back."""

import struct

import pytest

from cloudframe.sources import readers
from cloudframe.streaming.scans import stream_xyz


def test_pts_blocks(spark, tmp_path):
    (tmp_path / "a.pts").write_text("2\n1 2 3\n4 5 6\n1\n7 8 9 100 1 2 3\n")
    merged = readers.read_pts(spark, str(tmp_path / "a.pts"))
    assert merged.count() == 3 and merged.where("intensity = 100 and b = 3").count() == 1
    split = readers.read_pts(spark, str(tmp_path / "a.pts"), merge=False)
    assert sorted((r.cloud_id[-1], r.point_id, r.x) for r in split.collect()) == [("1", 0, 1.0), ("1", 1, 4.0), ("2", 0, 7.0)]


def test_ptx(spark, tmp_path):
    head = "2\n1\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n5 6 7 1\n"
    (tmp_path / "s.ptx").write_text(head + "1 2 3 0.5\n0 0 0 0.1\n" + head + "4 5 6 0.25\n7 8 9 0.5\n")
    points, poses = readers.read_ptx(spark, str(tmp_path / "s.ptx"))
    assert sorted((r.x, r.intensity) for r in points.collect()) == [(1.0, 0.5), (4.0, 0.25), (7.0, 0.5)]
    assert [r.m[12:] for r in poses.collect()] == [[5.0, 6.0, 7.0, 1.0]] * 2


def test_asc_grid_normals_and_cameras(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 -9999\n4 5 6\n")
    raster, meta = readers.read_asc_grid(spark, str(tmp_path / "g.asc"))
    assert sorted((r.row, r.col, r.value) for r in raster.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)]
    assert meta.first().cellsize == 2 and meta.first().nodata == -9999
    (tmp_path / "n.txt").write_text("0 0 1\n1 0 0\n")
    assert [(r.point_id, r.nx) for r in readers.read_normals(spark, str(tmp_path / "n.txt")).orderBy("point_id").collect()] == [(0, 0.0), (1, 1.0)]
    (tmp_path / "c.mat").write_text("1 2 3 4\n5 6 7 8\n9 10 11 12\n")
    assert readers.read_projection_matrix(spark, str(tmp_path / "c.mat")).first().m == [float(i) for i in range(1, 13)]


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian"])
def test_ply(spark, tmp_path, form):
    head = f"ply\nformat {form} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty float reflectance\nend_header\n".encode()
    body = b"1 2 3 0.5\n4 5 6 0.25\n" if form == "ascii" else struct.pack("<8f", 1, 2, 3, 0.5, 4, 5, 6, 0.25)
    (tmp_path / "v.ply").write_bytes(head + body)
    assert [(r.x, r.z, r.intensity) for r in readers.load(spark, str(tmp_path / "v.ply")).orderBy("point_id").collect()] == [(1.0, 3.0, 0.5), (4.0, 6.0, 0.25)]


def test_las(spark, tmp_path):
    header = bytearray(227)
    struct.pack_into("<I", header, 96, 227)
    struct.pack_into("<BH", header, 104, 0, 20)
    struct.pack_into("<I", header, 107, 2)
    struct.pack_into("<6d", header, 131, 0.01, 0.01, 0.01, 100, 200, 0)
    record = lambda x, y, z, i, c: struct.pack("<iiiHBBBBH", x, y, z, i, 0, c, 0, 0, 0)
    (tmp_path / "p.las").write_bytes(bytes(header) + record(100, 200, 300, 7, 2) + record(-100, 0, 50, 9, 6))
    (tmp_path / "broken.las").write_bytes(b"LAS")
    (tmp_path / "packed.las").write_bytes(bytes(header[:104]) + b"\x80" + bytes(header[105:]))
    points, rejected = readers.read_many(spark, str(tmp_path), "las", records_per_task=1)
    assert points.rdd.getNumPartitions() == 2 and sorted((r.path[-5:], r.point_id, r.label) for r in points.collect()) == [("p.las", 0, 2), ("p.las", 1, 6)]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rejected.collect()) == ["broken.las", "packed.las"]
    with pytest.raises(ValueError):
        readers.read_las(spark, str(tmp_path))
    rows = readers.read_las(spark, str(tmp_path / "p.las")).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z, r.intensity, r.label) for r in rows] == [(101.0, 202.0, 3.0, 7.0, 2), (99.0, 200.0, 0.5, 9.0, 6)]


def test_ply_by_ranges(spark, tmp_path):
    import numpy as np
    n = 2_345
    table = np.zeros(n, np.dtype([("x", "<f8"), ("flag", "u1"), ("y", "<f4"), ("z", "<i4")]))
    table["x"], table["flag"], table["z"] = np.arange(n) / 2, np.arange(n) % 7, -np.arange(n)
    head = (f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty double x\nproperty uchar flag\nproperty float y\n"
            "property int z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n")
    (tmp_path / "a b.ply").write_bytes(head.encode() + table.tobytes() + b"\x03" + bytes(12))
    (tmp_path / "t.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float z\nproperty float y\nproperty float x\nend_header\n1 2 3\n9 9 9\n")
    rows = readers.read_ply(spark, str(tmp_path), ("flag",), records_per_task=500)
    got = {(r.path.rsplit("/", 1)[1], r.point_id): (r.x, r.z, r.intensity, r.flag) for r in rows.collect()}
    want = {("a b.ply", i): (i / 2, -i, None, i % 7) for i in range(n)}
    assert got == {**want, ("t.ply", 0): (3.0, 1.0, None, None)}
    assert readers.read_ply(spark, str(tmp_path / "a*.ply"), records_per_task=500).rdd.getNumPartitions() == 5
    (tmp_path / "short.ply").write_bytes(head.encode() + table.tobytes()[:100])
    with pytest.raises(Exception, match="ends before record"):
        readers.read_ply(spark, str(tmp_path / "short.ply")).collect()


def test_stream_of_scans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xyz").write_text("p1 1 2 3\np2 4 5\n")
    query = stream_xyz(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("scans").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("scans").collect())) == [("p1", 1.0, 2.0, 3.0), ("p2", 4.0, 5.0, 0.0)]
