"""No point is lost, no limit cuts a result, and clouds without extent break nothing."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cloudframe import skew
from cloudframe.operators import features, fitting, graph, joins, linkage, points, polygons, saliency, segments, tensors
from cloudframe.sources import readers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lonely(spark):
    """Three near points (one of them twice), a lone one, and NULL coordinates."""
    rows = [("a", 0.0, 0.0, 0.0), ("b", 0.1, 0.0, 0.0), ("c", 0.0, 0.1, 0.0), ("c2", 0.0, 0.1, 0.0), ("lone", 9.0, 9.0, 9.0), ("n1", None, 1.0, 1.0), ("n2", None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "point_id string, x double, y double, z double")


def test_lone_and_null_points_are_kept(lonely):
    places = joins.positions(lonely)
    edges = joins.radius_neighbors(places, 0.5, carry=("m",))
    got = {r.point_id: r for r in joins.per_point(lonely, tensors.tensor_from_neighbors(edges, points=places)).collect()}
    assert len(got) == 7 and got["a"].n == 3 and got["c"].n == got["c2"].n == 2
    for name in ("lone", "n1", "n2", "c"):
        assert (got[name].n == 0 or name == "c") and [got[name][c] for c in ("cxx", "cyy", "czz", "cxy")] == [1, 1, 1, 0]
    stats = {r.point_id: (r.n, r.mean_radius) for r in joins.per_point(lonely, tensors.neighborhood_stats(edges, places)).collect()}
    assert stats["lone"] == stats["n1"] == (0, 0.0)
    valid = joins.per_point(lonely, features.neighborhood_valid(edges, points=places)).collect()
    assert len(valid) == 7 and not any(r.valid for r in valid)
    bent = joins.per_point(lonely, features.umbrella_from_neighbors(places, edges)).collect()
    assert len(bent) == 7 and all(r.umbrella is None for r in bent)
    assert tensors.average_neighborhood(edges, places).first().mean_size >= 1


def test_histograms_of_points_without_neighbours(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("b", 5.0, 5.0, 5.0, 0.0, 0.0, 1.0)], "point_id string, x double, y double, z double, nx double, ny double, nz double")
    both = df.withColumns({f"c{n}": F.col(n) for n in ("nx", "ny", "nz")})
    edges = joins.radius_neighbors(both, 1.0, carry=("nx", "ny", "nz"), carry_left=("cnx", "cny", "cnz"))
    got = saliency.spfh(edges, points=df).collect()
    assert len(got) == 2 and all(r.n == 0 and r.h == [0.0] * 33 for r in got)


def test_flagship_query_returns_every_point(spark):
    assert __spark_entry__.entry(spark).count() == 6000


def test_umbrella_in_one_pass_is_the_one_in_three(spark):
    rng = random.Random(4)
    rows = [(i, x := rng.uniform(0, 3), y := rng.uniform(0, 3), 0.3 * x * x + 0.1 * y * x) for i in range(400)]
    pts = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    places = joins.positions(pts)
    edges = joins.radius_neighbors(places, 0.6, carry=("m",))
    normals = features.normals_from_tensors(tensors.tensor_from_neighbors(edges))
    three = {r.point_id: r.umbrella for r in features.umbrella_curvature(edges, normals, features.neighborhood_valid(edges)).collect()}
    one = {r.point_id: r.umbrella for r in features.umbrella_from_neighbors(places, edges).collect()}
    assert any(v for v in one.values())
    assert one == {i: pytest.approx(three[i]) if three.get(i) is not None else None for i in one}


def test_farthest_pair_is_exact(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(0, math.cos(2 * math.pi * i / 101), math.sin(2 * math.pi * i / 101)) for i in range(101)]
    rows += [(1, rng.random(), rng.random()) for _ in range(200)] + [(2, 1.0, 1.0)] * 2 + [(3, 1.0, 2.0), (3, 1.0, 5.0), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "cloud_id int, x double, y double")
    want = {c: max(math.dist(a[1:], b[1:]) for a in rows for b in rows if a[0] == b[0] == c and a[1] is not None and b[1] is not None) for c in range(4)}
    assert {r.cloud_id: r.dist for r in points.farthest_pair(df).collect()} == want
    monkeypatch.setattr(points, "FEW_PAIRS", 150)
    assert {r.cloud_id: r.dist for r in points.farthest_pair(df).collect()} == want


def test_cells_are_split_beyond_twenty_levels(spark):
    rows = [(i, i * 2.0 ** -26, 0.0, 0.0) for i in range(4)] + [(9, 1.0, 0.0, 0.0), (10, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "point_id int, x double, y double, z double")
    cells = segments.adaptive_cells(df, 1, 0.0).groupBy("cell").agg(F.collect_set("x").alias("x")).collect()
    assert len(cells) == 5 and all(len(c.x) == 1 for c in cells)


def test_slope_filter_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(0, 6)), float(rng.randint(0, 6)), rng.choice([0.0, 0.5, 1.0, 3.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "point_id int, x double, y double, z double")
    got = {r.point_id: r.segment for r in points.slope_ground_filter(df, 2.5, 35.0).collect()}
    want = {i: int(any(c < z and math.hypot(x - a, y - b) < 2.5 and math.degrees(math.atan2(z - c, math.hypot(x - a, y - b))) > 35 for _, a, b, c in rows)) for i, x, y, z in rows}
    assert got == want


@pytest.mark.parametrize("rows_per_task", [3, 1_000_000])
def test_crowded_cells_and_strips_give_the_same(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", rows_per_task)
    rng = random.Random(3)
    rows = [(i, 0.5 + rng.random() * 0.2 if i % 3 else rng.uniform(0, 4), rng.uniform(0, 4) if i % 2 else 0.5, 0.0) for i in range(90)]
    df = spark.createDataFrame(rows, "point_id int, x double, y double, z double")
    pairs = {(r.point_id, r.nid) for r in joins.radius_neighbors(df, 0.3).collect()}
    assert pairs == {(a[0], b[0]) for a in rows for b in rows if 0 < math.dist(a[1:], b[1:]) <= 0.3}
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 0.0), (1, 1, 2.0, 0.0, 2.0, 2.0), (1, 2, 2.0, 2.0, 0.0, 2.0), (1, 3, 0.0, 2.0, 0.0, 0.0)], "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    inside = {r.point_id for r in polygons.points_in_polygon(df, edges, 1.0).collect()}
    assert inside == {i for i, x, y, _ in rows if 0 < x < 2 and 0 < y < 2}


def test_groups_without_extent_do_not_stop_the_others(spark):
    circle = [("c", 3 + 2 * math.cos(t), 1 + math.sin(t), 0.0) for t in (0.1 * i for i in range(63))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(circle + [("one", 1.0, 1.0, 0.0), ("same", 2.0, 2.0, 0.0), ("same", 2.0, 2.0, 0.0)])], "point_id int, g string, x double, y double, z double")
    found = {r.g: r for r in fitting.fit_ellipse(df, ["g"]).collect()}
    assert found["c"].x0 == pytest.approx(3, abs=1e-3) and found["c"].a == pytest.approx(2, abs=1e-2)
    same = df.where("g = 'same'")
    assert fitting.align_principal_axes(same).count() == 2 and fitting.align_principal_axes(df.where("false")).count() == 0
    line = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "point_id int, x double, y double, z double")
    assert fitting.align_principal_axes(line).agg(F.max("z") - F.min("z")).first()[0] == pytest.approx(4)
    dots = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.1, 0.0), (3, 0.0, 1.0, 0.0)], "point_id int, x double, y double, z double")
    vectors = dots.select("point_id", F.array("x", "y", "z").alias("v"))  # one of them has no direction
    assert linkage.curve_clusters(vectors, 2).select("component").distinct().count() == 2


def test_star_of_many_links(spark):
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    found = graph.connected_components(spark.range(3001), edges)
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(0, 3000), (3000, 1)}


def test_las_of_version_4_and_compressed(spark, tmp_path):
    header = bytearray(375)
    struct.pack_into("<4s", header, 0, b"LASF")
    struct.pack_into("<BB", header, 24, 1, 4)
    struct.pack_into("<I", header, 96, 375)
    struct.pack_into("<BH", header, 104, 6, 30)
    struct.pack_into("<6d", header, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    struct.pack_into("<Q", header, 247, 2)
    record = lambda x, c: struct.pack("<iiiHBBB", x, 0, 0, 5, 0, 0, c) + bytes(13)
    (tmp_path / "p.las").write_bytes(bytes(header) + record(100, 40) + record(200, 2))
    rows = readers.read_las(spark, str(tmp_path / "p.las")).orderBy("point_id").collect()
    assert [(r.x, r.intensity, r.label) for r in rows] == [(1.0, 5.0, 40), (2.0, 5.0, 2)]
    header[104] = 0x86
    (tmp_path / "q.las").write_bytes(bytes(header) + record(100, 40))
    with pytest.raises(Exception, match="uncompressed"):
        readers.read_las(spark, str(tmp_path / "q.las")).collect()


def test_external_curvature_uses_every_corner_of_the_hull(spark):
    rng = random.Random(8)
    ring = [(math.cos(2 * math.pi * i / 40), math.sin(2 * math.pi * i / 40), -1 - 0.2 * (i % 2)) for i in range(40)]
    inner = [(r * math.cos(t), r * math.sin(t), 0.3) for r, t in ((rng.uniform(0.1, 0.7), rng.uniform(0, 7)) for _ in range(300))]
    corner = [(1.0, 0.0, 0.5), (1.0, 1.0, 0.0), (0.0, 1.0, 0.5), (0.5, 0.5, 9.0), (1.0, 1.0, 7.0)]
    rows = [("cone", i, *p) for i, p in enumerate(ring + inner)] + [("corner", i, *p) for i, p in enumerate(corner)] + [("line", 0, 1.0, 1.0, 0.0), ("line", 1, 2.0, 2.0, 0.0)]
    edges = spark.createDataFrame(rows, "point_id string, nid long, dx double, dy double, dz double").repartition(5)

    def bend(a, b, c):  # the edge to b between the triangles (a, b) and (b, c)
        n = [[u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]] for u, v in ((a, b), (b, c))]
        return math.hypot(*b) * math.acos(sum(p * q for p, q in zip(*n)) / math.hypot(*n[0]) / math.hypot(*n[1]))

    got = {r.point_id: r.curvature for r in features.curvature_external(edges).collect()}
    assert got["cone"] == pytest.approx(0.25 * sum(bend(ring[i - 1], ring[i], ring[(i + 1) % 40]) for i in range(40)))
    assert got["corner"] == pytest.approx(0.25 * bend(*corner[:3])) and got["line"] is None


def test_groups_that_do_not_converge_are_marked(spark):
    rows = [("exact", 3 + 2 * math.cos(t), 1 + 2 * math.sin(t)) for t in range(40)]
    rows += [("flat arc", 1000 * math.cos(t * 1e-5) + 0.01 * (t % 3), 1000 * math.sin(t * 1e-5)) for t in range(40)] + [("one place", 1.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = {r.g: r for r in fitting.fit_circle(df, ["g"], max_iterations=3).collect()}
    assert set(found) == {"exact", "flat arc", "one place"}
    assert found["exact"].converged and found["exact"].iterations <= 3 and abs(found["exact"].r - 2) < 1e-6
    assert not found["flat arc"].converged and found["flat arc"].iterations == 3
