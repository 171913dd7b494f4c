"""Analytic fixtures with known answers, invariants and comparisons with brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudframe import skew
from cloudframe.functions import curvature, geometry, linalg, quantiles
from cloudframe.operators import curves, features, fitting, graph, joins, segments, tensors
from cloudframe.ordering import global_rank, percentile
from cloudframe.plans import point_features

SF = "/root/testdata/sf0.001"


def frame(spark, xyz):
    return spark.createDataFrame(pd.DataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], columns=["point_id", "x", "y", "z"]))


def brute_knn(xyz, k):
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    out = set()
    for i in range(len(xyz)):
        ids = sorted((j for j in range(len(xyz)) if d[i, j] > 0), key=lambda j: (d[i, j], j))[:k]
        out |= {(i, j) for j in ids}
    return out


def test_quantiles_match_published_tables():
    assert quantiles.chi2_quantile(0.05, 10) == pytest.approx(3.940299, abs=1e-6)
    assert quantiles.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-6)
    assert quantiles.f_quantile(0.95, 3, 20) == pytest.approx(3.098391, abs=1e-6)
    assert quantiles.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_knn_is_exact_when_density_varies_and_points_repeat(spark):
    rng = np.random.default_rng(3)
    # A dense clump, a third of all points at one place, and far outliers.
    xyz = np.vstack([rng.normal(0, 1e-3, (60, 3)), np.tile([5.0, 5.0, 5.0], (60, 1)), rng.uniform(-100, 100, (50, 3))])
    points = frame(spark, xyz)
    got = {(r.point_id, r.nid) for r in joins.knn(points, points, 4).collect()}
    assert got == brute_knn(xyz, 4)


def test_knn_with_fewer_points_than_k(spark):
    xyz = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0.0]])
    points = frame(spark, xyz)
    assert {(r.point_id, r.nid) for r in joins.knn(points, points, 9).collect()} == brute_knn(xyz, 9)


def test_knn_queries_outside_the_box(spark):
    rng = np.random.default_rng(4)
    xyz, far = rng.uniform(0, 1, (80, 3)), np.array([[50.0, 0, 0], [-30, 40, 2], [0.5, 0.5, 0.5]])
    got = {(r.point_id, r.nid) for r in joins.knn(frame(spark, far), frame(spark, xyz), 3, include_zero=True).collect()}
    d = np.linalg.norm(far[:, None] - xyz[None], axis=2)
    assert got == {(i, int(j)) for i in range(3) for j in np.argsort(d[i], kind="stable")[:3]}


def test_radius_neighbors_survive_salting(spark, monkeypatch):
    rng = np.random.default_rng(5)
    xyz = np.vstack([rng.uniform(-0.2, 0.2, (120, 3)), rng.uniform(-3, 3, (60, 3))])
    points = frame(spark, xyz)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(skew.salted, "__defaults__", (10,))
    got = sorted((r.point_id, r.nid) for r in joins.radius_neighbors(points, 0.5).collect())
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert got == sorted((int(i), int(j)) for i, j in np.argwhere((d <= 0.5) & (d > 0)))


def test_eigen_matches_numpy(spark):
    rng = np.random.default_rng(6)
    mats = [m @ m.T for m in rng.normal(size=(200, 3, 3))]
    rows = pd.DataFrame([(i, m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]) for i, m in enumerate(mats)],
                        columns=["point_id", *linalg.SYMMETRIC])
    for r in linalg.with_eigen(spark.createDataFrame(rows)).collect():
        values, vectors = np.linalg.eigh(mats[r.point_id])
        assert np.allclose([r.l1, r.l2, r.l3], values, atol=1e-6 * values[2])
        assert abs(np.dot(r.plate, vectors[:, 0])) == pytest.approx(1, abs=1e-6)
        assert abs(np.dot(r.stick, vectors[:, 2])) == pytest.approx(1, abs=1e-6)


def test_plane_has_its_normal_and_no_curvature(spark):
    xyz = [(x / 4, y / 4, 0.5 * x / 4 - 0.2 * y / 4 + 3) for x in range(13) for y in range(13)]
    points = frame(spark, xyz)
    edges = joins.radius_neighbors(points, 0.8)
    normals = features.normals_from_tensors(tensors.tensor_from_neighbors(edges))
    expected = np.array([-0.5, 0.2, 1]) / np.linalg.norm([-0.5, 0.2, 1])
    for r in normals.collect():
        assert np.allclose([r.nx, r.ny, r.nz], expected, atol=1e-6)
    assert {r.umbrella for r in features.umbrella_curvature(edges, normals).collect()} == {0.0}
    fit = fitting.fit_plane_gauss_helmert(points, [], (0, 0, 1, 0)).first()
    assert fit.rmse == pytest.approx(0, abs=1e-6)


def test_paraboloid_has_its_principal_curvatures(spark):
    grid = np.linspace(-0.3, 0.3, 13)
    points = frame(spark, [(x, y, 0.1 * x * x + 0.02 * x * y + 0.3 * y * y) for x in grid for y in grid])
    places = points.withColumns({"m": F.lit(1), "nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    edges = point_features.edges_with_normals(places, 0.25)
    centre = 6 * 13 + 6
    r = features.curvature_biquadratic(edges).where(F.col("point_id") == centre).first()
    k = np.linalg.eigvalsh([[0.2, 0.02], [0.02, 0.6]])
    assert (r.k1, r.k2) == pytest.approx((k[1], k[0]), abs=1e-6)


def test_circle_curvature_length_and_thinning(spark):
    n, radius = 400, 5.0
    rows = pd.DataFrame([(1, i, radius * math.cos(2 * math.pi * i / n), radius * math.sin(2 * math.pi * i / n)) for i in range(n)],
                        columns=["curve_id", "seq", "x", "y"])
    curve = spark.createDataFrame(rows)
    tn = curves.tangent_normal(curve).where("seq between 5 and 390").agg(F.min("curvature"), F.max("curvature")).first()
    assert tn[0] == pytest.approx(1 / radius, rel=1e-3) and tn[1] == pytest.approx(1 / radius, rel=1e-3)
    length = curves.arc_length(curve).agg(F.max("cdf")).first()[0]
    assert length == pytest.approx(2 * math.pi * radius * (n - 1) / n, rel=1e-3)
    kept = sorted(r.seq for r in curves.thin_curve(curve, length / 10.5).collect())
    assert kept[0] == 0 and len(kept) == 11


def test_curve_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame([(c, i, float(i), float(v)) for c in range(2) for i, v in enumerate(rng.normal(size=50))], columns=["curve_id", "seq", "x", "y"])
    curve = spark.createDataFrame(rows)
    whole = sorted(map(tuple, curves.curve_smoothing(curve, 2).collect()))
    monkeypatch.setattr(curves.with_halo, "__defaults__", (7,))
    assert sorted(map(tuple, curves.curve_smoothing(curve, 2).collect())) == whole


def test_simplify_matches_recursive_reference(spark):
    rng = np.random.default_rng(9)
    xy = np.column_stack([np.arange(60.0), np.cumsum(rng.normal(size=60))])
    def rdp(lo, hi):
        best, at = 0.0, None
        (ax, ay), (bx, by) = xy[lo], xy[hi]
        for i in range(lo + 1, hi):
            d = abs((bx - ax) * (ay - xy[i, 1]) - (ax - xy[i, 0]) * (by - ay)) / math.hypot(bx - ax, by - ay)
            if d > best:
                best, at = d, i
        return rdp(lo, at) | rdp(at, hi) if at is not None and best >= 1.0 else {lo, hi}
    curve = spark.createDataFrame(pd.DataFrame([(0, i, *map(float, p)) for i, p in enumerate(xy)], columns=["curve_id", "seq", "x", "y"]))
    assert {r.seq for r in curves.simplify_curve(curve, 1.0).collect()} == rdp(0, 59)


def test_circle_and_ellipse_fits(spark):
    t = np.linspace(0, 6, 200)
    rows = [(1, 3 + 4 * math.cos(a), -2 + 4 * math.sin(a)) for a in t]
    c = fitting.fit_circle(spark.createDataFrame(pd.DataFrame(rows, columns=["cloud_id", "x", "y"])), ["cloud_id"]).first()
    assert (c.x0, c.y0, c.r) == pytest.approx((3, -2, 4), abs=1e-6)
    rows = [(1, 1 + 5 * math.cos(a) * math.cos(.3) - 2 * math.sin(a) * math.sin(.3), 2 + 5 * math.cos(a) * math.sin(.3) + 2 * math.sin(a) * math.cos(.3)) for a in t]
    e = fitting.fit_ellipse(spark.createDataFrame(pd.DataFrame(rows, columns=["cloud_id", "x", "y"])), ["cloud_id"]).first()
    assert (e.x0, e.y0, abs(e.a), abs(e.b)) == pytest.approx((1, 2, 5, 2), abs=1e-5)


def test_components_and_spanning_clusters(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 5), (9, 9)], "a long, b long")
    vertices = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 7, 9)], "id long")
    got = {r.id: r.component for r in graph.connected_components(vertices, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 9: 9}


def test_two_planes_separate(spark):
    xyz = [(i / 5, j / 5, 0.0) for i in range(20) for j in range(10)] + [(0.0, j / 5, 1 + i / 5) for i in range(20) for j in range(10)]
    cells = segments.adaptive_cells(frame(spark, xyz), 8, 0.6).withColumnRenamed("cell", "key")
    t = segments.tensors_of(cells, "key")
    g = segments.similarity_graph(t, 4, 0.01, 0.1, 0.05)
    assert segments.tensor_components(t, g).select("segment").distinct().count() >= 2


def test_rank_and_percentile(spark):
    values = np.random.default_rng(1).integers(0, 20, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"point_id": range(500), "v": values}))
    assert tuple(percentile(df, "v", [0.25, 0.5, 0.9]).first()) == pytest.approx(tuple(np.percentile(values, [25, 50, 90])))
    assert [r.rank for r in global_rank(df, ["v", "point_id"]).orderBy("v", "point_id").collect()] == list(range(1, 501))


def test_rotations():
    r = np.array(geometry.rotation_two_vectors((1, 2, 3), (0, 0, 1)))
    assert np.allclose(r @ np.array([1, 2, 3]) / math.sqrt(14), [0, 0, 1]) and np.linalg.det(r) == pytest.approx(1)
    assert np.linalg.det(np.array(geometry.rotation_two_vectors((0, 0, 1), (0, 0, -1)))) == pytest.approx(1)


def test_ball_counts_match_brute_force(spark):
    xyz = np.random.default_rng(2).uniform(0, 1, (150, 3))
    got = {r.point_id: r.inside for r in fitting.ball_counts(frame(spark, xyz).withColumn("m", F.lit(1)), 0.4).collect()}
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert got == {i: int(n) for i, n in enumerate((d <= 0.4).sum(1))}
