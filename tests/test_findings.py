"""Faults found by review: one small test each."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from cloudframe import skew
from cloudframe.operators import curves, fitting, graph, joins, raster, segments, smoothing, tensors
from cloudframe.sources import readers


def test_cell_without_neighbours_has_no_derivative(spark):
    image = spark.createDataFrame([(0, 0, 7.0), (0, 9, 1.0), (0, 10, 4.0), (0, 11, 2.0)], "row int, col int, value double")
    got = {(r.row, r.col): (r.zx, r.zy) for r in raster.sobel(image, border="zero").collect()}
    assert got[(0, 0)] == (None, None)
    assert got[(0, 10)][0] == 2.0 * (2.0 - 1.0)
    assert raster.gradient(image.where("col = 0")).first().value is None


def test_edges_stay_with_their_centre(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(f"p{i}", rnd.choice([0.0, 0.1, 0.2, 1.0, 5.0]), rnd.uniform(0, 3), float(rnd.randrange(2))) for i in range(120)]
    points = spark.createDataFrame(rows, "point_id string, x double, y double, z double").repartition(3)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 7)  # crowded cells are dealt out
    edges = joins.radius_neighbors(points, 0.5, home=True)
    got = sorted((r.point_id, r.nid) for r in edges.select("point_id", "nid").collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if 0 < math.dist(a[1:], b[1:]) <= 0.5)
    assert got == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = joins.radius_neighbors(points, 0.5, home=True)
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        stats = tensors.neighborhood_stats(edges)
        assert shuffles(stats) == shuffles(edges)
        assert {r.point_id: r.n for r in stats.collect()} == dict(Counter(a for a, _ in want))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _copied(spark, seed):
    """A lattice with many copies and many equal distances."""
    rnd = random.Random(seed)
    rows = [(f"p{i}", float(rnd.randrange(3)), rnd.randrange(8) / 4, float(rnd.randrange(2))) for i in range(150)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "point_id string, x double, y double, z double")


def test_nearest_within_a_radius_of_copies(spark):
    rows, points = _copied(spark, 5)
    for k in (1, 4, 40):
        want = set()
        for a in rows:
            near = sorted((math.dist(a[1:], b[1:]), b[0]) for b in rows if 0 < math.dist(a[1:], b[1:]) <= 0.8)
            want |= {(a[0], b, r + 1) for r, (_, b) in enumerate(near[:k])}
        assert {(r.point_id, r.nid, r["rank"]) for r in joins.radius_knn(points, k, 0.8).collect()} == want
    # Only places meet: the pairs of the join do not grow with the copies.
    once, thrice = (joins.place_knn(p, joins.positions(p), 4, 0.8).count() for p in (
        points, points.union(points.withColumn("point_id", F.concat("point_id", F.lit("b"))))))
    assert once == thrice


def test_components_within_a_radius_by_cells(spark):
    rnd = random.Random(8)
    rows = [(f"p{i}", rnd.uniform(0, 4), rnd.uniform(0, 4), rnd.uniform(0, 1)) for i in range(160)] + [("q", None, 1.0, 1.0), ("r", None, 1.0, 1.0)]
    places = spark.createDataFrame(rows, "point_id string, x double, y double, z double")
    group = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a in rows[:-2]:
            for b in rows[:-2]:
                if math.dist(a[1:], b[1:]) <= 0.45 and group[b[0]] < group[a[0]]:
                    group[a[0]] = group[b[0]]
    assert 3 < len(set(group.values())) < 150
    assert {r.id: r.component for r in graph.radius_components(places, 0.45).collect()} == group


def test_adjacency_of_edges_that_carry_labels(spark):
    edges = spark.createDataFrame([("a", "b", 1, 2), ("a", "c", 1, 1), ("d", "b", 1, 2)], "point_id string, nid string, label long, neighbor long")
    assert [tuple(r) for r in graph.segment_adjacency(edges.select("point_id", "label"), edges).collect()] == [(1, 2)]


def test_range_smoothing_counts_copies(spark):
    rows = [("a", 10.0, 5.0, 2.0, 3), ("b", 10.001, 5.0, 2.05, 1), ("c", 40.0, 5.0, 2.0, 2)]
    once = spark.createDataFrame(rows, "point_id string, az double, el double, range double, m long")
    single = once.withColumn("_i", F.explode(F.sequence(F.lit(1), "m"))).select(F.concat("point_id", "_i").alias("point_id"), "az", "el", "range")
    got = {r.point_id: r.range for r in smoothing.smooth_range_gaussian(joins.spherical_neighbors(once, 0.3, carry=("m",), home=True), 0.002).collect()}
    want = {r.point_id[0]: r.range for r in smoothing.smooth_range_gaussian(joins.spherical_neighbors(single, 0.3), 0.002).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_lookup_moves_no_rows_and_cuts_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 10 else f"k{i}") for i in range(200)] + [(200, None)], "id long, k string")
    table = spark.createDataFrame([("hot", 1.0), *((f"k{i}", float(i)) for i in range(0, 150, 10))], "k string, v double")
    found = dict(table.collect())
    want = {i: found.get(k) for i, k in rows.collect()}
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 7)
    for most in (100, 3):  # broadcast, then joined by key and salt
        monkeypatch.setattr(skew, "MOST_BROADCAST", most)
        left, inner = (skew.lookup(rows, table, ["k"], how) for how in ("left", "inner"))
        assert sorted((r.id, r.v) for r in left.collect()) == sorted(want.items())
        assert {r.id: r.v for r in inner.collect()} == {i: v for i, v in want.items() if v is not None}
        assert ("SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()) == (most == 100)


def _shuffled_rows(spark, frame):
    """Exchanges by key that stand in the plan of a frame."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_points_stay_where_they_are_for_a_few_groups(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"p{i}", "ANR"[i % 3], rnd.random(), rnd.random(), rnd.random() / 9) for i in range(90)]
    points = spark.createDataFrame(rows, "point_id string, cloud_id string, x double, y double, z double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        residuals = fitting.plane_residuals(points, fitting.fit_plane_pca(points, ["cloud_id"]), ["cloud_id"])
        assert residuals.count() == 90 and _shuffled_rows(spark, residuals) == 0
        places = points.select("point_id", (F.col("x") * 50).alias("az"), (F.col("y") * 9).alias("el"))
        lines = segments.scanline_segmentation(places, 20.0, ransac_ratio=0.5, min_points=5)
        assert lines.count() == 90 and _shuffled_rows(spark, lines) == 0
        cells = segments.adaptive_cells(points, 4, 0.2)
        assert cells.count() == 90 and _shuffled_rows(spark, cells) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_adaptive_cells_against_a_tree(spark):
    rnd = random.Random(4)
    rows = [(f"p{i}", rnd.random() ** 3 * 7, rnd.random() * 5, rnd.random()) for i in range(200)] + [("lost", None, 1.0, 1.0)]
    got = {r.point_id: r.cell for r in segments.adaptive_cells(spark.createDataFrame(rows, "point_id string, x double, y double, z double"), 6, 0.4).collect()}
    known = rows[:-1]
    low = [min(r[i] for r in known) for i in (1, 2, 3)]
    side = max(max(r[i] for r in known) - min(r[i] for r in known) for i in (1, 2, 3)) * (1 + 1e-9)
    want, open_, level = {"lost": got["lost"]}, known, 0
    while open_:
        cells = {}
        for r in open_:
            cells.setdefault("_".join(map(str, (level, *(math.floor((r[i + 1] - low[i]) / (side / 2 ** level)) for i in range(3))))), []).append(r)
        open_ = []
        for name, members in cells.items():
            spread = math.dist([max(m[i] for m in members) for i in (1, 2, 3)], [min(m[i] for m in members) for i in (1, 2, 3)]) / 2
            if spread >= 0.4 and spread > 0 and len(members) > 6:
                open_ += members
            else:
                want.update({m[0]: name for m in members})
        level += 1
    assert got == want and level > 3


def test_many_cameras_in_one_file(spark, tmp_path):
    (tmp_path / "all.txt").write_text("".join(f"c{k}: " + " ".join(str(k + i) for i in range(12)) + "\n" for k in range(5)))
    (tmp_path / "one.txt").write_text("1 2 3 4\n5 6 7 8\n9 10 11 12\n")
    got = {r.img_id.rsplit("/", 1)[-1]: r.m for r in readers.read_projection_matrix(spark, str(tmp_path)).collect()}
    assert got == {**{f"c{k}": [float(k + i) for i in range(12)] for k in range(5)}, "one.txt": [float(i) for i in range(1, 13)]}


def test_ball_counts_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(fitting, "LEAST_IN_BLOCK", 32)
    monkeypatch.setattr(fitting, "RUN", 4)
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0.0, 0.5, rnd.random()]), rnd.random(), rnd.random() * 3, 1 + i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows + [(300, None, 1.0, 1.0, 1)], "point_id long, x double, y double, z double, m long")
    counts = fitting.ball_counts(frame, 0.7)
    got = {r.point_id: r.inside for r in counts.collect()}
    close = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4])) <= 0.7 * 0.7
    assert got == {**{a[0]: sum(b[4] for b in rows if close(a, b)) for a in rows}, 300: 0}
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()  # no row per pair of cells


def test_repeated_searches_send_no_table_through_the_driver(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, *(rnd.uniform(0, 4) for _ in range(3))) for i in range(80)]
    points = spark.createDataFrame(rows, "point_id int, x double, y double, z double")
    plans, knn = [], joins.knn

    def watched(*args, **kwargs):
        found = knn(*args, **kwargs)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(joins, "knn", watched)
    moved = points.withColumns({"x": F.col("x") + 0.01, "y": F.col("y") - 0.02})
    rotation, shift, gap = fitting.icp(moved, points)
    assert plans and not any("BroadcastExchange" in p for p in plans)
    assert gap < 1e-6 and math.dist(shift, (-0.01, 0.02, 0)) < 1e-6 and abs(rotation[0][0] - 1) < 1e-6
    found = knn(moved, points, 2, include_zero=True, located=True).where("rank = 1").orderBy("point_id").collect()
    assert [(r.point_id, r.nid) for r in found] == [(i, i) for i in range(80)]
    assert all(math.dist((r.x + r.dx, r.y + r.dy, r.z + r.dz), rows[r.nid][1:]) < 1e-12 for r in found)


def test_simplified_curve_is_written_once_a_round(spark, monkeypatch):
    """A round wrote three tables, one of them all vertices kept so far."""
    rows = [(c, i, float(i), (-1.0) ** i * 1.5 ** i) for c in (1, 2) for i in range(20)]
    line = spark.createDataFrame(rows, "curve_id int, seq long, x double, y double")
    written, cut = [], curves.cut_lineage
    monkeypatch.setattr(curves, "cut_lineage", lambda df: (written.append(df.columns), cut(df))[1])
    assert curves.simplify_curve(line, 0.5).count() > 20
    rounds = sum("_v" in c for c in written)
    assert rounds > 4 and sum(c == ["curve_id", "seq"] for c in written) <= 1 + rounds // 15
    monkeypatch.setattr(curves, "ROUNDS", 3)
    few = curves.simplify_curve(line, 0.5).count()
    assert few == curves.simplify_curve(line.repartition(5), 0.5).count() > 20
