"""Saliency that compares with the whole image or cloud, against plain versions that compare everything."""

import math
import random

import numpy as np
import pytest

from cloudframe.operators import context, distinctness, resolution


# Context saliency

def context_brute(values, size, k, constant):
    """``values``: {(row, col): step of the smoothed image}."""
    r0, c0 = min(r for r, _ in values), min(c for _, c in values)
    width = max(c for _, c in values) - c0 + 1
    number = {p: (p[0] - r0) * width + p[1] - c0 for p in values}
    out = dict.fromkeys(values, 0.0)
    for p in sorted(values, key=number.get):
        if number[p] % (size // 2):
            continue
        near = sorted(values, key=lambda q: (abs(values[q] - values[p]), number[q]))[:k]
        d = [abs(values[q] - values[p]) / context.STEPS / (1 + constant * math.dist(p, q)) for q in near]
        s = 1 - math.exp(-sum(d) / len(d))
        for q in [*near, p]:
            out[q] = s
    return out


@pytest.mark.parametrize("kind, k", [("noise", 5), ("flat", 7), ("two values", 9), ("few", 64)])
def test_context_saliency_compares_with_the_whole_image(spark, kind, k):
    rnd = random.Random(k)
    cells = [(r, c) for r in range(-2, 13) for c in range(4, 15) if kind != "few" or r < 1]
    value = {"noise": lambda p: rnd.random(), "flat": lambda p: 1.0 if p != (3, 9) else 5.0, "two values": lambda p: float(p[0] % 2), "few": lambda p: rnd.random()}[kind]
    rows = [(r, c, value((r, c))) for r, c in cells if rnd.random() < 0.9]
    image = spark.createDataFrame(rows, "row int, col int, value double")
    for size in (4, 2):
        steps = {(r.row, r.col): r._v for r in context.value_steps(image, size).collect()}
        got = {(r.row, r.col): r.saliency for r in context.context_of_scale(image, size, k, 3.0).collect()}
        want = context_brute(steps, size, k, 3.0)
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    whole = {(r.row, r.col): r.value for r in context.context_saliency(image, 2, 2, k).collect()}
    assert all(abs(whole[p] - want[p] / 2) < 1e-12 for p in want)  # patches of one pixel judge none


def test_context_saliency_of_an_empty_or_constant_image(spark):
    image = spark.createDataFrame([(0, 0, 3.0), (0, 1, 3.0), (5, 5, None)], "row int, col int, value double")
    assert {r.value for r in context.context_saliency(image, 2, 1, 4).collect()} == {0.0}
    assert context.context_saliency(image.where("false"), 2, 1, 4).collect() == []


# Hierarchy of cells

def test_every_point_has_the_values_of_its_nodes(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.uniform(0, 16), rnd.uniform(0, 16), rnd.uniform(0, 2) + (3 if rnd.random() < 0.2 else 0)) for i in range(900)]
    rows += [(1000 + i, 1.0, 1.0, 1.0) for i in range(400)] + [(5000, None, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    placed = resolution.placed_in_cells(points, 1.0)
    hierarchy = resolution.cell_hierarchy(placed, 3)
    cells = {r.point_id: (r.ci, r.cj, r.ck) for r in placed.collect()}
    xyz = {r[0]: r[1:] for r in rows}
    for level, nodes in enumerate(hierarchy):
        members = {}
        for i, cell in cells.items():
            if i != 5000:
                members.setdefault(tuple(c >> level for c in cell), []).append(xyz[i])
        got = {(r.ci, r.cj, r.ck): r for r in nodes.collect()}
        assert set(got) == set(members)
        for cell, some in members.items():
            a, r = np.array(some), got[cell]
            assert r.n == len(a) and np.allclose([r.cx, r.cy, r.cz], a.mean(axis=0))
            assert np.allclose([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]], np.cov(a.T, bias=True), atol=1e-9)
    found = {r.point_id: r for r in resolution.multi_resolution_saliency(points, 1.0, 3).collect()}
    assert set(found) == set(cells) and found[5000].saliency is None
    for level, nodes in enumerate(hierarchy):
        own = {(r.ci, r.cj, r.ck): r for r in resolution.node_features(nodes, 2.0 ** level).collect()}
        for i, cell in cells.items():
            if i != 5000:
                node = own[tuple(c >> level for c in cell)]
                assert found[i].saliencies[level] == pytest.approx(node.saliency, abs=1e-9) and found[i].curvatures[level] == pytest.approx(node.k, abs=1e-9)
    assert all(abs(r.saliency - sum(r.saliencies) / 3) < 1e-12 for i, r in found.items() if i != 5000)
    assert len({round(r.saliency, 9) for r in found.values() if r.saliency is not None}) > 20
    by_count = resolution.multi_resolution_saliency(points, 2.0, 2, neighbors=6)
    assert by_count.count() == len(rows) and by_count.where("saliency > 0").count() > 0


# Hierarchical saliency

def hierarchical_brute(xyz, h, m, low_share=0.01, focus_share=0.2, high_share=0.1, sigma=0.05):
    chi = distinctness.chi2_matrix(h, h)
    far = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    weight = np.where(chi <= low_share * chi.max(axis=1)[:, None], m[None, :], 0.0)
    np.fill_diagonal(weight, m - 1)
    n = weight.sum(axis=1)
    low = 1 - np.exp(-np.divide((weight * chi / (1 + far)).sum(axis=1), n, out=np.zeros(len(h)), where=n > 0))
    order = sorted(range(len(h)), key=lambda i: (-low[i], i))
    foci, top = order[:int(focus_share * len(h))], order[:int(high_share * len(h))]
    near = [min(foci, key=lambda j: (far[i, j], j)) for i in range(len(h))]
    linked = np.array([low[j] * math.exp(-far[i, j] ** 2 / (2 * sigma * sigma)) for i, j in enumerate(near)])
    high = 1 - np.exp(-(m[top] * chi[:, top] * np.log1p(far[:, top])).sum(axis=1) / m[top].sum())
    return 0.5 * (low + linked) + 0.5 * high, n


def test_hierarchical_saliency_compares_with_the_whole_cloud(spark, monkeypatch):
    monkeypatch.setattr(distinctness, "BLOCK", 100)
    rng = np.random.default_rng(3)
    centres = rng.random((8, 12)) * (rng.random((8, 12)) < 0.4)
    h = np.abs(centres[rng.integers(0, 8, 1000)] + rng.normal(scale=0.002, size=(1000, 12)))
    h[:300] = h[0]  # a third of the cloud has one histogram
    h[300:310] = 0.0
    xyz, m = rng.random((1000, 3)), rng.integers(1, 4, 1000).astype(float)
    points = spark.createDataFrame([(i, *map(float, p), int(n)) for i, (p, n) in enumerate(zip(xyz, m))], "point_id long, x double, y double, z double, m long")
    histograms = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(h)], "point_id long, h array<double>")
    want, close = hierarchical_brute(xyz, h, m)
    low = {r.point_id: r for r in distinctness.low_level_distinctness(points, histograms).collect()}
    assert [low[i].close for i in range(1000)] == close.astype(int).tolist()
    compared = sum(r.compared for r in low.values())
    print(f"{compared} of {2 * 1000 * 1000} comparisons")
    assert compared < 1000 * 1000  # the farthest and the close ones, of a million each
    got = {r.point_id: r.saliency for r in distinctness.hierarchical_saliency(points, histograms).collect()}
    assert len(got) == 1000 and max(abs(got[i] - want[i]) for i in range(1000)) < 1e-9
    assert distinctness.low_level_distinctness(points.where("false"), histograms).collect() == []
