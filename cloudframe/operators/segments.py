"""Surface elements, their similarity graph, and refinement of segments by tensors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.functions import linalg
from cloudframe.lineage import cut_lineage
from cloudframe.operators import features, joins
from cloudframe.operators.graph import connected_components
from cloudframe.operators.smoothing import extent
from cloudframe.operators.tensors import merge_tensors, moments
from cloudframe.skew import lookup

C = F.col


def adaptive_cells(points: DataFrame, leaf_size: int, smallest: float) -> DataFrame:
    """Cut the cloud into octree cells with a radius below ``smallest`` or at most ``leaf_size`` points.

    Adds ``cell`` (text of level and cell numbers).  Counts and extents are taken once per cell of the lowest level that
    can occur and summed up for the levels above; a point's cell is that of the first level which is not split, so points
    are neither stored nor moved.  The partition is that of an octree, not of a ball tree.
    """
    e = points.select(extent(points)).first()
    e = None if e is None else e[0]
    if e is None or any(e[f"{a}_max"] is None for a in "xyz"):
        return points.withColumn("cell", F.concat_ws("_", F.lit(0)))
    side = max(*(e[f"{a}_max"] - e[f"{a}_min"] for a in "xyz"), 1e-9) * (1 + 1e-9)
    depth = 0  # a cell whose side is below ``smallest`` has a smaller radius; numbers of cells stay whole doubles
    while depth < 50 and side / 2.0 ** depth >= smallest:
        depth += 1
    keys, above = ["_i", "_j", "_k"], ["_ai", "_aj", "_ak"]
    number = lambda a, level: F.floor((C(a) - e[f"{a}_min"]) / (F.lit(side) / F.pow(F.lit(2.0), level)))
    placed = points.withColumns({k: number(a, F.lit(depth)) for k, a in zip(keys, "xyz")})
    low = placed.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *(f(a).alias(f"_{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    low = cut_lineage(low)
    levels = low.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumns(
        {up: F.expr(f"shiftright({k}, {depth} - _level)") for up, k in zip(above, keys)})
    sizes = levels.groupBy("_level", *above).agg(F.sum("_n").alias("_n"), *((F.max(f"_hi{a}") - F.min(f"_lo{a}")).alias(f"_s{a}") for a in "xyz"))
    radius = F.sqrt(sum((C(f"_s{a}") * C(f"_s{a}") for a in "yz"), C("_sx") * C("_sx"))) / 2
    stays = sizes.where(~((radius >= smallest) & (radius > 0) & (C("_n") > leaf_size)) | (C("_level") == depth)).select("_level", *above)
    ends = levels.select(*keys, "_level", *above).join(stays, ["_level", *above]).groupBy(*keys).agg(F.min("_level").alias("_level"))
    found = lookup(placed, ends, keys, "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
    return found.select(*points.columns, F.concat_ws("_", "_level", *(number(a, C("_level")).cast("string") for a in "xyz")).alias("cell"))


def tensors_of(labelled: DataFrame, key: str) -> DataFrame:
    """Tensor, eigenvalues and axes per label."""
    return linalg.with_eigen(moments(labelled, [key]))


def similarity_graph(tensors: DataFrame, neighbors: int, variance: float, normal_difference: float, distance: float,
                     linearity: float = 5.0, mode: str = "binary", distance_alpha: float = 100.0, angle_alpha: float = 10.0,
                     distance_scale: float | None = None, clip: float = 0.0) -> DataFrame:
    """Weighted edges ``a, b, dist, don, weight`` between each flat tensor and its nearest flat tensors.

    ``tensors`` hold ``key, cx, cy, cz, l1, l2, l3, plate, stick``.  Planar tensors compare plate axes and the distance to
    the plane, linear ones (l3/l2 at least ``linearity``) stick axes and the distance to the line; ``don`` is the squared
    difference of the axes.  Weights: ``binary`` (both below their limits), ``exp`` (fades with both) or
    ``soft_clipping`` (distances in units of ``distance_scale``).
    """
    centres = tensors.select(C("key").alias("point_id"), C("cx").alias("x"), C("cy").alias("y"), C("cz").alias("z"))
    flat = tensors.where(C("l1") < variance)
    side = lambda p: flat.select(C("key").alias(p), *(C(n).alias(f"{p}_{n}") for n in ("cx", "cy", "cz", "l2", "l3", "plate", "stick")))
    near = joins.knn(centres, centres, neighbors).select(C("point_id").alias("a"), C("nid").alias("b"))
    pairs = near.join(side("a"), "a").join(side("b"), "b")
    delta = [C(f"b_c{x}") - C(f"a_c{x}") for x in "xyz"]
    planar = (C("a_l3") < linearity * C("a_l2")) | (F.sqrt("a_l2") > variance)
    pairs = pairs.withColumn("_planar", planar)
    pick = lambda p, i: F.when(C("_planar"), C(f"{p}_plate")[i]).otherwise(C(f"{p}_stick")[i])
    pairs = pairs.withColumns({f"_{p}{i}": pick(p, i) for p in "ab" for i in range(3)})
    u, v = [C(f"_a{i}") for i in range(3)], [C(f"_b{i}") for i in range(3)]
    sign = F.when(linalg.dot(u, v) < 0, -1.0).otherwise(1.0)
    don = sum(((v[i] - sign * u[i]) * (v[i] - sign * u[i]) for i in (1, 2)), (v[0] - sign * u[0]) * (v[0] - sign * u[0]))
    dist = F.when(C("_planar"), F.abs(linalg.dot(u, delta))).otherwise(linalg.norm(linalg.cross(u, delta)))
    pairs = pairs.withColumns({"dist": dist, "don": don})
    if mode == "binary":
        weight = F.when((C("dist") < distance) & (C("don") < normal_difference), 1.0).otherwise(0.0)
    elif mode == "exp":
        weight = F.exp(-C("dist") * C("dist") / distance) * F.exp(-C("don") * C("don") / normal_difference)
    elif mode == "soft_clipping":
        ramp = lambda t, alpha: F.log((1 + F.exp(alpha * t)) / (1 + F.exp(alpha * (t - 1)))) / alpha
        ds = F.least(F.lit(5.0), C("dist") / (distance_scale or variance))
        angle = (C("don") - (1 - normal_difference)) / normal_difference
        raw = (1 - ramp(ds, distance_alpha)) * ramp(angle, angle_alpha)
        weight = F.when(raw < clip, 0.0).otherwise(raw)
    else:
        raise ValueError(f"unknown weighting mode {mode!r}")
    return pairs.select("a", "b", "dist", "don", weight.alias("weight"))


def similarity_lookup(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weight of the listed pairs (1 for a tensor with itself, 0 without an edge)."""
    return pairs.join(graph.select("a", "b", "weight"), ["a", "b"], "left").select(
        "a", "b", F.when(C("a") == C("b"), 1.0).otherwise(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def tensor_components(tensors: DataFrame, graph: DataFrame) -> DataFrame:
    """``key, segment`` of the components linked by edges of non-zero weight."""
    found = connected_components(tensors.select(C("key").alias("id")), graph.where(C("weight") != 0))
    return found.select(C("id").alias("key"), C("component").alias("segment"))


def _segment_tensors(tensors: DataFrame, segments: DataFrame) -> DataFrame:
    pooled = merge_tensors(tensors.select("key", "n", "cx", "cy", "cz", *linalg.SYMMETRIC).join(segments, "key"), ["segment"])
    return linalg.with_eigen(pooled)


def _plane_distance(side: str, centre: str) -> Column:
    delta = [C(f"{centre}_c{a}") - C(f"{side}_c{a}") for a in "xyz"]
    return F.abs(linalg.dot(delta, [C(f"{side}_plate")[i] for i in range(3)]))


def _prefixed(frame: DataFrame, prefix: str, key: str) -> DataFrame:
    return frame.select(C("segment").alias(key), *(C(n).alias(f"{prefix}_{n}") for n in ("n_tensors", "cx", "cy", "cz", "l1", "plate")))


def dissolve_entrapped(tensors: DataFrame, segments: DataFrame, adjacency: DataFrame, dominant: int = 10, small: int = 5,
                       variance: float = 0.01, distance: float = 0.1) -> DataFrame:
    """Give small segments to their dominant neighbours: new ``key, segment``.

    With one dominant neighbour the whole segment joins it if it is flat, near its plane and parallel to it; with two,
    each surface element joins the nearer plane (in place of a minimum cut).  ``adjacency``: ``label, neighbor``.
    """
    pooled = cut_lineage(_segment_tensors(tensors, segments))
    pairs = adjacency.select(C("label").alias("_s"), C("neighbor").alias("_d")).join(_prefixed(pooled, "s", "_s"), "_s").join(_prefixed(pooled, "d", "_d"), "_d")
    pairs = pairs.where((C("s_n_tensors") <= small) & (C("d_n_tensors") >= dominant))
    counts = pairs.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    pairs = cut_lineage(pairs.join(counts.where(C("_n") <= 2), "_s"))
    parallel = F.abs(linalg.dot([C("s_plate")[i] for i in range(3)], [C("d_plate")[i] for i in range(3)]))
    single = pairs.where((C("_n") == 1) & (C("s_l1") <= variance) & (_plane_distance("d", "s") / distance <= 3) & (parallel >= 0.9))
    single = single.select(C("_s").alias("segment"), C("_d").alias("_new"))
    elements = tensors.select("key", *(C(f"c{a}").alias(f"e_c{a}") for a in "xyz")).join(segments, "key")
    choice = elements.join(pairs.where(C("_n") == 2).withColumnRenamed("_s", "segment"), "segment").withColumn("_g", _plane_distance("d", "e"))
    choice = choice.groupBy("key").agg(F.min(F.struct("_g", "_d")).alias("_b")).select("key", C("_b._d").alias("_split"))
    return segments.join(single, "segment", "left").join(choice, "key", "left").select("key", F.coalesce("_split", "_new", "segment").alias("segment"))


def merge_dominant(tensors: DataFrame, segments: DataFrame, adjacency: DataFrame, dominant: int = 10, factor: float = 3.0) -> DataFrame:
    """Merge neighbouring dominant segments whose pooled tensor stays flat: smallest eigenvalue at most ``factor^2`` times
    the larger of the two (in place of a minimum cut between them)."""
    pooled = cut_lineage(_segment_tensors(tensors, segments))
    big = pooled.where(C("n_tensors") > dominant)
    side = lambda p, k: big.select(C("segment").alias(k), C("l1").alias(f"{p}_l1"), F.struct("n", "cx", "cy", "cz", *linalg.SYMMETRIC).alias(p))
    pairs = adjacency.where("label < neighbor").select(C("label").alias("a"), C("neighbor").alias("b")).join(side("_x", "a"), "a").join(side("_y", "b"), "b")
    parts = pairs.select(F.struct("a", "b").alias("pair"), F.explode(F.array("_x", "_y")).alias("_t")).select("pair", "_t.*")
    joint = linalg.eigenvalues(merge_tensors(parts, ["pair"])).select(C("pair.a").alias("a"), C("pair.b").alias("b"), "l1")
    limit = factor * factor * F.greatest("_x_l1", "_y_l1", F.lit(1e-12))
    good = joint.join(pairs.select("a", "b", "_x_l1", "_y_l1"), ["a", "b"]).where(C("l1") <= limit).select("a", "b")
    merged = connected_components(segments.select(C("segment").alias("id")), good)
    return segments.join(merged.withColumnRenamed("id", "segment"), "segment").select("key", C("component").alias("segment"))


def data_cost(points: DataFrame, candidates: DataFrame, tensors: DataFrame) -> DataFrame:
    """Cost ``(plane distance / sqrt(l1))^2`` of each candidate (``point_id, label``)."""
    t = tensors.select(C("key").alias("label"), "cx", "cy", "cz", "l1", "plate")
    j = lookup(candidates, t, ["label"]).join(points.select("point_id", "x", "y", "z"), "point_id")
    gap = linalg.dot([C(a) - C(f"c{a}") for a in "xyz"], [C("plate")[i] for i in range(3)])
    return j.select("point_id", "label", (gap * gap / F.greatest("l1", F.lit(1e-12))).alias("cost"))


def refine_point_labels(points: DataFrame, candidates: DataFrame, tensors: DataFrame, junk_cost: float = 100.0) -> DataFrame:
    """``point_id, label, cost``: the cheapest candidate segment, or -1 when none is cheaper than ``junk_cost^2``.

    The energy is a sum of independent point costs, so its optimum needs no random search.
    """
    cheap = data_cost(points, candidates, tensors).groupBy("point_id").agg(F.min(F.struct("cost", "label")).alias("_b"))
    junk = C("_b.cost") > junk_cost * junk_cost
    return cheap.select("point_id", F.when(junk, F.lit(-1)).otherwise(C("_b.label")).alias("label"), F.least(C("_b.cost"), F.lit(junk_cost * junk_cost)).alias("cost"))


def segment_energy(costs: DataFrame) -> DataFrame:
    return costs.agg(F.sum("cost").alias("energy"))


def scanline_segmentation(points: DataFrame, resolution: float, search_ratio: float = 0.75, ransac_ratio: float = 0.025,
                          min_points: int = 500, trials: int = 64, seed: int = 7) -> DataFrame:
    """Label scan lines ``az = a0 + a1 el + a2 el^2``: ``point_id, line`` (NULL when there is no line at all).

    Azimuth bins of width ``2 search_ratio resolution`` propose lines: every bin draws ``trials`` triples of its points
    by seeded hash order (a bounded sample per bin), each triple gives a parabola, and all points of the bin vote for all
    its parabolas in one join and aggregation.  The best parabola with at least ``min_points`` points in the bin becomes a
    line; every point then takes the line nearest in azimuth among its bin's and the bins around it.
    """
    width = 2 * search_ratio * resolution
    p = points.select("point_id", "az", "el", F.floor(C("az") / width).alias("bin"))
    crowded = p.groupBy("bin").agg(F.count(F.lit(1)).alias("_n")).where(C("_n") >= min_points)
    draws = 3 * trials
    keyed = lookup(p, crowded, ["bin"]).withColumn("_slot", F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(draws)))
    # One point per slot: the smallest hash, by a map-side combined aggregate.
    slots = keyed.groupBy("bin", "_slot").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "point_id").alias("h"), "az", "el")).alias("_p"))
    triples = slots.groupBy("bin", F.floor(C("_slot") / 3).alias("trial")).agg(F.sort_array(F.collect_list("_p")).alias("_t")).where(F.size("_t") == 3)
    x = [C("_t")[i]["el"] for i in range(3)]
    y = [C("_t")[i]["az"] for i in range(3)]
    d01, d12 = (y[1] - y[0]) / F.nullif(x[1] - x[0], F.lit(0.0)), (y[2] - y[1]) / F.nullif(x[2] - x[1], F.lit(0.0))
    a2 = (d12 - d01) / F.nullif(x[2] - x[0], F.lit(0.0))
    lines = triples.select("bin", "trial", a2.alias("a2"), (d01 - a2 * (x[0] + x[1])).alias("a1"), (y[0] - d01 * x[0] + a2 * x[0] * x[1]).alias("a0")).where(C("a2").isNotNull())
    miss = F.abs(C("a0") + C("a1") * C("el") + C("a2") * C("el") * C("el") - C("az"))
    lines = cut_lineage(lines)
    packed = lines.groupBy("bin").agg(F.collect_list(F.struct("trial", "a0", "a1", "a2")).alias("_lines"))  # at most `trials`
    votes = lookup(p, packed, ["bin"]).select("bin", "az", "el", F.explode("_lines").alias("_l")).select("bin", "az", "el", "_l.*")
    votes = votes.where(miss < ransac_ratio * resolution).groupBy("bin", "trial").agg(F.count(F.lit(1)).alias("_v"))
    best = votes.groupBy("bin").agg(F.max(F.struct("_v", (-C("trial")).alias("_k"))).alias("_b")).select("bin", (-C("_b._k")).alias("trial"))
    chosen = cut_lineage(lines.join(best, ["bin", "trial"]).select(C("bin").alias("line"), "a0", "a1", "a2"))
    offered = chosen.withColumn("bin", F.explode(F.array(C("line") - 1, C("line"), C("line") + 1)))
    offered = offered.groupBy("bin").agg(F.collect_list(F.struct("line", "a0", "a1", "a2")).alias("_o"))  # at most three
    # The nearest of the three in the row itself: points need not meet again.
    off = lambda l: F.abs(l["a0"] + l["a1"] * C("el") + l["a2"] * C("el") * C("el") - C("az"))
    near = F.array_min(F.transform("_o", lambda l: F.struct(off(l).alias("d"), l["line"].alias("line"))))
    return lookup(p, offered, ["bin"], "left").select("point_id", near["line"].alias("line"))
