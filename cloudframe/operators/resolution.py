"""Features on several resolutions: a hierarchy of cells, features of its nodes, values handed back down to the points.

The hierarchy is a table of nodes (level, cell, pooled tensor).  The finest level is one aggregation of the points; every
coarser one is one aggregation of the level below, whose nodes it pools, so only the first reads the points.  Features are
computed per node.  They go down the hierarchy from node to node and reach the points in one join with the finest nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cloudframe.functions import linalg, weights
from cloudframe.lineage import cut_lineage
from cloudframe.operators import joins, saliency
from cloudframe.operators.smoothing import extent
from cloudframe.operators.tensors import merge_tensors, moments
from cloudframe.skew import salted

C = F.col
CELL = ["ci", "cj", "ck"]


def placed_in_cells(points: DataFrame, smallest: float) -> DataFrame:
    """``points`` with the numbers ``ci, cj, ck`` of their cell of side ``smallest``, counted from the smallest coordinates."""
    placed = points.withColumn("_e", extent(points))
    return placed.withColumns({c: F.floor((C(a) - C(f"_e.{a}_min")) / smallest) for c, a in zip(CELL, "xyz")}).drop("_e")


def cell_hierarchy(placed: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes of each level, the finest first: cell numbers, ``n``, centroid and covariance.

    A cell of a level holds eight of the level below: the numbers of a node's parent are its own shifted by a bit.  Points
    without coordinates lie in no cell.
    """
    inside = placed.where(" AND ".join(f"{c} IS NOT NULL" for c in CELL))
    nodes = [cut_lineage(moments(inside, CELL, min_points=0))]
    for _ in range(1, levels):
        parents = nodes[-1].withColumns({c: F.shiftright(c, 1) for c in CELL})
        nodes.append(cut_lineage(merge_tensors(parents, CELL).drop("n_tensors")))
    return nodes


def node_features(nodes: DataFrame, side: float, neighbors: int | float = 1.6, ring: tuple[float, float] = (0.4, 0.6),
                  curvature_weight: float = 0.5, sigma_normal: float = 0.01, sigma_curvature: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """Cell numbers, normal, surface variation ``k`` and directional ``saliency`` of the nodes of one level.

    ``neighbors``: how many nearest nodes (a whole number), or the radius in units of the cell's ``side``.  Distances weigh
    by a Gaussian ring, ``(sigma, rho)`` in the same unit.
    """
    axes = linalg.with_eigen(nodes)
    variation = F.coalesce(F.try_divide(C("l1"), C("l1") + C("l2") + C("l3")), F.lit(0.0))
    places = cut_lineage(axes.select(F.concat_ws("_", *CELL).alias("point_id"), *CELL, *(C(f"c{a}").alias(a) for a in "xyz"),
                                     *(C("plate")[i].alias(f"n{a}") for i, a in enumerate("xyz")), variation.alias("k")))
    names = ("nx", "ny", "nz", "k")
    both = places.withColumns({f"c{n}": C(n) for n in names})
    if isinstance(neighbors, int):
        edges = joins.knn(places, places, neighbors)
        edges = edges.join(both.select("point_id", *(f"c{n}" for n in names)), "point_id").join(
            places.select(C("point_id").alias("nid"), *names), "nid")
    else:
        edges = joins.radius_neighbors(both, neighbors * side, carry=names, carry_left=tuple(f"c{n}" for n in names))
    sigma, rho = ring
    centre = math.exp(-rho * rho / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma)
    values = saliency.directional_saliency(edges, weights.weight_gaussian_ring(C("dist") / side, sigma, rho), centre, curvature_weight,
                                           sigma_normal, sigma_curvature, alpha, points=places)
    return places.join(values.select("point_id", "saliency"), "point_id").select(*CELL, *names, "saliency")


def multi_resolution_saliency(points: DataFrame, smallest: float, levels: int = 3, **options) -> DataFrame:
    """``point_id, saliency, saliencies, normals, curvatures``: what the nodes around a point say, and the mean saliency.

    The arrays hold one entry per level, the finest (cells of side ``smallest``) first.  ``options`` are those of
    ``node_features``.  Points without coordinates have NULLs.
    """
    placed = placed_in_cells(points, smallest)
    hierarchy = cell_hierarchy(placed, levels)
    below = None
    for level in reversed(range(levels)):
        described = node_features(hierarchy[level], smallest * 2 ** level, **options)
        described = described.select(*CELL, F.struct("saliency", F.array("nx", "ny", "nz").alias("normal"), "k").alias("_own"))
        if below is None:
            below = described.select(*CELL, F.array("_own").alias("_all"))
        else:
            above = below.withColumnsRenamed({c: f"_p{c}" for c in CELL})
            parent = [F.shiftright(c, 1) == C(f"_p{c}") for c in CELL]
            below = described.join(above, parent[0] & parent[1] & parent[2]).select(*CELL, F.concat(F.array("_own"), "_all").alias("_all"))
        below = cut_lineage(below)
    # A cell may hold a large share of the points.
    left, right, on = salted(placed.select("point_id", *CELL), below, CELL, C("point_id"), F.concat_ws("_", *CELL), count="left")
    found = left.join(right, on, "left")
    mean = F.aggregate("_all", F.lit(0.0), lambda total, x: total + x["saliency"]) / levels
    return found.select("point_id", mean.alias("saliency"), C("_all.saliency").alias("saliencies"), C("_all.normal").alias("normals"),
                        C("_all.k").alias("curvatures"))
