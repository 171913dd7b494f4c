"""Saliency and local descriptors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.functions import linalg
from cloudframe.functions.quantiles import chi2_quantile_of
from cloudframe.lineage import cut_lineage
from cloudframe.operators import joins
from cloudframe.operators.tensors import multiplicity
from cloudframe.ordering import global_rank, percentile

C = F.col
# Differences below these sizes count as zero.
NORMAL_ZERO, CURVATURE_ZERO = 0.016, 0.04
# A neighbour takes part when its weight exceeds this.
ACTIVE_WEIGHT = 0.01
# A difference is dropped when more than this share of the active neighbours shows none.
ZERO_SHARE = 0.6
BINS = 11


def scale_values(df: DataFrame, column: str, out: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rescale a column to [low, high]; an all-zero column stays as it is."""
    stats = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s")).scalar()
    df = df.withColumn("_s", stats)
    span = F.nullif(C("_s.hi") - C("_s.lo"), F.lit(0.0))
    scaled = (high - low) * (C(column) - C("_s.lo")) / span + low
    return df.withColumn(out, F.when((C("_s.lo") == 0) & (C("_s.hi") == 0), C(column)).otherwise(scaled)).drop("_s")


def im2double(df: DataFrame, column: str, out: str) -> DataFrame:
    return scale_values(df, column, out)


def threshold_zero(value: Column, eps: float = 1e-5) -> Column:
    return F.when(F.abs(value) < eps, 0.0).otherwise(value)


def directional_saliency(edges: DataFrame, weight: Column, centre_weight: float, curvature_weight: float = 0.5,
                         sigma_normal: float = 0.01, sigma_curvature: float = 0.1, alpha: float = 0.05,
                         points: DataFrame | None = None) -> DataFrame:
    """``point_id, saliency, dn, dk``: how much normals and curvature differ from those of the surroundings.

    ``edges`` carry normals (cnx.. of the centre, nx.. of the neighbour) and curvature (ck, k).  ``weight`` is a column
    over the edges and ``centre_weight`` its value for the centre, which only counts among the active points.  A
    difference is dropped if most active neighbours show none or a chi-square test (lower tail ``alpha``) finds its
    spread within ``sigma``.  Both parts are scaled to [0, 1] over the cloud; ``points`` without edges differ by 0.
    """
    m = multiplicity(edges)
    turn = 1 - linalg.dot([C(f"cn{a}") for a in "xyz"], [C(f"n{a}") for a in "xyz"])
    e = edges.withColumns({"_w": weight, "_dn": turn, "_dk": C("k") - C("ck")})
    active = C("_w") > ACTIVE_WEIGHT
    def spread(c):
        return [F.sum(m * C(c)).alias(f"{c}_1"), F.sum(m * C(c) * C(c)).alias(f"{c}_2"),
                F.sum(F.when(C(c).isNotNull(), m)).alias(f"{c}_n")]
    sums = e.groupBy("point_id").agg(
        F.sum(m).alias("_n"), (F.sum(F.when(active, m).otherwise(0.0)) + int(centre_weight > ACTIVE_WEIGHT)).alias("_active"),
        F.sum(F.when(active & (F.abs("_dn") < NORMAL_ZERO), m).otherwise(0.0)).alias("_zn"),
        F.sum(F.when(active & (F.abs("_dk") <= CURVATURE_ZERO), m).otherwise(0.0)).alias("_zk"),
        F.sum(m * F.abs("_dn") * C("_w")).alias("_swn"), F.sum(m * C("_dk") * C("_w")).alias("_swk"),
        F.sum(m * C("_w")).alias("_sw"), *spread("_dn"), *spread("_dk"))
    sums = sums.withColumn("_limit", chi2_quantile_of(alpha, C("_active").cast("int")))
    def std(c):
        mean = C(f"{c}_1") / C(f"{c}_n")
        return F.sqrt(F.greatest(F.lit(0.0), C(f"{c}_2") / C(f"{c}_n") - mean * mean))
    def part(c, zeros, sigma, value):
        quiet = (C(zeros) > ZERO_SHARE * C("_active")) | ((C("_n") - 1) * std(c) / sigma < C("_limit"))
        return F.coalesce(F.when((C("_n") < 4) | quiet, 0.0).otherwise(F.try_divide(value, C("_sw"))), F.lit(0.0))
    out = sums.select("point_id", part("_dn", "_zn", sigma_normal, C("_swn")).alias("dn"),
                      part("_dk", "_zk", sigma_curvature, F.abs("_swk")).alias("dk"))
    out = cut_lineage(out if points is None else joins.every(points, out, dn=0.0, dk=0.0))  # scaling reads it three times
    out = scale_values(scale_values(out, "dn", "dn"), "dk", "dk")
    return out.select("point_id", ((1 - curvature_weight) * C("dn") + curvature_weight * C("dk")).alias("saliency"), "dn", "dk")


# The lower triangle of a 3x3 Cholesky factor.
TRIANGLE = ["_l0", "_l1", "_l2", "_l3", "_l4", "_l5"]


def pointwise_pca_saliency(tensors: DataFrame, components: int = 3, weights: list[float] | None = None) -> DataFrame:
    """Projection size of each tensor's sigma set on the main axes of all sigma sets.

    A sigma set stacks ``sqrt(2) L`` and ``-sqrt(2) L`` of the Cholesky factor L, so its 18x18 covariance is
    ``[[S, -S], [-S, S]]`` of the 6x6 covariance S of the factor's entries: one aggregation of 27 sums, one tiny
    eigen-decomposition on the driver, one projection.  Tensors without a factor (singular) give NULL.
    """
    weights = weights or [1.0] * components
    root = lambda e: F.when(e > 1e-14, F.sqrt(e))
    t = tensors.withColumn("_l0", root(C("cxx")))
    t = t.withColumns({"_l1": C("cxy") / C("_l0"), "_l3": C("cxz") / C("_l0")})
    t = t.withColumn("_l2", root(C("cyy") - C("_l1") * C("_l1")))
    t = t.withColumn("_l4", (C("cyz") - C("_l3") * C("_l1")) / C("_l2"))
    t = t.withColumn("_l5", root(C("czz") - C("_l3") * C("_l3") - C("_l4") * C("_l4")))
    whole = t.where(C("_l5").isNotNull())
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    row = whole.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in TRIANGLE),
                    *(F.covar_pop(TRIANGLE[i], TRIANGLE[j]).alias(f"c{i}{j}") for i, j in pairs)).first()
    if not row["n"]:
        return t.select("point_id", F.lit(None).cast("double").alias("saliency"))
    cov = np.empty((6, 6))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}{j}"]
    # Eigenvectors of the doubled set are (v, -v)/sqrt(2): a projection is sqrt(2) * sqrt(2) * <L, v>.
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :components]
    total = sum((w * F.abs(2.0 * sum((C(c) * float(a) for c, a in zip(TRIANGLE[1:], axis[1:])), C("_l0") * float(axis[0])))
                 for w, axis in zip(weights, axes.T)), F.lit(0.0))
    return t.select("point_id", F.when(C("_l5").isNotNull(), total).alias("saliency"))


def percentile_gate(df: DataFrame, column: str, share: float, out: str) -> DataFrame:
    """Values below the percentile (exact, interpolated) become 0."""
    limit = percentile(df, column, [share]).scalar()
    return df.withColumn("_limit", limit).withColumn(
        out, F.when(C(column) < C("_limit"), 0.0).otherwise(C(column))).drop("_limit")


def multiscale_saliency(scales: list[DataFrame], shares: list[float], eps: float = float(np.finfo(float).eps)) -> DataFrame:
    """Sum over scales of the gated and rescaled saliency; each frame holds ``point_id, saliency``."""
    parts = []
    for frame, share in zip(scales, shares):
        gated = percentile_gate(frame.select("point_id", "saliency"), "saliency", share, "saliency")
        stats = gated.agg(F.struct(F.min("saliency").alias("lo"), F.max("saliency").alias("hi")).alias("s")).scalar()
        gated = gated.withColumn("_s", stats)
        scaled = (C("saliency") - C("_s.lo")) / (C("_s.hi") - C("_s.lo") + eps)
        parts.append(cut_lineage(gated.select("point_id", scaled.alias("saliency"))))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union.groupBy("point_id").agg(F.sum("saliency").alias("saliency"))


def saliency_value_scaling(df: DataFrame, column: str, out: str) -> DataFrame:
    """Logarithm of the values clamped to three standard deviations around the mean."""
    stats = df.agg(F.struct(F.avg(column).alias("a"), F.stddev_pop(column).alias("s")).alias("s")).scalar()
    df = df.withColumn("_s", stats)
    low, high = C("_s.a") - 3 * C("_s.s"), C("_s.a") + 3 * C("_s.s")
    return df.withColumn(out, F.log(F.greatest(low, F.least(high, C(column))))).drop("_s")


# --- feature histograms -----------------------------------------------------------------------------------------------

def spfh(edges: DataFrame, bins: int = BINS, points: DataFrame | None = None) -> DataFrame:
    """Simplified point feature histograms: ``point_id, n, h ARRAY(3 * bins)``.

    Per edge, in the frame u = centre normal, v = direction x u, w = u x v: alpha = v.n, phi = u.direction,
    theta = atan(w.n / u.n); negative values are shifted by 2 pi and counted in equal bins of [0, 2 pi].  Two neighbours
    or fewer give zeros, and so do ``points`` without edges.
    """
    m = multiplicity(edges)
    u, t = [C(f"cn{a}") for a in "xyz"], [C(f"n{a}") for a in "xyz"]
    e = edges.withColumns({f"_e{a}": C(f"d{a}") / C("dist") for a in "xyz"})
    direction = [C(f"_e{a}") for a in "xyz"]
    e = e.withColumns(dict(zip(("_vx", "_vy", "_vz"), linalg.cross(direction, u))))
    v = [C(f"_v{a}") for a in "xyz"]
    e = e.withColumns({"_ut": linalg.dot(u, t), "_wt": linalg.dot(linalg.cross(u, v), t),
                       "_alpha": linalg.dot(v, t), "_phi": linalg.dot(u, direction)})
    theta = F.when(C("_ut") != 0, F.atan(F.try_divide("_wt", "_ut"))).when(C("_wt") != 0, F.signum("_wt") * (math.pi / 2))
    e = e.withColumn("_theta", theta)
    # Rounding noise around zero must not be shifted by a full turn.
    position = lambda c: F.when(C(c) < -1e-9, C(c) + 2 * math.pi).otherwise(F.greatest(F.lit(0.0), C(c))) / (2 * math.pi) * bins
    e = e.withColumns({f"{c}_b": F.least(F.floor(position(c)), F.lit(bins - 1)) for c in ("_alpha", "_phi", "_theta")})
    counts = [F.sum(F.when(C(f"{c}_b") == b, m).otherwise(0.0)).alias(f"{c}{b}")
              for c in ("_alpha", "_phi", "_theta") for b in range(bins)]
    sums = e.groupBy("point_id").agg(F.sum(m).alias("n"), *counts)
    names = [f"{c}{b}" for c in ("_alpha", "_phi", "_theta") for b in range(bins)]
    sums = sums.withColumn("n", C("n").cast("bigint"))
    sums = sums if points is None else joins.every(points, sums, n=0)
    return sums.select("point_id", "n",
                       F.array(*(F.when(C("n") <= 2, 0.0).otherwise(C(x) / C("n")) for x in names)).alias("h"))


def fpfh(edges: DataFrame, histograms: DataFrame, bins: int = BINS) -> DataFrame:
    """Own histogram plus the mean of the neighbours' histograms divided by their distance (own only below two).

    Edges that carry the neighbour's histogram as ``h`` stay where they are; others are shuffled by neighbour.
    """
    m = multiplicity(edges)
    size = 3 * bins
    near = edges.withColumn("_m", m) if "h" in edges.columns else edges.select("point_id", "nid", "dist", m.alias("_m")).join(
        histograms.select(C("point_id").alias("nid"), "h"), "nid")
    sums = near.groupBy(*joins.centre(near)).agg(F.sum("_m").alias("_n"), *(
        F.sum(C("_m") * C("h")[i] / C("dist")).alias(f"_s{i}") for i in range(size)))
    out = histograms.join(sums, "point_id", "left")
    mixed = F.array(*(C("h")[i] + C(f"_s{i}") / C("_n") for i in range(size)))
    return out.select("point_id", F.when(C("_n") >= 2, mixed).otherwise(C("h")).alias("h"))


def chi2_distance(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Sum of ``(a - b)^2 / (a + b + eps)`` over two arrays."""
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + eps))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins; the last bin is closed on the right, values outside are left out."""
    width = (high - low) / bins
    inside = df.where((C(column) >= low) & (C(column) <= high))
    return inside.groupBy(F.least(F.lit(bins - 1), F.floor((C(column) - low) / width)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def top_fraction(df: DataFrame, score: str, share: float, rounding: str = "ceil") -> DataFrame:
    """The ``share`` of rows with the highest score (ties: smallest id first)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = global_rank(df.withColumn("_neg", -C(score)), ["_neg", "point_id"], "_rank").withColumn("_total", total)
    size = F.ceil(C("_total") * share) if rounding == "ceil" else F.floor(C("_total") * share)
    return ranked.where(C("_rank") <= size).drop("_neg", "_rank", "_total")


# --- cells ------------------------------------------------------------------------------------------------------------

def cell_neighbors_8sector(cells: DataFrame, buffer: int, min_per_sector: int = 1) -> tuple[DataFrame, DataFrame]:
    """Occupied cells around each occupied cell: (edges ``label, nlabel, drow, dcol``, ``label, n, sectors``).

    ``cells`` holds distinct ``row, col, label``.  The eight sectors are the four axes and the four quadrants of the
    (2 buffer + 1)^2 window; a sector counts when it holds at least ``min_per_sector`` cells.
    """
    offsets = F.sequence(F.lit(-buffer), F.lit(buffer))
    lhs = (cells.select("label", "row", "col").withColumn("drow", F.explode(offsets)).withColumn("dcol", F.explode(offsets))
           .where((C("drow") != 0) | (C("dcol") != 0))
           .select("label", "drow", "dcol", (C("row") + C("drow")).alias("row"), (C("col") + C("dcol")).alias("col")))
    edges = lhs.join(cells.select(C("label").alias("nlabel"), "row", "col"), ["row", "col"]).select(
        "label", "nlabel", "drow", "dcol")
    sector = (F.signum(C("drow").cast("double")) * 3 + F.signum(C("dcol").cast("double"))).cast("int")
    counted = [F.sum(F.when(sector == s, 1).otherwise(0)).alias(f"_s{s + 4}") for s in (-4, -3, -2, -1, 1, 2, 3, 4)]
    counts = edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *counted)
    populated = sum((F.when(C(f"_s{s + 4}") >= min_per_sector, 1).otherwise(0) for s in (-4, -3, -2, -1, 1, 2, 3, 4)), F.lit(0))
    return edges, counts.select("label", "n", populated.cast("int").alias("sectors"))


def cell_umbrella_curvature(edges: DataFrame, centroids: DataFrame, normals: DataFrame) -> DataFrame:
    """Mean projection of the unit directions to the neighbouring centroids on the cell normal: ``label, curvature``."""
    here = centroids.select("label", *(C(a).alias(f"_h{a}") for a in "xyz"))
    there = centroids.select(C("label").alias("nlabel"), *(C(a).alias(f"_t{a}") for a in "xyz"))
    e = edges.join(there, "nlabel").join(here, "label").withColumns({f"_d{a}": C(f"_t{a}") - C(f"_h{a}") for a in "xyz"})
    length = linalg.norm([C(f"_d{a}") for a in "xyz"])
    sums = e.withColumn("_len", length).groupBy("label").agg(F.count(F.lit(1)).alias("_n"), *(
        F.sum(C(f"_d{a}") / C("_len")).alias(f"_u{a}") for a in "xyz"))
    return sums.join(normals, "label").select("label", (
        linalg.dot([C(f"n{a}") for a in "xyz"], [C(f"_u{a}") for a in "xyz"]) / C("_n")).alias("curvature"))


def cell_saliency(edges: DataFrame, curvatures: DataFrame, buffer: int) -> DataFrame:
    """Curvature of the inner cells against that of the outer ones: ``label, saliency``.

    Cells up to Chebyshev distance ``buffer / 2`` weigh ``(3 buffer + 1)^2 / (buffer + 1)^2``, the others -1.
    """
    close = (2 * 1.5 * buffer + 1) ** 2 / (buffer + 1) ** 2
    near = F.greatest(F.abs(C("drow")), F.abs(C("dcol"))) <= buffer / 2
    e = edges.join(curvatures.select(C("label").alias("nlabel"), F.abs("curvature").alias("_k")), "nlabel")
    sums = e.groupBy("label").agg(F.sum(F.when(near, close).otherwise(-1.0) * C("_k")).alias("_s"))
    own = curvatures.select("label", F.abs("curvature").alias("_own"))
    return own.join(sums, "label", "left").select(
        "label", F.abs(F.coalesce(C("_s"), F.lit(0.0)) + C("_own") * close).alias("saliency"))


def common_plane(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares plane of each group: unit normal and ``d`` with ``n . p = d`` on the plane's points on average."""
    from cloudframe.operators.tensors import moments
    planes = linalg.with_eigen(moments(points, keys, min_points=0))
    return planes.select(*keys, *(C("plate")[i].alias(n) for i, n in enumerate(("nx", "ny", "nz"))),
                         linalg.dot([C("plate")[i] for i in range(3)], [C("cx"), C("cy"), C("cz")]).alias("d"))
