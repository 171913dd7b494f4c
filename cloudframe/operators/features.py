"""Normals, shape and curvature of neighbourhoods.

Operators read an edge table (see ``joins``); ``m`` on an edge is the multiplicity of the neighbour.  Where an operator
needs the centre's normal on every edge, let the distance join carry it (``carry_left``): the edges then never have to
be shuffled by point, only their partial sums are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.functions import geometry, linalg, quantiles
from cloudframe.lineage import cut_lineage
from cloudframe.operators import joins
from cloudframe.operators.tensors import PAIRS, gaussian_density, moments, multiplicity, tensor_from_neighbors
from cloudframe.skew import salted

C = F.col
DELTA = ["dx", "dy", "dz"]
NORMAL = ["nx", "ny", "nz"]


def _axis_columns(axis: str, names: list[str]) -> list[Column]:
    return [C(axis)[i].alias(n) for i, n in enumerate(names)]


def normals_from_tensors(tensors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``point_id, nx, ny, nz``: the plate axis (NULL where the plane is undefined); ``keep`` names columns to keep."""
    return linalg.with_eigen(tensors).select("point_id", *_axis_columns("plate", NORMAL), *keep)


def normals_pca(points: DataFrame, edges: DataFrame, viewpoint: tuple[float, float, float] = (0.0, 0.0, 30.0)) -> DataFrame:
    """Axis least aligned with the unit directions to the neighbours, turned to the viewpoint and then to z >= 0.

    NULL with fewer than three neighbours.
    """
    m = multiplicity(edges)
    squares = C("dist") * C("dist")
    sums = edges.groupBy(*joins.centre(edges)).agg(F.sum(m).alias("_n"), *(
        F.sum(m * C(f"d{a}") * C(f"d{b}") / squares).alias(f"c{a}{b}") for a, b in PAIRS)).where(C("_n") >= 3)
    axes = linalg.with_eigen(sums).select("point_id", *_axis_columns("plate", NORMAL))
    seen = points.select("point_id", *((F.lit(float(v)) - C(a)).alias(f"_v{a}") for v, a in zip(viewpoint, "xyz")))
    out = seen.join(axes, "point_id", "left")
    n = [C(c) for c in NORMAL]
    towards = linalg.dot(n, [C(f"_v{a}") for a in "xyz"])
    out = out.withColumn("_sign", F.when(n[2] < 0, -1.0).when(n[2] > 0, 1.0).when(towards < 0, -1.0).otherwise(1.0))
    return out.select("point_id", *((C("_sign") * C(c)).alias(c) for c in NORMAL))


def normals_hybrid(points: DataFrame, edges: DataFrame, camera: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """PCA normals of radius, k-nearest or hybrid edges (the point itself takes part), turned to the camera."""
    m = multiplicity(edges)
    sums = edges.groupBy(*joins.centre(edges)).agg((F.sum(m) + 1).alias("_n"), *(F.sum(m * C(f"d{a}")).alias(f"_s{a}") for a in "xyz"),
                                         *(F.sum(m * C(f"d{a}") * C(f"d{b}")).alias(f"_s{a}{b}") for a, b in PAIRS))
    cov = sums.where(C("_n") >= 3).select("point_id", *(
        (C(f"_s{a}{b}") / C("_n") - C(f"_s{a}") / C("_n") * C(f"_s{b}") / C("_n")).alias(f"c{a}{b}") for a, b in PAIRS))
    axes = linalg.with_eigen(cov).select("point_id", *_axis_columns("plate", NORMAL))
    out = points.select("point_id", *XYZ_COLUMNS).join(axes, "point_id", "left")
    towards = linalg.dot([C(c) for c in NORMAL], [F.lit(float(v)) - C(a) for v, a in zip(camera, "xyz")])
    return out.withColumn("_sign", F.when(towards < 0, -1.0).otherwise(1.0)).select(
        "point_id", *((C("_sign") * C(c)).alias(c) for c in NORMAL))


XYZ_COLUMNS = ["x", "y", "z"]


def range_scaled_radius(coefficient: float) -> Column:
    """Search radius proportional to the distance from the scanner: 0.1 % of the range per unit of ``coefficient``."""
    return F.lit(coefficient * 0.10 / 100) * linalg.norm([C(a) for a in XYZ_COLUMNS])


def variable_radius_neighbors(points: DataFrame, radius: Column, carry: tuple[str, ...] = (),
                              carry_left: tuple[str, ...] = ()) -> DataFrame:
    """Edges within a radius of each point's own, with that radius as ``reach``.

    Radii fall into classes (powers of two); a class has cells of its own size, and a point visits those of 27 cells that
    its ball touches.
    """
    asked = points.withColumn("reach", radius).where(C("reach") > 0)
    asked = asked.withColumn("_class", F.ceil(F.log2("reach")).cast("int"))
    classes = cut_lineage(asked.select("_class").distinct())
    used = [r[0] for r in classes.collect()]  # one value per power of two
    keys = ["_class", "_c0", "_c1", "_c2"]
    size = F.pow(F.lit(2.0), C("_class"))
    lhs = asked.select("point_id", "reach", "_class", *(C(a).alias(f"_l{a}") for a in "xyz"), *carry_left)
    lhs = lhs.withColumn("_gap", F.lit(0.0))
    for i, a in enumerate("xyz"):
        home = F.floor(C(f"_l{a}") / size)
        lhs = lhs.withColumn(f"_c{i}", F.explode(F.array(home - 1, home, home + 1)))
        gap = F.greatest(F.lit(0.0), C(f"_c{i}") * size - C(f"_l{a}"), C(f"_l{a}") - (C(f"_c{i}") + 1) * size)
        lhs = lhs.withColumn("_gap", C("_gap") + gap * gap).where((C("_gap") <= C("reach") * C("reach") * (1 + 1e-9)) | F.isnan("_gap"))
    lhs = lhs.drop("_gap")
    rhs = points.select(C("point_id").alias("nid"), *(C(a).alias(f"_r{a}") for a in "xyz"), *carry)
    rhs = rhs.withColumn("_class", F.explode(F.array(*(F.lit(u) for u in sorted(used)) or [F.lit(0)])))
    rhs = rhs.withColumns({f"_c{i}": F.floor(C(f"_r{a}") / size) for i, a in enumerate("xyz")})
    lhs, rhs, on = salted(lhs, rhs, keys, C("point_id"), C("nid"))
    pairs = lhs.join(rhs, on).withColumns({f"d{a}": C(f"_r{a}") - C(f"_l{a}") for a in "xyz"})
    pairs = pairs.withColumn("dist", linalg.norm([C(c) for c in DELTA]))
    return pairs.where((C("dist") > 0) & (C("dist") <= C("reach"))).select(
        "point_id", "nid", *DELTA, "dist", "reach", *carry, *carry_left)


def normal_weighted(edges: DataFrame) -> DataFrame:
    """Normal from Gaussian weights of width ``reach / 3`` about the point; NULL with fewer than six points (itself
    counted).  ``edges`` come from ``variable_radius_neighbors``."""
    w = multiplicity(edges) * gaussian_density(C("dist"), C("reach") / 3)
    sums = edges.groupBy(*joins.centre(edges)).agg((F.sum(multiplicity(edges)) + 1).alias("_n"), F.sum(w).alias("_w"), *(
        F.sum(w * C(f"d{a}") * C(f"d{b}")).alias(f"_s{a}{b}") for a, b in PAIRS)).where(C("_n") > 5)
    cov = sums.select("point_id", *(F.try_divide(f"_s{a}{b}", "_w").alias(f"c{a}{b}") for a, b in PAIRS))
    return normals_from_tensors(cov)


def dip_direction(normal: list[Column]) -> Column:
    """``asin`` of the horizontal share of the normal (radians)."""
    return F.asin(F.least(F.lit(1.0), F.try_divide(F.sqrt(normal[0] * normal[0] + normal[1] * normal[1]), linalg.norm(normal))))


def incidence_angle(ray: list[Column], normal: list[Column]) -> Column:
    """Angle in degrees between the ray from the scanner and the normal."""
    cosine = F.try_divide(linalg.dot(ray, normal), linalg.norm(ray) * linalg.norm(normal))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def incidence_angles(points: DataFrame, normals: DataFrame) -> DataFrame:
    """Incidence angle per point, its normal turned to the normal of its side of the cloud.

    The plane through the middle of the extent with the cloud's own normal cuts it into two sides; the smallest
    principal axis (sample covariance) of each side orients the normals of its points.
    """
    whole = linalg.with_eigen(moments(points, [], sample=True, min_points=0))
    axis = whole.select(C("plate")).scalar()
    middle = points.agg(F.array(*((F.max(a) + F.min(a)) / 2 for a in "xyz")).alias("m")).scalar()
    placed = points.select("point_id", "x", "y", "z").withColumns({"_axis": axis, "_mid": middle})
    offset = sum(((C(a) - C("_mid")[i]) * C("_axis")[i] for i, a in enumerate("xyz") if i), (C("x") - C("_mid")[0]) * C("_axis")[0])
    placed = placed.withColumn("side", F.when(offset >= 0, 1).otherwise(0)).drop("_axis", "_mid")
    sides = linalg.with_eigen(moments(placed, ["side"], sample=True, min_points=0)).select(
        "side", *_axis_columns("plate", ["_sx", "_sy", "_sz"]))  # two rows
    turned = placed.join(F.broadcast(sides), "side").join(normals, "point_id")
    n = [C(c) for c in NORMAL]
    turned = turned.withColumn("_sign", F.when(linalg.dot(n, [C("_sx"), C("_sy"), C("_sz")]) < 0, -1.0).otherwise(1.0))
    turned = turned.withColumns({c: C("_sign") * C(c) for c in NORMAL})
    return turned.select("point_id", "side", incidence_angle([C(a) for a in "xyz"], n).alias("angle"))


# --- shape of tensors -------------------------------------------------------------------------------------------------

def tensor_shape(tensors: DataFrame) -> DataFrame:
    """Add dimensionality shares, surface variation and the class point / line / plane to a table with l1 <= l2 <= l3."""
    total = F.nullif(C("l1") + C("l2") + C("l3"), F.lit(0.0))
    s1, s2, s3 = (F.sqrt(C(c)) for c in ("l3", "l2", "l1"))
    near = lambda low: (C("l3") < 10 * C(low))  # the largest is less than ten times this one
    return tensors.withColumns({
        "p1": C("l3") / total, "p2": C("l2") / total, "p3": C("l1") / total,
        "a1d": F.try_divide(s1 - s2, s1), "a2d": F.try_divide(s2 - s3, s1), "a3d": F.try_divide(s3, s1), "variation": C("l1") / total,
        "shape": F.when(near("l2") & near("l1"), "point").when(C("l3") / total > 0.6, "line").otherwise("plane")})


def distance_to_tensor(delta: list[Column], plate: list[Column], stick: list[Column], kind: str = "all",
                       signed: bool = False) -> Column:
    """Distance of a point (``delta`` = point - reference point) to a tensor's line, plane, point or the least of them."""
    if kind == "plate":
        along = linalg.dot(delta, plate)
        return along if signed else F.abs(along)
    if kind == "stick":
        return linalg.norm(linalg.cross(stick, delta))
    if kind == "ball":
        return linalg.norm(delta)
    if kind == "all":
        return F.least(*(distance_to_tensor(delta, plate, stick, k) for k in ("stick", "plate", "ball")))
    raise ValueError(f"unknown tensor distance {kind!r}")


# --- validity of neighbourhoods ---------------------------------------------------------------------------------------

def _sector_angle(dx: Column, dy: Column) -> Column:
    angle = F.when(F.abs(dx) > 1e-6, F.atan2(dy, dx)).when(dy > 0, math.pi / 2).when(dy < 0, 3 * math.pi / 2).otherwise(0.0)
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def neighborhood_valid(edges: DataFrame, min_points: int = 5, min_points_in_sector: float = 2, valid_sectors: int = 7,
                       num_sectors: int = 8, sectors: str = "reference", delta: tuple[str, str] = ("dx", "dy"),
                       points: DataFrame | None = None) -> DataFrame:
    """Per point: ``n``, number of populated sectors and ``valid``.

    ``sectors='reference'``: starts spread evenly over 0..270 degrees, each as wide as 180 / (num_sectors / 2), closed on
    both sides, the centre counted at angle 0 (the sectors overlap).  ``'even'``: eight half-open sectors of 45 degrees.
    Valid means more than ``min_points`` neighbours and at least ``valid_sectors`` populated sectors.  With ``points``
    those without edges have a row too: 0, 0 and false.
    """
    sums, starts = sector_sums(edges, num_sectors, sectors, delta)
    out = _validity(edges.groupBy(*joins.centre(edges)).agg(*sums), starts, min_points, min_points_in_sector, valid_sectors, sectors)
    out = out.select("point_id", "n", "sectors", "valid")
    return out if points is None else joins.every(points, out, n=0, sectors=0, valid=False)


def sector_sums(edges: DataFrame, num_sectors: int = 8, sectors: str = "reference", delta: tuple[str, str] = ("dx", "dy")) -> tuple[list[Column], list[float]]:
    """Sums ``n`` and ``_s0, _s1, ..`` of the edges of a point, for ``neighborhood_valid``, and where the sectors start."""
    m = multiplicity(edges)
    if sectors == "reference":
        width = math.pi / (num_sectors // 2)
        starts = [1.5 * math.pi * i / (num_sectors - 1) for i in range(num_sectors)]
        inside = lambda a, s: (a >= s) & (a <= s + width)
    else:
        width = 2 * math.pi / num_sectors
        starts = [width * i for i in range(num_sectors)]
        inside = lambda a, s: (a > s) & (a <= s + width)
    angle = _sector_angle(C(delta[0]), C(delta[1]))
    sums = [F.sum(F.when(inside(angle, F.lit(s)), m).otherwise(0.0)).alias(f"_s{i}") for i, s in enumerate(starts)]
    return [F.sum(m).cast("bigint").alias("n"), *sums], starts


def _validity(sums: DataFrame, starts: list[float], min_points: int, min_points_in_sector: float, valid_sectors: int, sectors: str) -> DataFrame:
    centre = [1 if sectors == "reference" and s == 0 else 0 for s in starts]
    populated = sum((F.when(C(f"_s{i}") + c >= min_points_in_sector, 1).otherwise(0) for i, c in enumerate(centre)), F.lit(0))
    return sums.withColumn("sectors", populated.cast("int")).withColumn("valid", (C("n") >= min_points + 1) & (C("sectors") >= valid_sectors))


# --- curvature --------------------------------------------------------------------------------------------------------

def umbrella_curvature(edges: DataFrame, normals: DataFrame, valid: DataFrame | None = None, roughness: float = 0.01,
                       alpha: float = 0.05, invalid_value: float | None = None) -> DataFrame:
    """Mean height of the neighbours over the tangent plane; 0 where it is not significant against ``roughness``.

    The projections are summed as a vector first, so the normal is needed once per point and not per edge.
    ``valid`` (from ``neighborhood_valid``) blanks the other points with ``invalid_value``.
    """
    m = multiplicity(edges)
    sums = edges.groupBy(*joins.centre(edges)).agg(F.sum(m).alias("_n"), *(F.sum(m * C(c)).alias(f"_{c}") for c in DELTA))
    out = sums.join(normals, "point_id")
    mean = linalg.dot([C(f"_{c}") for c in DELTA], [C(c) for c in NORMAL]) / C("_n")
    epsilon = quantiles.normal_quantile(1 - alpha / 2) * roughness
    out = out.withColumn("_mean", mean)
    value = F.when(F.abs(C("_mean")) < epsilon, 0.0).otherwise(C("_mean"))
    if valid is not None:
        out = out.join(valid.select("point_id", "valid"), "point_id")
        value = F.when(C("valid"), value)
    return out.select("point_id", F.coalesce(value, F.lit(invalid_value).cast("double")).alias("umbrella"))


def umbrella_from_neighbors(points: DataFrame, edges: DataFrame, roughness: float = 0.01, alpha: float = 0.05,
                            invalid_value: float | None = None) -> DataFrame:
    """Tensor normal, validity and umbrella curvature of every point in one pass over its edges.

    All three are sums per centre, and the normal enters after the sums, so the distance join runs once.
    """
    m = multiplicity(edges)
    sectors, starts = sector_sums(edges)
    squares = [F.sum(m * C(f"d{a}") * C(f"d{b}")).alias(f"_s{a}{b}") for a, b in PAIRS]
    sums = edges.groupBy(*joins.centre(edges)).agg(*sectors, *(F.sum(m * C(c)).alias(f"_{c}") for c in DELTA), *squares)
    sums = _validity(sums, starts, 5, 2, 7, "reference").where("valid")
    tensors = sums.withColumns({f"c{a}{b}": F.try_divide(f"_s{a}{b}", "n") for a, b in PAIRS})
    turned = linalg.with_eigen(tensors)
    mean = F.try_divide(linalg.dot([C(f"_{c}") for c in DELTA], [C("plate")[i] for i in range(3)]), C("n"))
    epsilon = quantiles.normal_quantile(1 - alpha / 2) * roughness
    out = turned.select("point_id", F.when(F.abs(mean) < epsilon, 0.0).otherwise(mean).alias("umbrella"))
    return every_value(points, out, invalid_value)


def every_value(points: DataFrame, values: DataFrame, invalid_value: float | None) -> DataFrame:
    return joins.every(points, values) if invalid_value is None else joins.every(points, values, umbrella=invalid_value)


def curvature_biquadratic(edges: DataFrame, alpha: float = 0.05, valid: DataFrame | None = None,
                          invalid_value: float | None = None, normal: tuple[str, ...] = ("cnx", "cny", "cnz")) -> DataFrame:
    """Principal curvatures of ``z = a x^2 + b y^2 + c x y`` in the frame of the normal: ``point_id, k1, k2``.

    ``edges`` carry the unit normal of the centre.  Coefficients that an F test (lower quantile at ``alpha``) cannot tell
    from zero give zero curvature; ``|k1 k2| > 1000`` and singular fits give ``invalid_value``.
    """
    m = multiplicity(edges)
    x, y, z = geometry.rotate_to_z([C(c) for c in normal], [C(c) for c in DELTA])
    local = edges.withColumns({"_x": x, "_y": y, "_z": z}).withColumns(
        {"_a": C("_x") * C("_x"), "_b": C("_y") * C("_y"), "_c": C("_x") * C("_y")})
    terms = [C("_a"), C("_b"), C("_c")]
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    sums = local.groupBy(*joins.centre(local)).agg(
        (F.sum(m) + 1).alias("_n"), F.sum(m * C("_z") * C("_z")).alias("_zz"),
        *(F.sum(m * terms[i] * terms[j]).alias(f"_n{i}{j}") for i, j in pairs),
        *(F.sum(m * t * C("_z")).alias(f"_r{i}") for i, t in enumerate(terms)))
    fit = linalg.with_solution3(sums, [C(f"_n{i}{j}") for i, j in pairs], [C(f"_r{i}") for i in range(3)], ["_p0", "_p1", "_p2"])
    explained = sum((C(f"_p{i}") * C(f"_r{i}") for i in (1, 2)), C("_p0") * C("_r0"))
    fit = fit.withColumn("_explained", explained)
    residual = F.greatest(F.lit(0.0), C("_zz") - C("_explained"))
    fit = fit.withColumn("_sigma2", residual / F.when(C("_n") > 3, C("_n") - 3))
    fit = fit.withColumn("_limit", quantiles.f_quantile_of(alpha, 3, C("_n").cast("int")))
    significant = C("_explained") > C("_limit") * C("_n") * C("_sigma2")
    fit = fit.withColumns({f"_p{i}": F.when(significant, C(f"_p{i}")).when(C(f"_p{i}").isNotNull(), 0.0) for i in range(3)})
    root = F.sqrt(4 * C("_p2") * C("_p2") + 4 * (C("_p0") - C("_p1")) * (C("_p0") - C("_p1"))) / 2
    fit = fit.withColumns({"k1": C("_p0") + C("_p1") + root, "k2": C("_p0") + C("_p1") - root})
    good = F.abs(C("k1") * C("k2")) <= 1e3
    if valid is not None:
        fit = fit.join(valid.select("point_id", "valid"), "point_id")
        good = good & C("valid")
    blank = F.lit(invalid_value).cast("double")
    return fit.select("point_id", *(F.when(good, C(k)).otherwise(blank).alias(k) for k in ("k1", "k2")))


QUADRATIC = ["_x * _x", "_y * _y", "_x * _y", "_x", "_y", "1.0"]


def _solve6(sums: DataFrame, out: str) -> DataFrame:
    """Solve the 6x6 normal equations of every row in one batched NumPy call per Arrow batch."""
    @F.pandas_udf("array<double>")
    def solve(entries: pd.Series) -> pd.Series:
        values = np.stack(entries.to_numpy()) if len(entries) else np.empty((0, 27))
        full = np.empty((len(values), 6, 6))
        upper = np.triu_indices(6)
        full[:, upper[0], upper[1]] = values[:, :21]
        full[:, upper[1], upper[0]] = values[:, :21]
        solved = np.full((len(values), 6), np.nan)
        regular = np.isfinite(values).all(axis=1)
        regular[regular] = np.linalg.cond(full[regular]) < 1e14
        solved[regular] = np.linalg.solve(full[regular], values[regular, 21:, None])[..., 0]
        return pd.Series([None if np.isnan(r[0]) else r for r in solved])
    names = [f"_q{i}{j}" for i in range(6) for j in range(i, 6)] + [f"_t{i}" for i in range(6)]
    return sums.withColumn(out, solve(F.array(*names))).drop(*names)


def quadratic_sums(w: Column) -> list[Column]:
    """The 27 sums of the normal equations of ``z = a x^2 + b y^2 + c x y + d x + e y + f`` over _x, _y, _z."""
    terms = [F.expr(t) for t in QUADRATIC]
    return ([F.sum(w * terms[i] * terms[j]).alias(f"_q{i}{j}") for i in range(6) for j in range(i, 6)]
            + [F.sum(w * terms[i] * C("_z")).alias(f"_t{i}") for i in range(6)])


def curvature_fundamental_form(edges: DataFrame, radius: float, normal: tuple[str, ...] = ("cnx", "cny", "cnz")) -> DataFrame:
    """Principal curvatures of the full quadratic surface in the frame of the normal.

    NULL with fewer than six neighbours or fewer than seven of eight even sectors holding ``85 * radius`` points.
    """
    m = multiplicity(edges)
    x, y, z = geometry.rotate_to_z([C(c) for c in normal], [C(c) for c in DELTA])
    local = edges.withColumns({"_x": x, "_y": y, "_z": z})
    # Sectors and normal equations are sums of the same edges: one pass, as the distance join is the work.
    sectors, starts = sector_sums(local, 8, "even", ("_x", "_y"))
    sums = local.groupBy(*joins.centre(local)).agg(*sectors, *quadratic_sums(m))
    sums = _validity(sums, starts, 5, radius * 85, 7, "even")
    sums = sums.withColumn("_q55", C("_q55") + 1)  # the point itself, at the origin
    fit = _solve6(sums, "_p")
    p = [C("_p")[i] for i in range(3)]
    root = F.sqrt((2 * p[0] - 2 * p[1]) * (2 * p[0] - 2 * p[1]) + 4 * p[2] * p[2])
    return fit.select("point_id", *(F.when(C("valid"), (2 * p[0] + 2 * p[1] + s * root) / 2).alias(k)
                                    for k, s in (("k1", 1), ("k2", -1))))


def curvature_euler(edges: DataFrame, normal: tuple[str, ...] = ("cnx", "cny", "cnz")) -> DataFrame:
    """Principal curvatures fitted to the normal curvatures towards the neighbours (``point_id, k1 >= k2``).

    ``edges`` carry the centre's normal and the neighbour's normal (nx, ny, nz).  Normal curvatures are
    ``a cos^2 t + 2 b cos t sin t + c sin^2 t`` with t the angle to the horizontal tangent direction.
    """
    m = multiplicity(edges)
    flat = F.sqrt(C("dx") * C("dx") + C("dy") * C("dy"))
    local = edges.withColumn("_flat", flat).where(C("_flat") > 0)
    local = local.withColumn("_nxy", (C("dx") * C("nx") + C("dy") * C("ny")) / C("_flat"))
    local = local.withColumn("_kn", F.try_divide(-C("_nxy"), F.sqrt(C("_nxy") * C("_nxy") + C("nz") * C("nz")) * C("_flat")))
    slope = F.when(C(normal[0]) == 0, F.signum(C(normal[1])) * (math.pi / 2)).otherwise(F.atan(F.try_divide(normal[1], normal[0])))
    local = local.withColumn("_phi", slope)
    local = local.withColumn("_t", F.abs(F.atan2(F.cos("_phi"), -F.sin("_phi")) - F.atan2(C("dy"), C("dx"))))
    local = local.withColumns({"_a": F.cos("_t") * F.cos("_t"), "_b": 2 * F.cos("_t") * F.sin("_t"),
                               "_c": F.sin("_t") * F.sin("_t")}).where(C("_kn").isNotNull())
    terms = [C("_a"), C("_b"), C("_c")]
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    sums = local.groupBy(*joins.centre(local)).agg(*(F.sum(m * terms[i] * terms[j]).alias(f"_n{i}{j}") for i, j in pairs),
                                         *(F.sum(m * t * C("_kn")).alias(f"_r{i}") for i, t in enumerate(terms)))
    fit = linalg.with_solution3(sums, [C(f"_n{i}{j}") for i, j in pairs], [C(f"_r{i}") for i in range(3)], ["_p0", "_p1", "_p2"])
    root = F.sqrt((C("_p0") - C("_p2")) * (C("_p0") - C("_p2")) + 4 * C("_p1") * C("_p1"))
    return fit.select("point_id", ((C("_p0") + C("_p2") + root) / 2).alias("k1"), ((C("_p0") + C("_p2") - root) / 2).alias("k2"))


def _corners(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Corners of the convex hull, counter-clockwise from the leftmost (Andrew's chain); rows come sorted by x, then y."""
    def half(order: range) -> list[int]:
        chain: list[int] = []
        for i in order:
            while len(chain) > 1 and ((x[chain[-1]] - x[chain[-2]]) * (y[i] - y[chain[-2]]) - (y[chain[-1]] - y[chain[-2]]) * (x[i] - x[chain[-2]])) <= 0:
                chain.pop()
            chain.append(i)
        return chain[:-1]

    return half(range(len(x))) + half(range(len(x) - 1, -1, -1)) if len(x) > 1 else list(range(len(x)))


def _bend_sum(corners: np.ndarray, closed: bool) -> float:
    """A quarter of the sum of edge length times the angle between the triangles before and after the edge."""
    ring = np.vstack([corners, corners[:1]]) if closed else corners
    normals = np.cross(ring[:-1], ring[1:])
    size = np.linalg.norm(normals, axis=1)
    normals = np.divide(normals, size[:, None], out=np.zeros_like(normals), where=size[:, None] > 0)
    before, after, edges = (np.roll(normals, 1, axis=0), normals, corners) if closed else (normals[:-1], normals[1:], corners[1:-1])
    flat = (np.abs(before).sum(axis=1) == 0) | (np.abs(after).sum(axis=1) == 0)  # a triangle without area bends nothing
    angles = np.where(flat, 0.0, np.arccos(np.clip((before * after).sum(axis=1), -1, 1)))
    return float(0.25 * (np.linalg.norm(edges, axis=1) * angles).sum())


def curvature_external(edges: DataFrame) -> DataFrame:
    """Absolute curvature from the outer ring of the neighbourhood, the corners of its convex hull in XY: a quarter of the
    sum of edge length times the angle between the triangles on both sides of the edge.

    A centre that is a corner itself has an open ring.  NULL with fewer than three corners.  Hulls are merged: each batch
    of edges keeps its own corners before the shuffle, and the hull of those is that of all.
    """
    kind = {f.name: f.dataType.simpleString() for f in edges.schema}
    columns = ["point_id", "nid", *DELTA]
    schema = ", ".join(f"{c} {kind[c]}" for c in columns)

    def outer(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["point_id", "dx", "dy", "nid"]).drop_duplicates(["point_id", "dx", "dy"])
        kept = []
        x, y = frame["dx"].to_numpy(), frame["dy"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], frame["point_id"].to_numpy()[1:] != frame["point_id"].to_numpy()[:-1]))) if len(frame) else []
        for i, j in zip(starts, [*starts[1:], len(frame)]):
            kept += [i + c for c in _corners(x[i:j], y[i:j])]
        return frame.iloc[kept]

    def reduce(frames):
        for frame in frames:
            yield outer(frame)

    def measured(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray) -> float | None:
        new = np.concatenate(([True], (dx[1:] != dx[:-1]) | (dy[1:] != dy[:-1])))  # of places above one another the first
        xyz = np.vstack([np.stack([dx, dy, dz], axis=1)[new], np.zeros((1, 3))])
        xyz = xyz[np.lexsort((xyz[:, 1], xyz[:, 0]))]
        at = _corners(xyz[:, 0], xyz[:, 1])
        own = [k for k, i in enumerate(at) if not xyz[i, :2].any()]
        ring = at[own[0] + 1:] + at[:own[0]] if own else at
        return _bend_sum(xyz[ring], closed=not own) if len(at) >= 3 else None

    @F.pandas_udf("double")
    def measure(dx: pd.Series, dy: pd.Series, dz: pd.Series) -> pd.Series:
        return pd.Series([measured(*one) for one in zip(dx, dy, dz)], dtype="float64")

    flat = edges.where("dx <> 0 OR dy <> 0").select(*columns)
    ring = F.sort_array(F.collect_list(F.struct("dx", "dy", "nid", "dz")))  # corners of corners: few
    rings = flat.mapInPandas(reduce, schema).groupBy("point_id").agg(ring.alias("_ring"))
    return rings.select("point_id", measure(*(C(f"_ring.{c}") for c in DELTA)).alias("curvature"))


def zero_crossing(edges: DataFrame, curvature: str = "k", neighbor_curvature: str = "nk") -> DataFrame:
    """Points of positive curvature that touch a negative one: difference to the nearest negative neighbour.

    Works on the neighbourhood edges (which carry the curvature of both ends) instead of a local triangulation.
    """
    crossing = edges.where((C(curvature) > 0) & (C(neighbor_curvature) < 0))
    nearest = crossing.groupBy(*joins.centre(edges)).agg(F.min(F.struct("dist", "nid", C(curvature).alias("k"),
                                                              C(neighbor_curvature).alias("nk"))).alias("_b"))
    return nearest.select("point_id", C("_b.nid").alias("nid"), (C("_b.k") - C("_b.nk")).alias("difference"))
