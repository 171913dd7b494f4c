"""Normals, tensor shape and curvature."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudframe.functions import curvature, geometry, linalg, quantiles
from cloudframe.lineage import cut_lineage
from cloudframe.operators import features, joins, tensors
from cloudframe.plans import point_features
from cloudframe.queries import _data as d
from cloudframe.queries.neighbourhoods import EDGES, RADIUS, per_point, position_edges
from cloudframe.registry import Q, q, query
from cloudframe.skew import lookup

C = F.col
EIGEN = [d.TENSORS, d.eigen_sql(vectors=True)]
N3 = ("nx", "ny", "nz")


def rounded(names, digits=6):
    return [q(n, digits).alias(n) for n in names]


def rounded_sql(names, digits=6):
    return ", ".join(f"{Q(n, digits)} AS {n}" for n in names)


@query("normals_from_tensors", d.select_sql(EDGES + EIGEN, f"""
SELECT point_id, {Q('px', 4)} AS nx, {Q('py', 4)} AS ny, {Q('pz', 4)} AS nz FROM eig"""))
def normals_from_tensors(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, features.normals_from_tensors(tensors.tensor_from_neighbors(edges, points=places))).select(
        "point_id", *rounded(N3, 4))


@query("eigen3_vectors", d.select_sql(EDGES + EIGEN, f"""
SELECT point_id, {', '.join(f"{Q(c, 4)} AS {c}" for c in ('px', 'py', 'pz', 'sx', 'sy', 'sz'))} FROM eig"""))
def eigen3_vectors(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    axes = linalg.with_eigen(tensors.tensor_from_neighbors(edges, points=places)).select("point_id", "plate", "stick")
    return per_point(pts, places, axes).select(
        "point_id", *(q(C(a)[i], 4).alias(n + x) for a, n in (("plate", "p"), ("stick", "s")) for i, x in enumerate("xyz")))


PCA = [f"""pca AS (SELECT point_id, {', '.join(f'sum(d{a} * d{b} / (dist * dist)) AS c{a}{b}' for a, b in tensors.PAIRS)}
  FROM edges GROUP BY point_id HAVING count(*) >= 3)""", d.eigen_sql("pca", vectors=True)]


@query("normals_pca", d.select_sql(EDGES + PCA, f"""
, turned AS (SELECT pts.point_id, px, py, pz, CASE WHEN pz < 0 THEN -1 WHEN pz > 0 THEN 1
    WHEN px * (0 - x) + py * (0 - y) + pz * (30 - z) < 0 THEN -1 ELSE 1 END AS s FROM pts LEFT JOIN eig USING (point_id))
SELECT point_id, {Q('s * px', 4)} AS nx, {Q('s * py', 4)} AS ny, {Q('s * pz', 4)} AS nz FROM turned""".lstrip()))
def normals_pca(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, features.normals_pca(places, edges)).select("point_id", *rounded(N3, 4))


HYBRID = ["hybrid AS (SELECT point_id, " + ", ".join(
    f"sum(d{a} * d{b}) / (count(*) + 1) - sum(d{a}) / (count(*) + 1) * (sum(d{b}) / (count(*) + 1)) AS c{a}{b}"
    for a, b in tensors.PAIRS) + " FROM edges GROUP BY point_id HAVING count(*) >= 2)", d.eigen_sql("hybrid", vectors=True)]


@query("normals_hybrid", d.select_sql(EDGES + HYBRID, f"""
, turned AS (SELECT pts.point_id, px, py, pz, CASE WHEN -(px * x + py * y + pz * z) < 0 THEN -1 ELSE 1 END AS s
  FROM pts LEFT JOIN eig USING (point_id))
SELECT point_id, {Q('s * px', 4)} AS nx, {Q('s * py', 4)} AS ny, {Q('s * pz', 4)} AS nz FROM turned""".lstrip()))
def normals_hybrid(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, features.normals_hybrid(places, edges)).select("point_id", *rounded(N3, 4))


NEAREST = ["near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, nid) AS r FROM edges) WHERE r <= 12)",
           HYBRID[0].replace("FROM edges", "FROM near"), HYBRID[1]]


@query("normals_hybrid_radius_knn", d.select_sql(EDGES + NEAREST, f"""
, turned AS (SELECT pts.point_id, px, py, pz, CASE WHEN -(px * x + py * y + pz * z) < 0 THEN -1 ELSE 1 END AS s
  FROM pts LEFT JOIN eig USING (point_id))
SELECT point_id, {Q('s * px', 4)} AS nx, {Q('s * py', 4)} AS ny, {Q('s * pz', 4)} AS nz FROM turned""".lstrip()))
def normals_hybrid_radius_knn(spark, sf):
    """Normals over the true hybrid neighbourhood: the 12 nearest points, within the radius."""
    pts = d.points(spark, sf)
    places = cut_lineage(joins.positions(pts))
    normals = features.normals_hybrid(places, joins.place_knn(pts, places, 12, RADIUS))
    return per_point(pts, places, normals).select("point_id", *rounded(N3, 4))


# Search radius proportional to the range: 0.1 % per unit.
REACH = 30.0


def _range_edges(spark, sf, carry=("m",), **kw):
    pts = d.points(spark, sf)
    return pts, features.variable_radius_neighbors(joins.positions(pts), features.range_scaled_radius(REACH), carry, **kw)


RANGE_EDGES = ["reaching AS (SELECT *, (30.0::DOUBLE * 0.10::DOUBLE / 100) * sqrt(x * x + y * y + z * z) AS reach FROM pts)",
               """reach_l AS (SELECT *, floor(x / 2.4::DOUBLE)::INT + o AS cx, floor(y / 2.4::DOUBLE)::INT + p AS cy FROM reaching
  CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS p))""",
               "reach_r AS (SELECT *, floor(x / 2.4::DOUBLE)::INT AS cx, floor(y / 2.4::DOUBLE)::INT AS cy FROM pts)",
               """edges AS (SELECT * FROM (SELECT a.point_id, b.point_id AS nid, b.x - a.x AS dx, b.y - a.y AS dy,
    b.z - a.z AS dz, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS dist,
    a.reach FROM reach_l a JOIN reach_r b ON a.cx = b.cx AND a.cy = b.cy) WHERE dist > 0 AND dist <= reach)"""]


@query("normal_weighted", d.every(d.select_sql([d.PTS] + RANGE_EDGES + [
    "w AS (SELECT *, exp(-dist * dist / (2 * (reach / 3) * (reach / 3))) AS w FROM edges)",
    "cov AS (SELECT point_id, " + ", ".join(f"sum(w * d{a} * d{b}) / sum(w) AS c{a}{b}" for a, b in tensors.PAIRS)
    + " FROM w GROUP BY point_id HAVING count(*) > 4)", d.eigen_sql("cov", vectors=True)], f"""
SELECT point_id, {Q('px', 4)} AS nx, {Q('py', 4)} AS ny, {Q('pz', 4)} AS nz FROM eig"""), nx=None, ny=None, nz=None))
def normal_weighted(spark, sf):
    pts, edges = _range_edges(spark, sf)
    return joins.per_point(pts, features.normal_weighted(edges)).select("point_id", *rounded(N3, 4))


@query("dip_direction", d.select_sql(EDGES + EIGEN, f"""
SELECT point_id, {Q('asin(least(1.0::DOUBLE, sqrt(px * px + py * py) / sqrt(px * px + py * py + pz * pz)))', 4)} AS dip FROM eig"""))
def dip_direction(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    normals = features.normals_from_tensors(tensors.tensor_from_neighbors(edges, points=places))
    return per_point(pts, places, normals).select("point_id", q(features.dip_direction([C(n) for n in N3]), 4).alias("dip"))


SIDE_COV = lambda src, name, where: (f"{name} AS (SELECT " + ", ".join(
    f"covar_samp({a}, {b}) AS c{a}{b}" for a, b in tensors.PAIRS) + f" FROM {src} {where})")


@query("incidence_angle", d.select_sql(EDGES + EIGEN + [
    SIDE_COV("pts", "whole", ""), d.eigen_sql("whole", "we", vectors=True),
    "mid AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM pts)",
    """sided AS (SELECT pts.*, CASE WHEN (x - mx) * we.px + (y - my) * we.py + (z - mz) * we.pz >= 0 THEN 1 ELSE 0 END AS side
  FROM pts CROSS JOIN mid CROSS JOIN we)""",
    SIDE_COV("sided", "one", "WHERE side = 1"), d.eigen_sql("one", "e1", vectors=True),
    SIDE_COV("sided", "zero", "WHERE side = 0"), d.eigen_sql("zero", "e0", vectors=True),
    "axes AS (SELECT 1 AS side, px AS ax, py AS ay, pz AS az FROM e1 UNION ALL SELECT 0, px, py, pz FROM e0)",
    """turned AS (SELECT point_id, side, x, y, z, CASE WHEN px * ax + py * ay + pz * az < 0 THEN -1 ELSE 1 END AS s, px, py, pz
  FROM sided JOIN axes USING (side) JOIN eig USING (point_id))"""], f"""
SELECT point_id, side, {Q('''degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, s * (x * px + y * py + z * pz)
  / (sqrt(x * x + y * y + z * z) * sqrt(px * px + py * py + pz * pz))))))''', 3)} AS angle FROM turned"""))
def incidence_angle(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    normals = per_point(pts, places, features.normals_from_tensors(tensors.tensor_from_neighbors(edges, points=places)))
    return features.incidence_angles(pts, normals).select("point_id", "side", q("angle", 3).alias("angle"))


@query("tensor_shape", d.select_sql(EDGES + [d.TENSORS, d.eigen_sql()], f"""
SELECT point_id, {Q('l3 / (l1 + l2 + l3)', 5)} AS p1, {Q('l2 / (l1 + l2 + l3)', 5)} AS p2, {Q('l1 / (l1 + l2 + l3)', 5)} AS p3,
  {Q('(sqrt(l3) - sqrt(l2)) / sqrt(l3)', 5)} AS a1d, {Q('(sqrt(l2) - sqrt(l1)) / sqrt(l3)', 4)} AS a2d,
  {Q('sqrt(l1) / sqrt(l3)', 4)} AS a3d,
  CASE WHEN l3 < 10 * l2 AND l3 < 10 * l1 THEN 'point' WHEN l3 / (l1 + l2 + l3) > 0.6 THEN 'line' ELSE 'plane' END AS shape
FROM eig"""))
def tensor_shape(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    shaped = features.tensor_shape(linalg.eigenvalues(tensors.tensor_from_neighbors(edges, points=places)))
    return per_point(pts, places, shaped).select(
        "point_id", *rounded(("p1", "p2", "p3", "a1d"), 5), *rounded(("a2d", "a3d"), 4), "shape")


CLOUD_TENSOR = ["t AS (SELECT cloud_id, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz, " + ", ".join(
    f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts GROUP BY 1)", d.eigen_sql("t", vectors=True)]
DELTA_SQL = "delta AS (SELECT point_id, x - gx AS ux, y - gy AS uy, z - gz AS uz, px, py, pz, sx, sy, sz FROM pts JOIN eig USING (cloud_id))"


@query("distance_to_tensor", d.select_sql([d.PTS] + CLOUD_TENSOR + [DELTA_SQL, """dist AS (SELECT point_id,
  abs(ux * px + uy * py + uz * pz) AS plate, sqrt(ux * ux + uy * uy + uz * uz) AS ball,
  sqrt((sy * uz - sz * uy) ** 2 + (sz * ux - sx * uz) ** 2 + (sx * uy - sy * ux) ** 2) AS stick,
  ux * px + uy * py + uz * pz AS signed FROM delta)"""], f"""
SELECT point_id, {Q('plate', 4)} AS plate, {Q('stick', 4)} AS stick, {Q('ball', 4)} AS ball,
  {Q('least(plate, stick, ball)', 4)} AS nearest, {Q('signed', 4)} AS signed FROM dist"""))
def distance_to_tensor(spark, sf):
    pts = d.points(spark, sf)
    tensor = linalg.with_eigen(tensors.moments(pts, ["cloud_id"])).select("cloud_id", "cx", "cy", "cz", "plate", "stick")
    joined = lookup(pts, tensor, ["cloud_id"])
    delta = [C(a) - C(f"c{a}") for a in "xyz"]
    plate, stick = linalg.vector("plate"), linalg.vector("stick")
    return joined.select("point_id", *(q(features.distance_to_tensor(delta, plate, stick, kind), 4).alias(name) for kind, name in (
        ("plate", "plate"), ("stick", "stick"), ("ball", "ball"), ("all", "nearest"))),
        q(features.distance_to_tensor(delta, plate, stick, "plate", signed=True), 4).alias("signed"))


ANGLE = """angles AS (SELECT point_id, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END AS a FROM (
  SELECT point_id, CASE WHEN abs(dx) > 1e-6 THEN atan2(dy, dx) WHEN dy > 0 THEN pi() / 2
    WHEN dy < 0 THEN 3 * pi() / 2 ELSE 0 END AS a FROM edges))"""


def _sectors(reference: bool, least: float) -> str:
    parts = []
    for i in range(8):
        if reference:
            start = 1.5 * math.pi * i / 7
            test, extra = f"a >= {start!r}::DOUBLE AND a <= {start + math.pi / 4!r}::DOUBLE", 1 if i == 0 else 0
        else:
            start = math.pi / 4 * i
            test, extra = f"a > {start!r}::DOUBLE AND a <= {start + math.pi / 4!r}::DOUBLE", 0
        parts.append(f"CASE WHEN count(*) FILTER (WHERE {test}) + {extra} >= {least} THEN 1 ELSE 0 END")
    return f"""sectors AS (SELECT point_id, count(*) AS n, ({' + '.join(parts)})::INT AS sectors FROM angles GROUP BY 1)"""


@query("neighborhood_valid", d.every(d.select_sql(EDGES + [ANGLE, _sectors(True, 2)], """
SELECT point_id, n, sectors, n >= 6 AND sectors >= 7 AS valid FROM sectors"""), n=0, sectors=0, valid="false"))
def neighborhood_valid(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, features.neighborhood_valid(edges, points=places))


@query("neighborhood_valid_even", d.every(d.select_sql(EDGES + [ANGLE, _sectors(False, 1)], """
SELECT point_id, n, sectors, n >= 6 AND sectors >= 5 AS valid FROM sectors"""), n=0, sectors=0, valid="false"))
def neighborhood_valid_even(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, features.neighborhood_valid(edges, 5, 1, 5, 8, "even", points=places))


EPSILON = quantiles.normal_quantile(0.975) * 0.01


@query("umbrella_curvature", d.every(d.select_sql(EDGES + EIGEN + [ANGLE, _sectors(True, 2),
    f"""mean AS (SELECT point_id, (sum(dx) * any_value(px) + sum(dy) * any_value(py) + sum(dz) * any_value(pz)) / count(*) AS k
  FROM edges JOIN eig USING (point_id) GROUP BY point_id)"""], f"""
SELECT point_id, {Q(f'''CASE WHEN NOT (sectors.n >= 6 AND sectors >= 7) THEN NULL WHEN abs(k) < {EPSILON!r}::DOUBLE THEN 0
  ELSE k END''', 4)} AS umbrella FROM mean JOIN sectors USING (point_id)"""), umbrella=None))
def umbrella_curvature(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    values = features.umbrella_from_neighbors(places, edges)
    return per_point(pts, places, values).select("point_id", q("umbrella", 4).alias("umbrella"))


F_TABLE = "f_limit AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {quantiles.f_quantile(0.05, 3, n)!r}::DOUBLE)" for n in range(2, 301)) + ") v(n, f_limit))"


@query("curvature_biquadratic", d.every(d.select_sql(EDGES + EIGEN + [F_TABLE, """framed AS (SELECT point_id, dx, dy, dz, px, py, pz,
    CASE WHEN pz < -1 + 1e-12 THEN 0 ELSE 1 / (1 + pz) END AS h FROM edges JOIN eig USING (point_id))""",
    """turned AS (SELECT point_id, dx - px * (h * (px * dx + py * dy) + dz) AS x, dy - py * (h * (px * dx + py * dy) + dz) AS y,
    px * dx + py * dy + pz * dz AS z FROM framed)""",
    """sums AS (SELECT point_id, count(*) + 1 AS n, sum(z * z) AS zz, sum(x**4) AS a, sum(x*x*y*y) AS b, sum(x**3*y) AS c,
    sum(y**4) AS d, sum(x*y**3) AS e, sum(x*x*z) AS u, sum(y*y*z) AS v, sum(x*y*z) AS w FROM turned GROUP BY 1)""",
    """dets AS (SELECT *, a * (d * b - e * e) + b * (c * e - b * b) + c * (b * e - c * d) AS det0 FROM sums)""",
    """fit AS (SELECT *, CASE WHEN abs(det0) > 1e-12 * abs(a * d * b) THEN det0 END AS det FROM dets)""",
    """sol AS (SELECT point_id, n, zz, u, v, w, ((d*b - e*e) * u + (c*e - b*b) * v + (b*e - c*d) * w) / det AS p,
    ((c*e - b*b) * u + (a*b - c*c) * v + (b*c - a*e) * w) / det AS q,
    ((b*e - c*d) * u + (b*c - a*e) * v + (a*d - b*b) * w) / det AS r FROM fit)""",
    """tested AS (SELECT point_id, CASE WHEN p IS NULL THEN NULL WHEN (p*u + q*v + r*w) > f_limit * sol.n
      * (greatest(0, zz - (p*u + q*v + r*w)) / CASE WHEN sol.n > 3 THEN sol.n - 3 END) THEN 1 ELSE 0 END AS s, p, q, r
      FROM sol JOIN f_limit USING (n))""",
    """kk AS (SELECT point_id, s * (p + q) + sqrt(4*s*r*r + 4*s*(p-q)*(p-q)) / 2 AS k1,
      s * (p + q) - sqrt(4*s*r*r + 4*s*(p-q)*(p-q)) / 2 AS k2 FROM tested)"""], f"""
SELECT point_id, {Q('CASE WHEN abs(k1 * k2) <= 1000 THEN k1 END', 3)} AS k1,
  {Q('CASE WHEN abs(k1 * k2) <= 1000 THEN k2 END', 3)} AS k2 FROM kk"""), k1=None, k2=None))
def curvature_biquadratic(spark, sf):
    pts = d.points(spark, sf)
    places = point_features.with_normals(joins.positions(pts), RADIUS)
    edges = point_features.edges_with_normals(places, RADIUS)
    return per_point(pts, places, features.curvature_biquadratic(edges)).select("point_id", *rounded(("k1", "k2"), 3))


@query("curvature_fundamental_form")
def curvature_fundamental_form(spark, sf):
    pts = d.points(spark, sf)
    places = point_features.with_normals(joins.positions(pts), RADIUS)
    edges = point_features.edges_with_normals(places, RADIUS)
    return per_point(pts, places, features.curvature_fundamental_form(edges, radius=0.01))


@query("curvature_euler", d.every(d.select_sql(EDGES + EIGEN + [
    "nrm AS (SELECT point_id, px, py, pz FROM eig)",
    """e1 AS (SELECT edges.point_id, dx, dy, sqrt(dx*dx + dy*dy) AS f, a.px AS ax, a.py AS ay, b.px AS nx, b.py AS ny, b.pz AS nz
  FROM edges JOIN nrm a ON a.point_id = edges.point_id JOIN nrm b ON b.point_id = edges.nid WHERE dx <> 0 OR dy <> 0)""",
    """e2 AS (SELECT *, (dx * nx + dy * ny) / f AS nxy, CASE WHEN ax = 0 THEN sign(ay) * pi() / 2 ELSE atan(ay / ax) END AS phi FROM e1)""",
    """e3 AS (SELECT point_id, -nxy / nullif(sqrt(nxy * nxy + nz * nz) * f, 0) AS kn,
  abs(atan2(cos(phi), -sin(phi)) - atan2(dy, dx)) AS t FROM e2)""",
    """e4 AS (SELECT point_id, kn, cos(t) * cos(t) AS a, 2 * cos(t) * sin(t) AS b, sin(t) * sin(t) AS c FROM e3 WHERE kn IS NOT NULL)""",
    """s AS (SELECT point_id, sum(a*a) AS m0, sum(a*b) AS m1, sum(a*c) AS m2, sum(b*b) AS m3, sum(b*c) AS m4, sum(c*c) AS m5,
  sum(a*kn) AS u, sum(b*kn) AS v, sum(c*kn) AS w FROM e4 GROUP BY 1)""",
    "g AS (SELECT *, m0*(m3*m5 - m4*m4) + m1*(m2*m4 - m1*m5) + m2*(m1*m4 - m2*m3) AS det0 FROM s)",
    "h AS (SELECT *, CASE WHEN abs(det0) > 1e-12 * abs(m0*m3*m5) THEN det0 END AS det FROM g)",
    """sol AS (SELECT point_id, ((m3*m5 - m4*m4)*u + (m2*m4 - m1*m5)*v + (m1*m4 - m2*m3)*w) / det AS p,
  ((m2*m4 - m1*m5)*u + (m0*m5 - m2*m2)*v + (m1*m2 - m0*m4)*w) / det AS q,
  ((m1*m4 - m2*m3)*u + (m1*m2 - m0*m4)*v + (m0*m3 - m1*m1)*w) / det AS r FROM h)"""], f"""
SELECT point_id, {Q('k1 / (1 + abs(k1))', 4)} AS k1_bounded, {Q('k2 / (1 + abs(k2))', 4)} AS k2_bounded FROM (
  SELECT point_id, (p + r + sqrt((p - r) * (p - r) + 4 * q * q)) / 2 AS k1, (p + r - sqrt((p - r) * (p - r) + 4 * q * q)) / 2 AS k2 FROM sol)"""), k1_bounded=None, k2_bounded=None))
def curvature_euler(spark, sf):
    """Curvatures as k / (1 + |k|): an ill-conditioned fit can be very large, where rounding to fixed decimals is noise."""
    pts = d.points(spark, sf)
    places = point_features.with_normals(joins.positions(pts), RADIUS)
    edges = point_features.edges_with_normals(places, RADIUS)
    return per_point(pts, places, features.curvature_euler(edges)).select(
        "point_id", *(q(C(k) / (1 + F.abs(k)), 4).alias(f"{k}_bounded") for k in ("k1", "k2")))


@query("curvature_external")
def curvature_external(spark, sf):
    pts, edges = _range_edges(spark, sf)
    return joins.per_point(pts, features.curvature_external(edges))


@query("zero_crossing", d.select_sql(EDGES + ["v AS (SELECT point_id, y - 26.0::DOUBLE AS k FROM pts)",
    """c AS (SELECT edges.point_id, nid, dist, a.k AS k, b.k AS nk FROM edges JOIN v a ON a.point_id = edges.point_id
  JOIN v b ON b.point_id = edges.nid WHERE a.k > 0 AND b.k < 0)"""], f"""
SELECT point_id, nid, {Q('k - nk')} AS difference FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, nid) AS r FROM c) WHERE r = 1"""))
def zero_crossing(spark, sf):
    pts = d.points(spark, sf)
    places = cut_lineage(joins.positions(pts).withColumns({"k": C("y") - 26.0, "nk": C("y") - 26.0}))
    edges = joins.radius_neighbors(places, RADIUS, carry=("nk",), carry_left=("k",), home=True)
    # The curvature depends on the place alone, and of equally near copies the smallest id counts: the place's.
    return per_point(pts, places, features.zero_crossing(edges)).where("nid IS NOT NULL").select(
        "point_id", "nid", q("difference").alias("difference"))


# --- measures of principal curvatures (here: two bounded measures of every lineitem, ordered) -----------------------------

KK = """kk AS (SELECT point_id, greatest(y / 25.0::DOUBLE - 1.0::DOUBLE, intensity * 20.0::DOUBLE - 0.8::DOUBLE) AS k1,
  least(y / 25.0::DOUBLE - 1.0::DOUBLE, intensity * 20.0::DOUBLE - 0.8::DOUBLE) AS k2 FROM pts)"""


def _kk(spark, sf):
    a, b = C("y") / 25.0 - 1.0, C("intensity") * 20.0 - 0.8
    return d.points(spark, sf).select("point_id", F.greatest(a, b).alias("k1"), F.least(a, b).alias("k2"))


@query("curvature_measures", d.select_sql([d.PTS, KK], f"""
SELECT point_id, {Q('(k1 + k2) / 2')} AS mean_k, {Q('k1 * k2')} AS gaussian_k, {Q('sqrt((k1 * k1 + k2 * k2) / 2)')} AS curvedness,
  {Q('CASE WHEN abs(k1 - k2) >= 1e-6 THEN atan2(k2 + k1, k2 - k1) / pi() ELSE 0 END')} AS shape_index FROM kk"""))
def curvature_measures(spark, sf):
    k = C("k1"), C("k2")
    return _kk(spark, sf).select("point_id", q(curvature.mean_k(*k)).alias("mean_k"), q(curvature.gaussian_k(*k)).alias("gaussian_k"),
                                 q(curvature.curvedness(*k)).alias("curvedness"), q(curvature.shape_index(*k)).alias("shape_index"))


@query("similarity_curvature", d.select_sql([d.PTS, KK, """r AS (SELECT *, least(abs(k1), abs(k2)) / nullif(greatest(abs(k1), abs(k2)), 0) AS t,
  sign(k1) + sign(k2) AS s FROM kk)"""], f"""
SELECT point_id, {Q('CASE s WHEN 2 THEN t WHEN -2 THEN -t ELSE 0 END')} AS e,
  {Q('CASE WHEN s = 0 AND t IS NOT NULL THEN CASE WHEN abs(k1) >= abs(k2) THEN t ELSE -t END ELSE 0 END')} AS h,
  {Q('CASE WHEN s = 2 OR (s = 0 AND t IS NOT NULL AND abs(k1) >= abs(k2)) THEN t ELSE 0 END')} AS r,
  {Q('CASE WHEN s = -2 OR (s = 0 AND t IS NOT NULL AND abs(k1) >= abs(k2)) THEN t ELSE 0 END')} AS g,
  {Q('CASE WHEN s = 0 AND t IS NOT NULL AND abs(k1) < abs(k2) THEN t ELSE 0 END')} AS b FROM r"""))
def similarity_curvature(spark, sf):
    values = curvature.similarity_curvature(C("k1"), C("k2"))
    return _kk(spark, sf).select("point_id", *(q(v).alias(n) for n, v in values.items()))


@query("normalize_curvature", d.select_sql([d.PTS, KK, """s AS (SELECT avg(k1) AS a, stddev_pop(k1) AS s FROM kk)""",
    "c AS (SELECT point_id, CASE WHEN abs(k1 - a) <= 3 * s THEN k1 END AS k FROM kk CROSS JOIN s)",
    "l AS (SELECT min(k) AS lo, max(k) AS hi FROM c)"], f"""
SELECT point_id, {Q('CASE WHEN k IS NULL THEN 1.5 ELSE 2 * (k - lo) / (hi - lo) - 1 END')} AS k1 FROM c CROSS JOIN l"""))
def normalize_curvature(spark, sf):
    return curvature.normalize_curvature(_kk(spark, sf), "k1", "scaled").select("point_id", q("scaled").alias("k1"))


Z975 = quantiles.normal_quantile(0.975)


@query("significance_zero", d.select_sql([d.PTS, KK], f"""
SELECT point_id, {Q(f'CASE WHEN abs((k1 - 0.1::DOUBLE) / 0.2::DOUBLE) < {Z975!r}::DOUBLE THEN 0 ELSE k1 END')} AS k1,
  {Q(f'CASE WHEN abs((k2 - 0.1::DOUBLE) / 0.2::DOUBLE) < {Z975!r}::DOUBLE OR k2 > 0 THEN 0 ELSE k2 END')} AS k2 FROM kk"""))
def significance_zero(spark, sf):
    z = curvature.significance_zero
    return _kk(spark, sf).select("point_id", q(z(C("k1"), 0.1, 0.2)).alias("k1"), q(z(C("k2"), 0.1, 0.2, posonly=True)).alias("k2"))


@query("downsampled_umbrella_curvature", d.select_sql([d.PTS,
    "ext AS (SELECT min(x) AS x0, min(y) AS y0 FROM pts)",
    "cells AS (SELECT point_id, x, y, z, floor((x - x0) / 1.5::DOUBLE)::BIGINT || '_' || floor((y - y0) / 1.5::DOUBLE)::BIGINT AS v FROM pts CROSS JOIN ext)",
    "cog AS (SELECT v AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cells GROUP BY v)",
    d.edges_sql(3.0, "cog"), d.tensors_sql("cog"), d.eigen_sql(vectors=True), ANGLE, _sectors(True, 2),
    f"""mean AS (SELECT point_id, (sum(dx) * any_value(px) + sum(dy) * any_value(py) + sum(dz) * any_value(pz)) / count(*) AS k
  FROM edges JOIN eig USING (point_id) GROUP BY point_id)""",
    f"""val AS (SELECT point_id AS v, CASE WHEN NOT (sectors.n >= 6 AND sectors >= 7) OR abs(k) < {EPSILON!r}::DOUBLE THEN 0 ELSE k END AS k
  FROM mean JOIN sectors USING (point_id))"""], f"""
SELECT point_id, {Q('coalesce(k, 0)', 4)} AS umbrella FROM cells LEFT JOIN val USING (v)"""))
def downsampled_umbrella_curvature(spark, sf):
    return point_features.downsampled_umbrella_curvature(d.points(spark, sf), 1.5, 3.0).select(
        "point_id", q("umbrella", 4).alias("umbrella"))
