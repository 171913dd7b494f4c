"""Weights, smoothing, saliency and descriptors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudframe.functions import quantiles, weights
from cloudframe.lineage import cut_lineage
from cloudframe.operators import distinctness, joins, resolution, saliency, smoothing, tensors
from cloudframe.plans import cell_curvature, point_features
from cloudframe.queries import _data as d
from cloudframe.queries.features import EIGEN
from cloudframe.queries.neighbourhoods import EDGES, RADIUS, per_point, position_edges
from cloudframe.registry import Q, q, query

C = F.col


@query("neighbor_weights", d.select_sql([d.PTS, d.edges_sql(0.5)], f"""
SELECT point_id, nid, {Q('CASE WHEN dist > 0.4 THEN 0 WHEN dist > 0.2 THEN 2 - dist / 0.2::DOUBLE ELSE dist / 0.2::DOUBLE END')} AS triangle,
  {Q('exp(-((sqrt(dx*dx + dy*dy) - 0.2) ** 2) / (2 * 0.1 * 0.1)) / (sqrt(2 * pi()) * 0.1)', 5)} AS ring,
  {Q('greatest(0, exp(-dist * dist / 2) / sqrt(2 * pi()) - exp(-dist * dist / (2 * 4)) / (sqrt(2 * pi()) * 2))')} AS laplacian FROM edges"""))
def neighbor_weights(spark, sf):
    flat = F.sqrt(C("dx") * C("dx") + C("dy") * C("dy"))
    return joins.radius_neighbors(d.points(spark, sf), 0.5).select(
        "point_id", "nid", q(weights.weight_triangle(C("dist"), 0.4)).alias("triangle"),
        q(weights.weight_gaussian_ring(flat, 0.1, 0.2), 5).alias("ring"), q(weights.weight_laplacian(C("dist"), 2.0)).alias("laplacian"))


@query("neighbor_direction", d.select_sql([d.PTS, d.edges_sql(0.5)], f"""
SELECT point_id, nid, {Q('dx / dist')} AS ux, {Q('dy / dist')} AS uy, {Q('dz / dist')} AS uz FROM edges"""))
def neighbor_direction(spark, sf):
    return joins.radius_neighbors(d.points(spark, sf), 0.5).select(
        "point_id", "nid", *(q(C(f"d{a}") / C("dist")).alias(f"u{a}") for a in "xyz"))


@query("smooth_mean_position", d.select_sql(EDGES + [
    "s AS (SELECT point_id, count(*) + 1 AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz FROM edges GROUP BY 1)"], f"""
SELECT point_id, {', '.join(f"{Q(f'{a} + coalesce(s{a} / n, 0)', 5)} AS {a}" for a in 'xyz')} FROM pts LEFT JOIN s USING (point_id)"""))
def smooth_mean_position(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    moved = smoothing.smooth_mean_position(places, edges)
    return per_point(pts, places, moved.select("point_id", *(C(a).alias(f"s{a}") for a in "xyz"))).select(
        "point_id", *(q(f"s{a}", 5).alias(a) for a in "xyz"))


BOTH = ["v AS (SELECT point_id, point_id AS nid FROM pts UNION ALL SELECT point_id, nid FROM edges)",
        "n AS (SELECT v.point_id, intensity FROM v JOIN pts ON pts.point_id = v.nid)"]


@query("smooth_property_mean", d.select_sql([d.PTS, d.edges_sql(0.5)] + BOTH, f"""
SELECT point_id, {Q('avg(intensity)')} AS intensity FROM n GROUP BY point_id"""))
def smooth_property_mean(spark, sf):
    pts = d.points(spark, sf)
    return smoothing.smooth_property(pts, joins.radius_neighbors(pts, 0.5), "intensity").select(
        "point_id", q("intensity").alias("intensity"))


@query("smooth_property_median", d.select_sql([d.PTS, d.edges_sql(0.5)] + BOTH, f"""
SELECT point_id, {Q('quantile_cont(intensity, 0.5)')} AS intensity FROM n GROUP BY point_id"""))
def smooth_property_median(spark, sf):
    pts = d.points(spark, sf)
    return smoothing.smooth_property(pts, joins.radius_neighbors(pts, 0.5), "intensity", smoothing.neighborhood_median).select(
        "point_id", q("intensity").alias("intensity"))


# --- directional saliency ----------------------------------------------------------------------------------------------

SIGMA, RHO = 0.4, 0.6
CENTRE = math.exp(-RHO * RHO / (2 * SIGMA * SIGMA)) / (math.sqrt(2 * math.pi) * SIGMA)
CHI = "chi AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {quantiles.chi2_quantile(0.05, n)!r}::DOUBLE)" for n in range(1, 301)) + ") v(active, lim))"


def _described(spark, sf):
    pts = d.points(spark, sf)
    places = point_features.with_normals(joins.positions(pts), RADIUS).withColumn("k", C("y") / 10.0)
    edges = point_features.edges_with_normals(places, RADIUS, extra=("k",))
    return pts, places, edges


@query("directional_saliency", d.select_sql(EDGES + EIGEN + [
    "nrm AS (SELECT point_id, px, py, pz, y / 10.0::DOUBLE AS k FROM eig JOIN pts USING (point_id))",
    f"""e AS (SELECT edges.point_id, 1 - (a.px*b.px + a.py*b.py + a.pz*b.pz) AS dn, b.k - a.k AS dk,
  exp(-((sqrt(dx*dx + dy*dy) - {RHO}) ** 2) / (2 * {SIGMA} * {SIGMA})) / (sqrt(2 * pi()) * {SIGMA}) AS w
  FROM edges JOIN nrm a ON a.point_id = edges.point_id JOIN nrm b ON b.point_id = edges.nid)""", CHI,
    f"""s AS (SELECT point_id, count(*) AS n, (count(*) FILTER (WHERE w > 0.01) + {int(CENTRE > 0.01)})::INT AS active,
  count(*) FILTER (WHERE w > 0.01 AND abs(dn) < 0.016) AS zn, count(*) FILTER (WHERE w > 0.01 AND abs(dk) <= 0.04) AS zk,
  sum(abs(dn) * w) / sum(w) AS mn, abs(sum(dk * w)) / sum(w) AS mk, stddev_pop(dn) AS sn, stddev_pop(dk) AS sk FROM e GROUP BY 1)""",
    """r AS (SELECT point_id, CASE WHEN n IS NULL OR n < 4 OR zn > 0.6 * active OR (n - 1) * sn / 0.01 < lim THEN 0 ELSE coalesce(mn, 0) END AS dn,
  CASE WHEN n IS NULL OR n < 4 OR zk > 0.6 * active OR (n - 1) * sk / 0.1 < lim THEN 0 ELSE coalesce(mk, 0) END AS dk
  FROM pts LEFT JOIN s USING (point_id) LEFT JOIN chi USING (active))""",
    "x AS (SELECT min(dn) AS a, max(dn) AS b, min(dk) AS c, max(dk) AS d FROM r)",
    "z AS (SELECT point_id, (dn - a) / (b - a) AS dn, (dk - c) / (d - c) AS dk FROM r CROSS JOIN x)"], f"""
SELECT point_id, {Q('0.5 * dn + 0.5 * dk', 4)} AS saliency, {Q('dn', 4)} AS dn, {Q('dk', 4)} AS dk FROM z"""))
def directional_saliency(spark, sf):
    pts, places, edges = _described(spark, sf)
    flat = F.sqrt(C("dx") * C("dx") + C("dy") * C("dy"))
    values = saliency.directional_saliency(edges, weights.weight_gaussian_ring(flat, SIGMA, RHO), CENTRE, points=places)
    return per_point(pts, places, values).select("point_id", *(q(c, 4).alias(c) for c in ("saliency", "dn", "dk")))


SMALLEST, REACH, PER_LEVEL = 2.0, 1.6, 3


def _level_sql(level: int) -> list[str]:
    """Directional saliency of the nodes of one level of cells, straight from the points."""
    n, side = f"v{level}", SMALLEST * 2 ** level
    cell = {c: f"(floor(({a} - lo{a}) / {SMALLEST}::DOUBLE)::BIGINT >> {level})" for c, a in zip("ijk", "xyz")}
    w = f"exp(-((dist / {side}::DOUBLE - {RHO}) ** 2) / (2 * {SIGMA} * {SIGMA})) / (sqrt(2 * pi()) * {SIGMA})"
    return [f"{n}_t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in cell.items()) + f""", concat_ws('_', {', '.join(cell.values())}) AS point_id,
  avg(x) AS x, avg(y) AS y, avg(z) AS z, """ + ", ".join(f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts, low GROUP BY ALL)",
            d.eigen_sql(f"{n}_t", f"{n}_g", vectors=True),
            f"{n}_p AS (SELECT point_id, i, j, k, x, y, z, px, py, pz, coalesce(l1 / nullif(l1 + l2 + l3, 0), 0) AS kk FROM {n}_g)",
            d.edges_sql(REACH * side, f"{n}_p", f"{n}_d"),
            f"""{n}_e AS (SELECT {n}_d.point_id, 1 - (a.px*b.px + a.py*b.py + a.pz*b.pz) AS dn, b.kk - a.kk AS dk, {w} AS w
  FROM {n}_d JOIN {n}_p a ON a.point_id = {n}_d.point_id JOIN {n}_p b ON b.point_id = {n}_d.nid)""",
            f"""{n}_s AS (SELECT point_id, count(*) AS n, (count(*) FILTER (WHERE w > 0.01) + {int(CENTRE > 0.01)})::INT AS active,
  count(*) FILTER (WHERE w > 0.01 AND abs(dn) < 0.016) AS zn, count(*) FILTER (WHERE w > 0.01 AND abs(dk) <= 0.04) AS zk,
  sum(abs(dn) * w) / sum(w) AS mn, abs(sum(dk * w)) / sum(w) AS mk, stddev_pop(dn) AS sn, stddev_pop(dk) AS sk FROM {n}_e GROUP BY 1)""",
            f"""{n}_r AS (SELECT point_id, i, j, k, CASE WHEN n IS NULL OR n < 4 OR zn > 0.6 * active OR (n - 1) * sn / 0.01 < lim THEN 0 ELSE coalesce(mn, 0) END AS dn,
  CASE WHEN n IS NULL OR n < 4 OR zk > 0.6 * active OR (n - 1) * sk / 0.1 < lim THEN 0 ELSE coalesce(mk, 0) END AS dk
  FROM {n}_p LEFT JOIN {n}_s USING (point_id) LEFT JOIN chi USING (active))""",
            f"{n}_x AS (SELECT min(dn) AS a, max(dn) AS b, min(dk) AS c, max(dk) AS d FROM {n}_r)",
            f"""{n} AS (SELECT i, j, k, 0.5 * (CASE WHEN a = 0 AND b = 0 THEN 0 ELSE (dn - a) / (b - a) END)
  + 0.5 * (CASE WHEN c = 0 AND d = 0 THEN 0 ELSE (dk - c) / (d - c) END) AS s FROM {n}_r, {n}_x)"""]


@query("multi_resolution_saliency", d.select_sql(
    [d.PTS, CHI, "low AS (SELECT min(x) AS lox, min(y) AS loy, min(z) AS loz FROM pts)"] + [c for level in range(PER_LEVEL) for c in _level_sql(level)]
    + ["spot AS (SELECT point_id, " + ", ".join(f"floor(({a} - lo{a}) / {SMALLEST}::DOUBLE)::BIGINT AS {c}" for c, a in zip("ijk", "xyz")) + " FROM pts, low)"],
    f"SELECT spot.point_id, {Q('(v0.s + v1.s + v2.s) / 3', 4)} AS saliency, " + ", ".join(f"{Q(f'v{level}.s', 4)} AS saliency_{level}" for level in range(PER_LEVEL))
    + " FROM spot " + " ".join(f"JOIN v{level} ON " + " AND ".join(f"v{level}.{c} = spot.{c} >> {level}" for c in "ijk") for level in range(PER_LEVEL))))
def multi_resolution_saliency(spark, sf):
    found = resolution.multi_resolution_saliency(d.points(spark, sf), SMALLEST, PER_LEVEL, neighbors=REACH, ring=(SIGMA, RHO))
    return found.select("point_id", q("saliency", 4).alias("saliency"), *(q(C("saliencies")[i], 4).alias(f"saliency_{i}") for i in range(PER_LEVEL)))


@query("pointwise_pca_saliency")
def pointwise_pca_saliency(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, saliency.pointwise_pca_saliency(tensors.tensor_from_neighbors(edges, points=places)))


SCORES = "kk AS (SELECT point_id, x * y AS saliency FROM pts)"


def _scores(spark, sf):
    return d.points(spark, sf).select("point_id", (C("x") * C("y")).alias("saliency"))


@query("percentile_gate", d.select_sql([d.PTS, SCORES, "p AS (SELECT quantile_cont(saliency, 0.75) AS p FROM kk)"], f"""
SELECT point_id, {Q('CASE WHEN saliency < p THEN 0 ELSE saliency END')} AS saliency FROM kk CROSS JOIN p"""))
def percentile_gate(spark, sf):
    return saliency.percentile_gate(_scores(spark, sf), "saliency", 0.75, "saliency").select("point_id", q("saliency").alias("saliency"))


@query("multiscale_saliency", d.select_sql([d.PTS, SCORES, "k2 AS (SELECT point_id, y AS saliency FROM pts)",
    "p AS (SELECT (SELECT quantile_cont(saliency, 0.75) FROM kk) AS p, (SELECT quantile_cont(saliency, 0.5) FROM k2) AS r)",
    "g AS (SELECT point_id, CASE WHEN kk.saliency < p THEN 0 ELSE kk.saliency END AS a, CASE WHEN k2.saliency < r THEN 0 ELSE k2.saliency END AS b FROM kk JOIN k2 USING (point_id) CROSS JOIN p)",
    "m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM g)"], f"""
SELECT point_id, {Q('(a - a0) / (a1 - a0 + 2.220446049250313e-16) + (b - b0) / (b1 - b0 + 2.220446049250313e-16)')} AS saliency FROM g CROSS JOIN m"""))
def multiscale_saliency(spark, sf):
    second = d.points(spark, sf).select("point_id", C("y").alias("saliency"))
    return saliency.multiscale_saliency([_scores(spark, sf), second], [0.75, 0.5]).select("point_id", q("saliency").alias("saliency"))


@query("saliency_value_scaling", d.select_sql([d.PTS, SCORES, "s AS (SELECT avg(saliency) AS a, stddev_pop(saliency) AS s FROM kk)"], f"""
SELECT point_id, {Q('CASE WHEN greatest(a - 3 * s, least(a + 3 * s, saliency)) > 0 THEN ln(greatest(a - 3 * s, least(a + 3 * s, saliency))) END')} AS value FROM kk CROSS JOIN s"""))
def saliency_value_scaling(spark, sf):
    return saliency.saliency_value_scaling(_scores(spark, sf), "saliency", "value").select("point_id", q("value").alias("value"))


@query("scale_values", d.select_sql([d.PTS, SCORES, "s AS (SELECT min(saliency) AS a, max(saliency) AS b FROM kk)"], f"""
SELECT point_id, {Q('3 * (saliency - a) / (b - a) - 1')} AS value, {Q('(saliency - a) / (b - a)')} AS image FROM kk CROSS JOIN s"""))
def scale_values(spark, sf):
    scaled = saliency.scale_values(_scores(spark, sf), "saliency", "value", -1.0, 2.0)
    return saliency.im2double(scaled, "saliency", "image").select("point_id", q("value").alias("value"), q("image").alias("image"))


@query("threshold_zero", d.select_sql(d.PTS, f"""
SELECT point_id, {Q('CASE WHEN abs(intensity - 0.04) < 0.015::DOUBLE THEN 0 ELSE intensity - 0.04 END')} AS value FROM pts"""))
def threshold_zero(spark, sf):
    return d.points(spark, sf).select("point_id", q(saliency.threshold_zero(C("intensity") - 0.04, 0.015)).alias("value"))


@query("top_fraction", d.select_sql([d.PTS, SCORES], f"""
SELECT point_id, {Q('saliency')} AS saliency FROM (SELECT *, row_number() OVER (ORDER BY saliency DESC, point_id) AS r, count(*) OVER () AS n FROM kk)
WHERE r <= ceil(n * 0.03)"""))
def top_fraction(spark, sf):
    return saliency.top_fraction(_scores(spark, sf), "saliency", 0.03).select("point_id", q("saliency").alias("saliency"))


@query("histogram", d.select_sql([d.PTS, SCORES], """
SELECT least(32, floor(saliency / (2600.0::DOUBLE / 33)))::INT AS bin, count(*) AS n FROM kk WHERE saliency BETWEEN 0 AND 2600 GROUP BY 1"""))
def histogram(spark, sf):
    return saliency.histogram(_scores(spark, sf), "saliency", 0.0, 2600.0, 33)


# --- feature histograms ---------------------------------------------------------------------------------------------------

SPFH = ["nrm AS (SELECT point_id, px, py, pz FROM eig)",
        """f0 AS (SELECT edges.point_id, nid, dist, dx / dist AS ex, dy / dist AS ey, dz / dist AS ez, a.px AS ux, a.py AS uy, a.pz AS uz,
  b.px AS tx, b.py AS ty, b.pz AS tz FROM edges JOIN nrm a ON a.point_id = edges.point_id JOIN nrm b ON b.point_id = edges.nid)""",
        "f1 AS (SELECT *, ey * uz - ez * uy AS vx, ez * ux - ex * uz AS vy, ex * uy - ey * ux AS vz FROM f0)",
        "f2 AS (SELECT *, uy * vz - uz * vy AS wx, uz * vx - ux * vz AS wy, ux * vy - uy * vx AS wz FROM f1)",
        """f3 AS (SELECT point_id, nid, dist, vx*tx + vy*ty + vz*tz AS alpha, ux*ex + uy*ey + uz*ez AS phi, wx*tx + wy*ty + wz*tz AS wt,
  ux*tx + uy*ty + uz*tz AS ut FROM f2)""",
        "f4 AS (SELECT *, CASE WHEN ut <> 0 THEN atan(wt / ut) WHEN wt <> 0 THEN sign(wt) * pi() / 2 END AS theta FROM f3)",
        "f5 AS (SELECT point_id, nid, dist, " + ", ".join(
            f"least(floor(CASE WHEN {c} < -1e-9 THEN {c} + 2 * pi() ELSE greatest(0, {c}) END / (2 * pi()) * 11), 10) AS {c}" for c in ("alpha", "phi", "theta"))
        + " FROM f4)",
        "sp0 AS (SELECT point_id, count(*) AS n, " + ", ".join(
            f"CASE WHEN count(*) <= 2 THEN 0.0::DOUBLE ELSE count(*) FILTER (WHERE {c} = {b}) / count(*)::DOUBLE END AS h{i * 11 + b}"
            for i, c in enumerate(("alpha", "phi", "theta")) for b in range(11)) + " FROM f5 GROUP BY 1)",
        "sp AS (SELECT point_id, coalesce(n, 0) AS n, " + ", ".join(f"coalesce(h{i}, 0.0::DOUBLE) AS h{i}" for i in range(33)) + " FROM pts LEFT JOIN sp0 USING (point_id))"]


def _spfh(spark, sf):
    pts = d.points(spark, sf)
    places = point_features.with_normals(joins.positions(pts), RADIUS)
    return pts, places, saliency.spfh(point_features.edges_with_normals(places, RADIUS), points=places)


@query("spfh", d.select_sql(EDGES + EIGEN + SPFH, "SELECT point_id, n, " + ", ".join(f"{Q(f'h{i}', 4)} AS h{i}" for i in range(33)) + " FROM sp"))
def spfh(spark, sf):
    pts, places, histograms = _spfh(spark, sf)
    return per_point(pts, places, histograms).select("point_id", "n", *(q(C("h")[i], 4).alias(f"h{i}") for i in range(33)))


@query("fpfh", d.select_sql(EDGES + EIGEN + SPFH + [
    "near AS (SELECT edges.point_id, count(*) AS c, " + ", ".join(f"sum(h{i} / dist) AS g{i}" for i in range(33))
    + " FROM edges JOIN sp ON sp.point_id = edges.nid GROUP BY 1)"], "SELECT sp.point_id, " + ", ".join(
    f"{Q(f'h{i} + CASE WHEN c >= 2 THEN g{i} / c ELSE 0 END', 3)} AS h{i}" for i in range(33)) + " FROM sp LEFT JOIN near USING (point_id)"))
def fpfh(spark, sf):
    pts, places, histograms = _spfh(spark, sf)
    histograms = cut_lineage(histograms)
    # The second distance join brings the histograms along: joining them to the edges of the first would shuffle every edge.
    described = cut_lineage(places.join(histograms.select("point_id", "h"), "point_id", "left"))
    edges = joins.radius_neighbors(described, RADIUS, carry=("m", "h"), home=True)
    return per_point(pts, places, saliency.fpfh(edges, histograms)).select(
        "point_id", *(q(C("h")[i], 3).alias(f"h{i}") for i in range(33)))


@query("chi2_distance", """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.vec_id, """ + Q("sum((abs(a.v) - abs(b.v)) * (abs(a.v) - abs(b.v)) / (abs(a.v) + abs(b.v) + 1e-10))") + """ AS chi2
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1""")
def chi2_distance(spark, sf):
    """Chi-square distance of each vector (absolute entries as a histogram) to the next one."""
    h = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    own = d.table(spark, sf, "embeddings").select("vec_id", h.alias("a"))
    following = own.select((C("vec_id") - 1).alias("vec_id"), C("a").alias("b"))
    return own.join(following, "vec_id").select("vec_id", q(saliency.chi2_distance(C("a"), C("b"))).alias("chi2"))


@query("hierarchical_saliency")
def hierarchical_saliency(spark, sf):
    """The definition compares each place with each other, so the places are the occupied voxels of all points, weighed by
    how many points they hold; every point has the value of its voxel."""
    labelled, centroids = smoothing.voxel_downsample(d.points(spark, sf), 1.0)
    places = centroids.select(C("voxel").alias("point_id"), "x", "y", "z", C("n").alias("m"))
    described = point_features.with_normals(places, 1.5)
    edges = cut_lineage(point_features.edges_with_normals(described, 1.5))
    features = saliency.fpfh(edges, cut_lineage(saliency.spfh(edges, points=places)))
    values = distinctness.hierarchical_saliency(places, features).withColumnRenamed("point_id", "voxel")
    return labelled.select("point_id", "voxel").join(values, "voxel").select("point_id", "saliency")


# --- cells ------------------------------------------------------------------------------------------------------------

XY_CELLS = ["ext AS (SELECT min(x) AS x0, min(y) AS y0 FROM pts)",
            """placed AS (SELECT pts.*, floor((y - y0) / 1.0::DOUBLE)::INT AS "row", floor((x - x0) / 1.0::DOUBLE)::INT AS col FROM pts CROSS JOIN ext)""",
            """cells AS (SELECT "row", col, row_number() OVER (ORDER BY "row", col) - 1 AS label FROM (SELECT DISTINCT "row", col FROM placed))"""]


@query("uniform_cells", d.select_sql([d.PTS] + XY_CELLS, """SELECT point_id, "row", col, label FROM placed JOIN cells USING ("row", col)"""))
def uniform_cells(spark, sf):
    return smoothing.uniform_cells(d.points(spark, sf), 1.0).select("point_id", "row", "col", "label")


@query("smooth_within_cells", d.select_sql([d.PTS] + XY_CELLS, f"""
SELECT point_id, {Q('avg(z) OVER (PARTITION BY "row", col)')} AS z FROM placed"""))
def smooth_within_cells(spark, sf):
    cells = smoothing.uniform_cells(d.points(spark, sf), 1.0)
    return smoothing.smooth_within_cells(cells, ["label"]).select("point_id", q("z").alias("z"))


@query("cell_neighbors_8sector", d.select_sql([d.PTS] + XY_CELLS + [
    """e AS (SELECT a.label, b."row" - a."row" AS dr, b.col - a.col AS dc FROM cells a JOIN cells b
  ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 WHERE a.label <> b.label)"""], """
SELECT label, sum(n)::BIGINT AS n, (count(*) FILTER (WHERE n >= 2))::INT AS sectors FROM (
  SELECT label, sign(dr) AS r, sign(dc) AS c, count(*) AS n FROM e GROUP BY ALL) GROUP BY label"""))
def cell_neighbors_8sector(spark, sf):
    cells = smoothing.uniform_cells(d.points(spark, sf), 1.0).select("row", "col", "label").distinct()
    return saliency.cell_neighbors_8sector(cells, 2, 2)[1]


@query("cell_saliency", d.select_sql([d.PTS] + XY_CELLS + [
    """k AS (SELECT label, avg(z) - 5 AS k FROM placed JOIN cells USING ("row", col) GROUP BY 1)""",
    """e AS (SELECT a.label, b.label AS nlabel, greatest(abs(b."row" - a."row"), abs(b.col - a.col)) AS far FROM cells a JOIN cells b
  ON b."row" BETWEEN a."row" - 3 AND a."row" + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 WHERE a.label <> b.label)""",
    "s AS (SELECT e.label, sum(CASE WHEN far <= 1 THEN 49.0::DOUBLE / 9 ELSE -1 END * abs(k)) AS s FROM e JOIN k ON k.label = e.nlabel GROUP BY 1)"], f"""
SELECT label, {Q('abs(coalesce(s, 0) + abs(k) * 49.0::DOUBLE / 9)')} AS saliency FROM k LEFT JOIN s USING (label)"""))
def cell_saliency(spark, sf):
    labelled = smoothing.uniform_cells(d.points(spark, sf), 1.0)
    cells = labelled.select("row", "col", "label").distinct()
    curvatures = labelled.groupBy("label").agg((F.avg("z") - 5).alias("curvature"))
    edges, _ = saliency.cell_neighbors_8sector(cells, 3)
    return saliency.cell_saliency(edges, curvatures, 2).select("label", q("saliency").alias("saliency"))


@query("cellwise_umbrella_curvature")
def cellwise_umbrella_curvature(spark, sf):
    return cell_curvature.cellwise_umbrella_curvature(d.points(spark, sf), 1.0, 4.0)


@query("common_plane", d.select_sql([d.PTS, "t AS (SELECT cloud_id, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz, " + ", ".join(
    f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts GROUP BY 1)", d.eigen_sql("t", vectors=True)], f"""
SELECT cloud_id, {Q('px', 4)} AS nx, {Q('py', 4)} AS ny, {Q('pz', 4)} AS nz, {Q('px * gx + py * gy + pz * gz', 4)} AS d FROM eig"""))
def common_plane(spark, sf):
    return saliency.common_plane(d.points(spark, sf), ["cloud_id"]).select("cloud_id", *(q(c, 4).alias(c) for c in ("nx", "ny", "nz", "d")))
