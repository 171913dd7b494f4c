"""Neighbourhood joins and covariance tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudframe.functions import linalg
from cloudframe.lineage import cut_lineage
from cloudframe.operators import joins, tensors
from cloudframe.queries import _data as d
from cloudframe.registry import Q, q, query

C = F.col
RADIUS = 1.25

EDGES = [d.PTS, d.edges_sql(RADIUS)]


def position_edges(spark, sf, radius=RADIUS):
    """Points, their distinct positions (found once, checkpointed) and the positions' edges, weighted by multiplicity."""
    pts = d.points(spark, sf)
    places = cut_lineage(joins.positions(pts))
    return pts, places, joins.radius_neighbors(places, radius, carry=("m",), home=True)


def per_point(pts, places, features):
    return joins.per_point(pts, features, places=places)


@query("radius_neighbors", d.select_sql([d.PTS, d.edges_sql(0.5)], f"""
SELECT point_id, nid, {Q('dx')} AS dx, {Q('dy')} AS dy, {Q('dz')} AS dz, {Q('dist')} AS dist FROM edges"""))
def radius_neighbors(spark, sf):
    return joins.radius_neighbors(d.spread_points(spark, sf), 0.5).select(
        "point_id", "nid", q("dx").alias("dx"), q("dy").alias("dy"), q("dz").alias("dz"), q("dist").alias("dist"))


@query("radius_neighbors_xy", d.select_sql([d.PTS, d.edges_sql(0.05, dims="xy")], f"""
SELECT point_id, nid, {Q('dist')} AS dist FROM edges"""))
def radius_neighbors_xy(spark, sf):
    return joins.radius_neighbors(d.spread_points(spark, sf), 0.05, ("x", "y")).select("point_id", "nid", q("dist").alias("dist"))


@query("radius_neighbors_with_self", d.select_sql([d.PTS, d.edges_sql(0.25)], f"""
SELECT point_id, nid, {Q('dist')} AS dist FROM edges UNION ALL SELECT point_id, point_id, 0.0::DOUBLE FROM pts"""))
def radius_neighbors_with_self(spark, sf):
    return joins.radius_neighbors(d.spread_points(spark, sf), 0.25, include_self=True).select(
        "point_id", "nid", q("dist").alias("dist"))


@query("radius_knn", d.select_sql(EDGES, f"""
SELECT point_id, nid, {Q('dist')} AS dist, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, nid) AS rank FROM edges) WHERE rank <= 4"""))
def radius_knn(spark, sf):
    return joins.radius_knn(d.points(spark, sf), 4, RADIUS).select("point_id", "nid", q("dist").alias("dist"), "rank")


@query("knn", d.select_sql([d.PTS, d.edges_sql(4.0)], f"""
SELECT point_id, nid, {Q('dist')} AS dist, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, nid) AS rank FROM edges) WHERE rank <= 5"""))
def knn(spark, sf):
    return joins.each_knn(d.points(spark, sf), 5).select("point_id", "nid", q("dist").alias("dist"), "rank")


@query("knn_all_pairs", d.select_sql(d.SMALL, f"""
SELECT point_id, nid, {Q('dist')} AS dist, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, nid) AS rank FROM (
    SELECT a.point_id, b.point_id AS nid, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist
    FROM pts a CROSS JOIN pts b) WHERE dist > 0) WHERE rank <= 10"""))
def knn_all_pairs(spark, sf):
    pts = d.small_points(spark, sf)
    return joins.knn(pts, pts, 10).select("point_id", "nid", q("dist").alias("dist"), "rank")


SUPPLIER_SPOTS = """spots AS (SELECT s_suppkey AS point_id, (s_suppkey % 60)::DOUBLE - 5.0::DOUBLE AS x,
  s_acctbal / 150.0::DOUBLE AS y, s_nationkey::DOUBLE / 2.0::DOUBLE AS z FROM supplier)"""


def _spots(spark, sf):
    return d.table(spark, sf, "supplier").select(
        C("s_suppkey").alias("point_id"), ((C("s_suppkey") % 60).cast("double") - 5.0).alias("x"),
        (C("s_acctbal") / 150.0).alias("y"), (C("s_nationkey").cast("double") / 2.0).alias("z"))


@query("neighbors_of", d.select_sql([d.PTS, SUPPLIER_SPOTS, d.edges_sql(2.0, left="spots", strict=True)], f"""
SELECT point_id, nid, {Q('dist')} AS dist FROM edges"""))
def neighbors_of(spark, sf):
    return joins.neighbors_of(_spots(spark, sf), d.points(spark, sf), 2.0).select(
        "point_id", "nid", q("dist").alias("dist"))


@query("nearest_point_to_vertices", d.select_sql([d.PTS, SUPPLIER_SPOTS], f"""
SELECT point_id, nid, {Q('dist')} AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, nid) AS rank FROM (
    SELECT a.point_id, b.point_id AS nid, sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)) AS dist
    FROM spots a CROSS JOIN pts b)) WHERE rank = 1"""))
def nearest_point_to_vertices(spark, sf):
    return joins.knn(_spots(spark, sf), d.points(spark, sf), 1, ("x", "y"), include_zero=True).select(
        "point_id", "nid", q("dist").alias("dist"))


@query("neighbor_rank", d.select_sql([d.PTS, d.edges_sql(0.5)], """
SELECT point_id, nid, row_number() OVER (PARTITION BY point_id ORDER BY dist, nid)::INT AS rank FROM edges"""))
def neighbor_rank(spark, sf):
    return joins.nearest_first(joins.radius_neighbors(d.spread_points(spark, sf), 0.5, home=True)).select("point_id", "nid", "rank")


@query("grid_neighbors", d.select_sql([d.PTS, """cells AS (SELECT point_id, floor(x / 0.4::DOUBLE + 0.5::DOUBLE) AS a,
  floor(y / 0.4::DOUBLE + 0.5::DOUBLE) AS b, floor(z / 0.4::DOUBLE + 0.5::DOUBLE) AS c FROM pts)"""], """
SELECT p.point_id, o.point_id AS nid FROM cells p
JOIN (SELECT point_id, a + i AS a, b + j AS b, c + k AS c FROM cells
      CROSS JOIN (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) f(i, j, k)) o
  ON o.a = p.a AND o.b = p.b AND o.c = p.c WHERE o.point_id <> p.point_id"""))
def grid_neighbors(spark, sf):
    pts = d.points(spark, sf)
    return joins.grid_neighbors(pts, pts, 0.4)


@query("neighborhood_stats", d.select_sql(EDGES, f"""
SELECT point_id, count(nid) AS n, {Q('coalesce(sum(dist), 0) / (count(nid) + 1)')} AS mean_radius
FROM pts LEFT JOIN edges USING (point_id) GROUP BY point_id"""))
def neighborhood_stats(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, tensors.neighborhood_stats(edges, places)).select(
        "point_id", "n", q("mean_radius").alias("mean_radius"))


@query("average_neighborhood", d.select_sql(EDGES, f"""
SELECT {Q('avg(r)')} AS mean_radius, floor(avg(n + 1))::BIGINT AS mean_size FROM (
  SELECT point_id, coalesce(sum(dist), 0) / (count(nid) + 1) AS r, count(nid) AS n
  FROM pts LEFT JOIN edges USING (point_id) GROUP BY point_id)"""))
def average_neighborhood(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return tensors.average_neighborhood(edges, places).select(q("mean_radius").alias("mean_radius"), "mean_size")


@query("moments", d.select_sql(d.PTS, """SELECT cloud_id, count(*) AS n, """ + ", ".join(
    f"{Q(f'avg({a})', 5)} AS c{a}" for a in "xyz") + ", " + ", ".join(
    f"{Q(f'covar_pop({a}, {b})', 5)} AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts GROUP BY cloud_id"))
def moments(spark, sf):
    return tensors.moments(d.points(spark, sf), ["cloud_id"]).select(
        "cloud_id", "n", *(q(c, 5).alias(c) for c in ("cx", "cy", "cz", *linalg.SYMMETRIC)))


@query("moments_weighted", d.select_sql([d.PTS, "w AS (SELECT *, 1.0::DOUBLE + intensity AS w FROM pts)", """c AS (SELECT cloud_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM w GROUP BY 1)"""], "SELECT cloud_id, count(*) AS n, " + ", ".join(
    f"{Q(f'sum(w * ({a} - m{a}) * ({b} - m{b})) / sum(w)', 5)} AS c{a}{b}" for a, b in tensors.PAIRS)
    + " FROM w JOIN c USING (cloud_id) GROUP BY cloud_id"))
def moments_weighted(spark, sf):
    weighted = d.points(spark, sf).withColumn("w", 1.0 + C("intensity"))
    return tensors.moments(weighted, ["cloud_id"], weight="w").select(
        "cloud_id", "n", *(q(c, 5).alias(c) for c in linalg.SYMMETRIC))


@query("tensor_from_neighbors", d.select_sql(EDGES + [d.TENSORS], "SELECT point_id, n, " + ", ".join(
    f"{Q(c)} AS {c}" for c in linalg.SYMMETRIC) + " FROM tensors"))
def tensor_from_neighbors(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, tensors.tensor_from_neighbors(edges, points=places)).select(
        "point_id", "n", *(q(c).alias(c) for c in linalg.SYMMETRIC))


@query("tensor_from_neighbors_gaussian", d.every(d.select_sql(EDGES + [
    "r AS (SELECT point_id, sum(dist) / (count(*) + 1) / 3 AS s FROM edges GROUP BY 1)",
    "w AS (SELECT edges.*, exp(-dist * dist / (2 * s * s)) AS w FROM edges JOIN r USING (point_id))"],
    "SELECT point_id, count(*) AS n, " + ", ".join(
        f"{Q(f'CASE WHEN count(*) < 3 THEN {int(a == b)} ELSE sum(w * d{a} * d{b}) / sum(w) END')} AS c{a}{b}"
        for a, b in tensors.PAIRS) + " FROM w GROUP BY point_id"), n=0, cxx="1.0::DOUBLE", cxy="0.0::DOUBLE", cxz="0.0::DOUBLE", cyy="1.0::DOUBLE",
    cyz="0.0::DOUBLE", czz="1.0::DOUBLE"))
def tensor_from_neighbors_gaussian(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    stats = tensors.neighborhood_stats(edges).select("point_id", (C("mean_radius") / 3).alias("sigma"))
    wide = cut_lineage(places.join(stats, "point_id", "left"))
    edges = joins.radius_neighbors(wide, RADIUS, carry=("m",), carry_left=("sigma",), home=True)
    return per_point(pts, places, tensors.tensor_from_neighbors(edges, gaussian=True, points=places)).select(
        "point_id", "n", *(q(c).alias(c) for c in linalg.SYMMETRIC))


@query("eigen3_values", d.select_sql(EDGES + [d.TENSORS, d.eigen_sql()], f"""
SELECT point_id, {Q('l1', 5)} AS l1, {Q('l2', 5)} AS l2, {Q('l3', 5)} AS l3 FROM eig"""))
def eigen3_values(spark, sf):
    pts, places, edges = position_edges(spark, sf)
    return per_point(pts, places, linalg.eigenvalues(tensors.tensor_from_neighbors(edges, points=places))).select(
        "point_id", *(q(c, 5).alias(c) for c in ("l1", "l2", "l3")))


@query("surface_variation", d.select_sql(EDGES + [d.TENSORS, d.eigen_sql()], f"""
SELECT point_id, n, {Q('l1 / nullif(l1 + l2 + l3, 0)', 5)} AS variation FROM eig"""))
def surface_variation(spark, sf):
    """Smallest eigenvalue over the trace, per point."""
    pts, places, edges = position_edges(spark, sf)
    eigen = linalg.eigenvalues(tensors.tensor_from_neighbors(edges, points=places))
    return per_point(pts, places, eigen.select("point_id", "n", "l1", "l2", "l3")).select(
        "point_id", "n", q(F.try_divide(C("l1"), C("l1") + C("l2") + C("l3")), 5).alias("variation"))


@query("merge_tensors", d.select_sql(d.PTS, """SELECT cloud_id, count(DISTINCT x) AS n_tensors, count(*) AS n, """ + ", ".join(
    f"{Q(f'avg({a})', 5)} AS c{a}" for a in "xyz") + ", " + ", ".join(
    f"{Q(f'covar_pop({a}, {b})', 5)} AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts GROUP BY cloud_id"))
def merge_tensors(spark, sf):
    """Tensors per cloud and x slab, pooled per cloud: must equal the tensor of the whole cloud."""
    slabs = tensors.moments(d.points(spark, sf).withColumn("slab", C("x")), ["cloud_id", "slab"], min_points=0)
    return tensors.merge_tensors(slabs, ["cloud_id"]).select(
        "cloud_id", "n_tensors", "n", *(q(c, 5).alias(c) for c in ("cx", "cy", "cz", *linalg.SYMMETRIC)))
