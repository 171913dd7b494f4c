"""Labels, graphs and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudframe.functions import linalg
from cloudframe.lineage import cut_lineage
from cloudframe.operators import graph, joins, linkage, segments, tensors
from cloudframe.plans import segmentation
from cloudframe.queries import _data as d
from cloudframe.registry import Q, q, query

C = F.col

# Labels of the points: three times the quantity, a segment number with gaps.
LABELS = "lab AS MATERIALIZED (SELECT point_id, (x * 3)::BIGINT AS label FROM pts)"


def _labels(spark, sf):
    return d.points(spark, sf).select("point_id", (C("x") * 3).cast("bigint").alias("label"))


@query("segment_sizes", d.select_sql([d.PTS, LABELS], "SELECT label, count(*) AS n FROM lab GROUP BY 1"))
def segment_sizes(spark, sf):
    return graph.segment_sizes(_labels(spark, sf))


@query("relabel_dense", d.select_sql([d.PTS, LABELS], "SELECT point_id, dense_rank() OVER (ORDER BY label) - 1 AS label FROM lab"))
def relabel_dense(spark, sf):
    return graph.relabel_dense(_labels(spark, sf)).select("point_id", "label")


@query("labels_check", d.select_sql([d.PTS, LABELS], "SELECT count(DISTINCT label) AS segments, min(label) = 0 AND max(label) = count(DISTINCT label) - 1 AS contiguous FROM lab"))
def labels_check(spark, sf):
    return graph.labels_check(_labels(spark, sf))


@query("update_labels", d.select_sql([d.PTS, LABELS], """SELECT point_id, CASE WHEN y > 40 AND label + 30 IN (SELECT label FROM lab) THEN label + 30 ELSE label END AS label FROM lab JOIN pts USING (point_id)"""))
def update_labels(spark, sf):
    labels = _labels(spark, sf)
    wanted = d.points(spark, sf).where("y > 40").select("point_id", ((C("x") * 3).cast("bigint") + 30).alias("label"))
    return graph.update_labels(labels, wanted).select("point_id", "label")


@query("segment_adjacency", d.select_sql([d.PTS, d.edges_sql(1.05, extra=", (a.x * 3)::BIGINT AS label, (b.x * 3)::BIGINT AS neighbor")],
                                         "SELECT DISTINCT label, neighbor FROM edges WHERE label <> neighbor"))
def segment_adjacency(spark, sf):
    labels = _labels(spark, sf)
    named = d.points(spark, sf).select("x", "y", "z", "point_id", (C("x") * 3).cast("bigint").alias("label"))
    # One row per position and label: copies of both share their edges.
    places = cut_lineage(named.groupBy("x", "y", "z", "label").agg(F.min("point_id").alias("point_id")).withColumn("neighbor", C("label")))
    return graph.segment_adjacency(labels, joins.radius_neighbors(places, 1.05, carry=("neighbor",), carry_left=("label",)))


@query("connected_components", d.select_sql([d.PTS,
    "g AS (SELECT *, CASE WHEN y - lag(y) OVER w <= 0.3::DOUBLE THEN 0 ELSE 1 END AS cut FROM pts WINDOW w AS (PARTITION BY x, z ORDER BY y, point_id))",
    "i AS (SELECT *, sum(cut) OVER (PARTITION BY x, z ORDER BY y, point_id) AS island FROM g)"],
    "SELECT point_id AS id, min(point_id) OVER (PARTITION BY x, z, island) AS component FROM i"))
def connected_components(spark, sf):
    """Points linked within 0.3; the cloud lies on lines one unit apart, so components are runs without a larger gap."""
    pts = d.points(spark, sf)
    places = cut_lineage(joins.positions(pts))
    found = graph.radius_components(places, 0.3)
    named = joins.per_point(pts, found.withColumnRenamed("id", "point_id"), places=places)
    return named.select(C("point_id").alias("id"), "component")


@query("adaptive_cells")
def adaptive_cells(spark, sf):
    return segments.adaptive_cells(d.points(spark, sf), 10, 2.0).select("point_id", "cell")


GRAPH = [d.PTS,
    "t AS (SELECT concat_ws('_', floor(x / 10)::BIGINT, floor(y / 10.4::DOUBLE)::BIGINT, floor(z / 5)::BIGINT) AS key, count(*) AS n, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz, " + ", ".join(f"CASE WHEN count(*) < 3 THEN {int(a == b)} ELSE covar_pop({a}, {b}) END AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts GROUP BY 1)",
    d.eigen_sql("t", "e", vectors=True),
    "k AS (SELECT a.key AS a, b.key AS b, row_number() OVER (PARTITION BY a.key ORDER BY sqrt((b.gx-a.gx)*(b.gx-a.gx) + (b.gy-a.gy)*(b.gy-a.gy) + (b.gz-a.gz)*(b.gz-a.gz)), b.key) AS r FROM t a, t b WHERE a.key <> b.key)",
    """p AS (SELECT a, b, l.l3 < 5 * l.l2 OR sqrt(l.l2) > 4 AS planar, r.gx - l.gx AS ox, r.gy - l.gy AS oy, r.gz - l.gz AS oz, l.px AS lpx, l.py AS lpy, l.pz AS lpz, r.px AS rpx, r.py AS rpy, r.pz AS rpz,
  l.sx AS lsx, l.sy AS lsy, l.sz AS lsz, r.sx AS rsx, r.sy AS rsy, r.sz AS rsz FROM k JOIN e l ON l.key = a JOIN e r ON r.key = b WHERE k.r <= 6 AND l.l1 < 4 AND r.l1 < 4)""",
    "u AS (SELECT a, b, planar, ox, oy, oz, " + ", ".join(f"CASE WHEN planar THEN {s}p{x} ELSE {s}s{x} END AS {s}{x}" for s in "lr" for x in "xyz") + " FROM p)",
    """v AS (SELECT a, b, CASE WHEN planar THEN abs(lx*ox + ly*oy + lz*oz) ELSE sqrt((ly*oz - lz*oy)**2 + (lz*ox - lx*oz)**2 + (lx*oy - ly*ox)**2) END AS dist,
  CASE WHEN lx*rx + ly*ry + lz*rz < 0 THEN (rx+lx)**2 + (ry+ly)**2 + (rz+lz)**2 ELSE (rx-lx)**2 + (ry-ly)**2 + (rz-lz)**2 END AS don FROM u)"""]


def _graph_sql(weight: str) -> str:
    return d.select_sql(GRAPH, f"SELECT a, b, {Q('dist', 4)} AS dist, {Q('don', 4)} AS don, {weight} AS weight FROM v")


FADE = "exp(-dist * dist / 2.0::DOUBLE) * exp(-don * don / 0.2::DOUBLE)"
RAMP = lambda t, alpha: f"ln((1 + exp({alpha} * ({t}))) / (1 + exp({alpha} * (({t}) - 1)))) / {alpha}"
RAW = f"(1 - {RAMP('least(5.0::DOUBLE, dist)', '100.0::DOUBLE')}) * {RAMP('(don - 0.8::DOUBLE) / 0.2::DOUBLE', '10.0::DOUBLE')}"
CLIPPED = f"CASE WHEN {RAW} < 0 THEN 0 ELSE {RAW} END"


@query("similarity_graph", _graph_sql("CASE WHEN dist < 2 AND don < 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
def similarity_graph(spark, sf):
    return _graph(spark, sf, "binary").select("a", "b", q("dist", 4).alias("dist"), q("don", 4).alias("don"), "weight")


def _blocks(spark, sf):
    key = F.concat_ws("_", F.floor(C("x") / 10), F.floor(C("y") / 10.4), F.floor(C("z") / 5))
    return cut_lineage(segments.tensors_of(d.points(spark, sf).withColumn("key", key), "key"))


def _graph(spark, sf, mode):
    return segments.similarity_graph(_blocks(spark, sf), 6, 4.0, 0.2, 2.0, mode=mode, distance_scale=1.0)


def _rounded_graph(spark, sf, mode):
    return _graph(spark, sf, mode).select("a", "b", q("dist", 4).alias("dist"), q("don", 4).alias("don"), q("weight", 4).alias("weight"))


@query("similarity_graph_exp", _graph_sql(Q(FADE, 4)))
def similarity_graph_exp(spark, sf):
    return _rounded_graph(spark, sf, "exp")


@query("similarity_graph_soft_clipping", _graph_sql(Q(CLIPPED, 4)))
def similarity_graph_soft_clipping(spark, sf):
    return _rounded_graph(spark, sf, "soft_clipping")


@query("similarity_lookup", d.select_sql(GRAPH + [f"w AS (SELECT a, b, {FADE} AS weight FROM v)"], f"""
SELECT p.b AS a, p.a AS b, {Q('coalesce(w.weight, 0)', 4)} AS weight FROM w p LEFT JOIN w ON w.a = p.b AND w.b = p.a"""))
def similarity_lookup(spark, sf):
    g = cut_lineage(_graph(spark, sf, "exp"))
    mirrored = g.select(C("b").alias("a"), C("a").alias("b"))
    return segments.similarity_lookup(g, mirrored).select("a", "b", q("weight", 4).alias("weight"))


@query("surface_segmentation")
def surface_segmentation(spark, sf):
    """Surface elements, similarity graph, components, dissolved and merged segments, back to points."""
    return segmentation.surface_segments(d.points(spark, sf), leaf_size=10, smallest=4.0, neighbors=6, variance=2.0, normal_difference=0.3, distance=1.0)


REFINE = [d.PTS, "t AS (SELECT cloud_id, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz, " + ", ".join(f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts GROUP BY 1)",
          d.eigen_sql("t", "e", vectors=True),
          "c AS (SELECT point_id, e.cloud_id AS label, ((x - gx) * px + (y - gy) * py + (z - gz) * pz) ** 2 / greatest(l1, 1e-12) AS cost FROM pts, e)"]


def _costs(spark, sf):
    pts = d.points(spark, sf)
    t = segments.tensors_of(pts.withColumnRenamed("cloud_id", "key"), "key")
    labels = pts.select("point_id").withColumn("label", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
    return pts, labels, t


@query("refine_point_labels", d.select_sql(REFINE, f"SELECT point_id, {Q('min(cost)', 4)} AS cost FROM c GROUP BY 1"))
def refine_point_labels(spark, sf):
    return segments.refine_point_labels(*_costs(spark, sf)).select("point_id", q("cost", 4).alias("cost"))


@query("segment_energy", d.select_sql(REFINE, f"SELECT {Q('sum(k)', 2)} AS energy FROM (SELECT min(cost) AS k FROM c GROUP BY point_id)"))
def segment_energy(spark, sf):
    return segments.segment_energy(segments.refine_point_labels(*_costs(spark, sf))).select(q("energy", 2).alias("energy"))


@query("scanline_segmentation")
def scanline_segmentation(spark, sf):
    from cloudframe.queries.points import _sph
    return segments.scanline_segmentation(_sph(spark, sf), 1.0, ransac_ratio=0.2, min_points=200)


@query("curve_clusters")
def curve_clusters(spark, sf):
    """Single linkage of all embeddings over all of their entries."""
    vectors = d.table(spark, sf, "embeddings").select(C("vec_id").alias("point_id"), C("embedding").alias("v"))
    return linkage.curve_clusters(vectors)
