"""Ordered curve operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudframe.operators import curves
from cloudframe.queries import _data as d
from cloudframe.registry import Q, q, query

C = F.col
W = "OVER (PARTITION BY curve_id ORDER BY seq)"
ARC = [d.CURVES, f"st AS (SELECT *, coalesce(sqrt((x - lag(x) {W}) ** 2 + (y - lag(y) {W}) ** 2), 0) AS step FROM curves)",
       f"arc AS (SELECT curve_id, seq, x, y, sum(step) {W} AS cdf, sum(step) OVER (PARTITION BY curve_id) AS length FROM st)"]


@query("arc_length", d.select_sql(ARC, f"SELECT curve_id, seq, {Q('cdf', 4)} AS cdf, {Q('length', 4)} AS length, {Q('cdf / length')} AS t FROM arc"))
def arc_length(spark, sf):
    return curves.arc_length(d.curves(spark, sf)).select("curve_id", "seq", q("cdf", 4).alias("cdf"), q("length", 4).alias("length"), q("t").alias("t"))


ENDS = "ends AS (SELECT curve_id, sqrt((arg_max(x, seq) - arg_min(x, seq)) ** 2 + (arg_max(y, seq) - arg_min(y, seq)) ** 2) AS chord FROM curves GROUP BY 1)"


@query("chord_length", d.select_sql([d.CURVES, ENDS], f"SELECT curve_id, {Q('chord', 5)} AS chord, chord < 690 AS closed FROM ends"))
def chord_length(spark, sf):
    return curves.chord_length(d.curves(spark, sf), 690).select("curve_id", q("chord", 5).alias("chord"), "closed")


@query("reclassify_outlines", d.select_sql([d.CURVES, ENDS], "SELECT curve_id, CASE WHEN chord < 690 THEN 'polygon' ELSE 'line' END AS kind FROM ends"))
def reclassify_outlines(spark, sf):
    return curves.reclassify_outlines(d.curves(spark, sf), 690)


@query("tangent_normal_binormal", d.select_sql(ARC + [
    "w AS (SELECT *, " + ", ".join(f"{f}({c}, {n}) {W} AS {p}{c}" for c in ("x", "y", "cdf") for p, f, n in (("p", "lag", 1), ("pp", "lag", 2), ("n", "lead", 1), ("nn", "lead", 2))) + " FROM arc)",
    """k AS (SELECT curve_id, seq, """ + ", ".join(
        f"CASE WHEN p{c} IS NULL THEN {c} WHEN n{c} IS NULL THEN pp{c} ELSE p{c} END AS a{c}, CASE WHEN p{c} IS NULL THEN n{c} WHEN n{c} IS NULL THEN p{c} ELSE {c} END AS m{c}, CASE WHEN p{c} IS NULL THEN nn{c} WHEN n{c} IS NULL THEN {c} ELSE n{c} END AS c{c}"
        for c in ("x", "y", "cdf")) + """,
  CASE WHEN pcdf IS NULL THEN (nx - x) / (ncdf - cdf) WHEN ncdf IS NULL THEN (x - px) / (cdf - pcdf) ELSE (nx - px) / (ncdf - pcdf) END AS tx,
  CASE WHEN pcdf IS NULL THEN (ny - y) / (ncdf - cdf) WHEN ncdf IS NULL THEN (y - py) / (cdf - pcdf) ELSE (ny - py) / (ncdf - pcdf) END AS ty FROM w)""",
    """m AS (SELECT curve_id, seq, tx, ty, (cx - 2 * mx + ax) / ((ccdf - acdf) / 2) ** 2 AS mx, (cy - 2 * my + ay) / ((ccdf - acdf) / 2) ** 2 AS my FROM k)""".replace('"by"', "b_y")]
    , f"SELECT curve_id, seq, {Q('tx', 5)} AS tx, {Q('ty', 5)} AS ty, {Q('sqrt(mx * mx + my * my)', 4)} AS curvature FROM m"))
def tangent_normal_binormal(spark, sf):
    out = curves.tangent_normal(d.curves(spark, sf))
    return out.select("curve_id", "seq", q("tx", 5).alias("tx"), q("ty", 5).alias("ty"), q("curvature", 4).alias("curvature"))


NEAR = lambda low, high: ARC + [
    f"pv AS (SELECT a.curve_id, a.seq, max(b.seq) AS ps FROM arc a JOIN arc b ON a.curve_id = b.curve_id AND a.cdf - b.cdf >= {low}::DOUBLE AND a.cdf - b.cdf <= {high}::DOUBLE GROUP BY 1, 2)",
    f"nv AS (SELECT a.curve_id, a.seq, min(b.seq) AS ns FROM arc a JOIN arc b ON a.curve_id = b.curve_id AND b.cdf - a.cdf >= {low}::DOUBLE AND b.cdf - a.cdf <= {high}::DOUBLE GROUP BY 1, 2)",
    """tr AS (SELECT a.curve_id, a.seq, a.x, a.y, a.cdf, p.x AS px, p.y AS py, p.cdf AS pc, n.x AS nx, n.y AS ny, n.cdf AS nc FROM arc a
  LEFT JOIN pv USING (curve_id, seq) LEFT JOIN nv USING (curve_id, seq) LEFT JOIN arc p ON p.curve_id = a.curve_id AND p.seq = ps LEFT JOIN arc n ON n.curve_id = a.curve_id AND n.seq = ns)"""]


@query("tangent_by_arc", d.select_sql(NEAR(40.0, 140.0), f"""SELECT curve_id, seq, {Q('(nx - px) / (nc - pc)', 5)} AS tx, {Q('(ny - py) / (nc - pc)', 5)} AS ty,
  {Q('sqrt((nx - 2 * x + px) ** 2 + (ny - 2 * y + py) ** 2) / ((nc - pc) / 2) ** 2', 6)} AS curvature FROM tr WHERE pc IS NOT NULL AND nc IS NOT NULL"""))
def tangent_by_arc(spark, sf):
    out = curves.tangent_normal_by_arc(d.curves(spark, sf), 40.0, 100.0)
    return out.select("curve_id", "seq", q("tx", 5).alias("tx"), q("ty", 5).alias("ty"), q("curvature").alias("curvature"))


@query("curve_curvature_3pt", d.select_sql(NEAR(40.0, 60.0) + [
    "s AS (SELECT curve_id, seq, sqrt((nx-x)**2 + (ny-y)**2) AS a, sqrt((px-nx)**2 + (py-ny)**2) AS b, sqrt((x-px)**2 + (y-py)**2) AS c FROM tr)",
    "h AS (SELECT *, (a + b + c) / 2 AS h FROM s)"], f"""SELECT curve_id, seq, {Q('coalesce(CASE WHEN a * b * c > 0 THEN 4 * sqrt(greatest(0, h * (h - a) * (h - b) * (h - c))) / (a * b * c) END, 0)', 5)} AS curvature FROM h"""))
def curve_curvature_3pt(spark, sf):
    return curves.curve_curvature_3pt(d.curves(spark, sf), 50.0, 10.0).select("curve_id", "seq", q("curvature", 5).alias("curvature"))


@query("resample_curve", d.select_sql(ARC + [f"seg AS (SELECT *, lead(x) {W} AS nx, lead(y) {W} AS ny, lead(cdf) {W} AS nc FROM arc)",
    "k AS (SELECT curve_id, k * 100.0::DOUBLE AS tau, x + (k * 100.0::DOUBLE - cdf) / (nc - cdf) * (nx - x) AS x, y + (k * 100.0::DOUBLE - cdf) / (nc - cdf) * (ny - y) AS y FROM seg, generate_series(0, 200) g(k) WHERE nc IS NOT NULL AND k >= ceil(cdf / 100.0::DOUBLE) AND k <= ceil(nc / 100.0::DOUBLE) - 1)"],
    f"SELECT curve_id, {Q('tau', 4)} AS tau, {Q('x', 4)} AS x, {Q('y', 4)} AS y FROM (SELECT * FROM k UNION ALL SELECT curve_id, cdf, x, y FROM seg WHERE nc IS NULL)"))
def resample_curve(spark, sf):
    return curves.resample_curve(d.curves(spark, sf), 100.0).select("curve_id", *(q(c, 4).alias(c) for c in ("tau", "x", "y")))


@query("curve_derivatives_closed", d.select_sql(ARC + [
    "e AS (SELECT curve_id, arg_min(x, seq) AS fx, arg_min(y, seq) AS fy, arg_max(x, seq) AS lx, arg_max(y, seq) AS ly, count(*) AS n FROM curves GROUP BY 1)",
    f"w AS (SELECT arc.*, coalesce(lag(x) {W}, lx) AS px, coalesce(lag(y) {W}, ly) AS py, coalesce(lead(x) {W}, fx) AS nx, coalesce(lead(y) {W}, fy) AS ny, coalesce(lead(cdf) {W} - cdf, length / (n - 1)) AS h FROM arc JOIN e USING (curve_id))"],
    f"SELECT curve_id, seq, {Q('(nx - px) / (2 * h)', 4)} AS dx, {Q('(ny - py) / (2 * h)', 4)} AS dy, {Q('(nx + px - 2 * x) / (h * h)', 3)} AS d2x, {Q('(ny + py - 2 * y) / (h * h)', 3)} AS d2y FROM w"))
def curve_derivatives_closed(spark, sf):
    out = curves.curve_derivatives_closed(d.curves(spark, sf))
    return out.select("curve_id", "seq", q("dx", 4).alias("dx"), q("dy", 4).alias("dy"), q("d2x", 3).alias("d2x"), q("d2y", 3).alias("d2y"))


@query("curve_smoothing", d.select_sql([d.CURVES, "n AS (SELECT a.curve_id, a.seq, a.x, a.y, count(*) AS k, sum((b.x - a.x) / sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) / sum(1 / sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS ux, sum((b.y - a.y) / sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) / sum(1 / sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS uy FROM curves a JOIN curves b ON a.curve_id = b.curve_id AND b.seq BETWEEN a.seq - 2 AND a.seq + 2 AND a.seq <> b.seq GROUP BY 1, 2, 3, 4)"],
    f"SELECT curve_id, seq, {Q('CASE WHEN k = 4 THEN x + ux ELSE x END', 5)} AS x, {Q('CASE WHEN k = 4 THEN y + uy ELSE y END', 5)} AS y FROM n"))
def curve_smoothing(spark, sf):
    return curves.curve_smoothing(d.curves(spark, sf), 2).select("curve_id", "seq", q("x", 5).alias("x"), q("y", 5).alias("y"))


@query("thin_curve", d.select_sql(ARC + ["kept(curve_id, seq, cdf) AS (SELECT curve_id, seq, cdf FROM arc WHERE seq = 0 UNION ALL SELECT k.curve_id, (SELECT min(a.seq) FROM arc a WHERE a.curve_id = k.curve_id AND a.cdf >= k.cdf + 150), (SELECT min(a.cdf) FROM arc a WHERE a.curve_id = k.curve_id AND a.cdf >= k.cdf + 150) FROM kept k WHERE k.seq IS NOT NULL)"],
    "SELECT curve_id, seq FROM kept WHERE seq IS NOT NULL").replace("WITH curves", "WITH RECURSIVE curves"))
def thin_curve(spark, sf):
    return curves.thin_curve(d.curves(spark, sf), 150.0).select("curve_id", "seq")


@query("simplify_curve")
def simplify_curve(spark, sf):
    return curves.simplify_curve(d.curves(spark, sf), 40.0).select("curve_id", "seq")


@query("curve_cross_correlation", d.select_sql([d.CURVES], f"""SELECT a.curve_id AS id_a, b.curve_id AS id_b, (b.seq - a.seq)::INT AS lag, {Q('sum(a.x * b.x)', 2)} AS corr_x, {Q('sum(a.y * b.y)', 2)} AS corr_y
FROM curves a JOIN curves b ON b.curve_id = a.curve_id + 1 AND abs(b.seq - a.seq) <= 3 GROUP BY 1, 2, 3"""))
def curve_cross_correlation(spark, sf):
    """Every curve against the next one."""
    c = d.curves(spark, sf)
    ids = c.select("curve_id").distinct()
    pairs = ids.select(C("curve_id").alias("id_a"), (C("curve_id") + 1).alias("id_b")).join(ids.withColumnRenamed("curve_id", "id_b"), "id_b", "left_semi")
    out = curves.curve_cross_correlation(c, c, pairs, 3)
    return out.select("id_a", "id_b", "lag", q("corr_x", 2).alias("corr_x"), q("corr_y", 2).alias("corr_y"))


@query("shorter_curve", d.select_sql(ARC + ["l AS (SELECT DISTINCT curve_id, length FROM arc)"], """SELECT a.curve_id AS id_a, b.curve_id AS id_b, CASE WHEN a.length <= b.length THEN a.curve_id ELSE b.curve_id END AS shorter,
  CASE WHEN a.length <= b.length THEN b.curve_id ELSE a.curve_id END AS longer FROM l a JOIN l b ON b.curve_id = a.curve_id + 1"""))
def shorter_curve(spark, sf):
    lengths = curves.arc_length(d.curves(spark, sf)).groupBy("curve_id").agg(F.max("length").alias("length"))
    pairs = lengths.select(C("curve_id").alias("id_a"), (C("curve_id") + 1).alias("id_b"))
    return curves.shorter_curve(pairs, lengths)
