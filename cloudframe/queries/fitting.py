"""Fits and registration."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudframe.functions import geometry
from cloudframe.operators import fitting, joins, tensors
from cloudframe.queries import _data as d
from cloudframe.registry import Q, q, query

C = F.col
PLANE = ["t AS (SELECT cloud_id, count(*) AS n, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz, " + ", ".join(
    f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in tensors.PAIRS) + " FROM pts GROUP BY 1)", d.eigen_sql("t", "e", vectors=True)]


@query("fit_plane_pca", d.select_sql([d.PTS] + PLANE, f"SELECT cloud_id, n, {Q('px', 4)} AS nx, {Q('py', 4)} AS ny, {Q('pz', 4)} AS nz, {Q('px*gx + py*gy + pz*gz', 4)} AS d, {Q('sqrt(l1)', 5)} AS rmse FROM e"))
def fit_plane_pca(spark, sf):
    p = fitting.fit_plane_pca(d.points(spark, sf), ["cloud_id"])
    return p.select("cloud_id", "n", *(q(c, 4).alias(c) for c in ("nx", "ny", "nz", "d")), q("rmse", 5).alias("rmse"))


@query("fit_plane_gauss_helmert", d.select_sql([d.PTS] + PLANE, f"SELECT cloud_id, n, {Q('sqrt(l1)', 5)} AS rmse FROM e"))
def fit_plane_gauss_helmert(spark, sf):
    p = fitting.fit_plane_gauss_helmert(d.points(spark, sf), ["cloud_id"], (0.1, 0.1, 1.0, 5.0))
    return p.select("cloud_id", "n", q("rmse", 5).alias("rmse"))


@query("rmse_report", d.select_sql([d.PTS] + PLANE + ["r AS (SELECT abs(px*(x-gx) + py*(y-gy) + pz*(z-gz)) AS a FROM pts JOIN e USING (cloud_id))",
    "k AS (SELECT a, row_number() OVER (ORDER BY a DESC) AS i, count(*) OVER () AS n FROM r)"],
    f"""SELECT {Q('sqrt(avg(a * a))', 5)} AS rmse, {Q('avg(a)', 5)} AS mean_abs, {Q('max(a)', 5)} AS max_abs,
  {Q('avg(a) FILTER (WHERE i <= ceil(n * 0.05::DOUBLE))', 5)} AS worst5, {Q('avg(a) FILTER (WHERE i <= ceil(n * 0.10::DOUBLE))', 5)} AS worst10 FROM k"""))
def rmse_report(spark, sf):
    pts = d.points(spark, sf)
    report = fitting.rmse_report(fitting.plane_residuals(pts, fitting.fit_plane_pca(pts, ["cloud_id"]), ["cloud_id"]))
    return report.select(*(q(c, 5).alias(c) for c in report.columns))


@query("worst_fraction_mean", d.select_sql([d.PTS, "k AS (SELECT y, row_number() OVER (ORDER BY y DESC) AS i, count(*) OVER () AS n FROM pts)"],
    f"SELECT {Q('avg(y) FILTER (WHERE i <= ceil(n * 0.05::DOUBLE))', 5)} AS w0, {Q('avg(y) FILTER (WHERE i <= ceil(n * 0.1::DOUBLE))', 5)} AS w1 FROM k"))
def worst_fraction_mean(spark, sf):
    from cloudframe.ordering import worst_mean
    return worst_mean(d.points(spark, sf), "y", [0.05, 0.1]).select(q("w0", 5).alias("w0"), q("w1", 5).alias("w1"))


@query("fit_line_ls", d.select_sql(d.CURVES, f"""SELECT curve_id, count(*) AS n, {Q('regr_slope(y, x)', 6)} AS slope, {Q('regr_intercept(y, x)', 4)} AS intercept,
  {Q('sqrt(greatest(0, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2))', 4)} AS sigma FROM curves GROUP BY 1"""))
def fit_line_ls(spark, sf):
    return fitting.fit_line_ls(d.curves(spark, sf), ["curve_id"]).select(
        "curve_id", "n", q("slope").alias("slope"), q("intercept", 4).alias("intercept"), q("sigma", 4).alias("sigma"))


@query("fit_biquadratic")
def fit_biquadratic(spark, sf):
    return fitting.fit_biquadratic(d.points(spark, sf), ["cloud_id"])


# A noisy ring per supplier: the angle comes from the part, the noise from the discount.
def _rings(spark, sf, a=1.0, b=1.0, tilt=0.0):
    t = C("l_partkey") * 0.7
    li = d.table(spark, sf, "lineitem")
    radius = 10.0 + C("l_suppkey") % 7 + C("l_discount") - 0.05
    u, v = a * radius * F.cos(t), b * radius * F.sin(t)
    return li.select(C("l_suppkey").alias("cloud_id"), (u * math.cos(tilt) - v * math.sin(tilt) + C("l_suppkey")).alias("x"),
                     (u * math.sin(tilt) + v * math.cos(tilt) - C("l_suppkey")).alias("y"))


@query("fit_circle")
def fit_circle(spark, sf):
    return fitting.fit_circle(_rings(spark, sf), ["cloud_id"])


@query("fit_ellipse")
def fit_ellipse(spark, sf):
    return fitting.fit_ellipse(_rings(spark, sf, 1.5, 0.8, 0.4), ["cloud_id"])


@query("align_principal_axes")
def align_principal_axes(spark, sf):
    return fitting.align_principal_axes(d.points(spark, sf).select("point_id", "x", "y", (C("z") / 10).alias("z")), 0.5)


@query("robust_weighted_pca")
def robust_weighted_pca(spark, sf):
    return fitting.robust_weighted_pca(d.small_points(spark, sf))


@query("ball_counts", d.select_sql([d.SMALL], "SELECT a.point_id, count(*) AS inside FROM pts a, pts b WHERE (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.04 GROUP BY 1"))
def ball_counts(spark, sf):
    return fitting.ball_counts(joins.positions(d.small_points(spark, sf)), 0.2).select("point_id", C("inside").cast("bigint").alias("inside"))


@query("register_2d", d.select_sql([d.PTS], f"SELECT point_id, {Q('0.8 * x + 0.6 * y + 5', 5)} AS x, {Q('-0.6 * x + 0.8 * y - 3', 5)} AS y FROM pts"))
def register_2d(spark, sf):
    """Control pairs from the first cloud; the fitted motion moves all points."""
    pts = d.points(spark, sf)
    pairs = pts.where("cloud_id = 'A'").select("x", "y", (0.8 * C("x") + 0.6 * C("y") + 5).alias("wx"), (-0.6 * C("x") + 0.8 * C("y") - 3).alias("wy"))
    return fitting.apply_register_2d(pts, fitting.register_2d(pairs)).select("point_id", q("x", 5).alias("x"), q("y", 5).alias("y"))


@query("icp", d.select_sql([d.SMALL], f"SELECT point_id, {Q('x', 4)} AS x, {Q('y', 4)} AS y, {Q('z', 4)} AS z FROM pts"))
def icp(spark, sf):
    """A slightly turned and shifted copy finds its way back onto the cloud."""
    target = d.small_points(spark, sf)
    source = geometry.transform(target, geometry.rotation_euler(1, -1, 2), (0.01, -0.02, 0.015))
    rotation, shift, _ = fitting.icp(source, target)
    return geometry.transform(source, rotation, tuple(shift)).select("point_id", *(q(a, 4).alias(a) for a in "xyz"))


@query("corr_matrix", d.select_sql([d.RASTER], f"""SELECT a.col AS series_a, b.col AS series_b, {Q('corr(a.value, b.value)', 5)} AS corr FROM raster a JOIN raster b USING ("row") GROUP BY 1, 2"""))
def corr_matrix(spark, sf):
    """Days against days over the users."""
    s = d.raster(spark, sf).select(C("col").alias("series"), C("row").alias("pos"), "value")
    return fitting.corr_matrix(s, s).select("series_a", "series_b", q("corr", 5).alias("corr"))
