"""Curves: ordered vertices ``curve_id, seq (0, 1, ..), x, y[, z]``.

A curve may be arbitrarily long, so no window spans a whole curve: vertices are cut into blocks of consecutive ``seq``,
a block carries copies of the few vertices it needs from its neighbours, and running sums add the totals of the blocks
before.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloudframe.functions.geometry import point_line_distance
from cloudframe.lineage import cut_lineage

C = F.col
BLOCK = 65_536
#: Rounds whose vertices are put together at a time.
ROUNDS = 16


def _dims(curves: DataFrame) -> list[str]:
    return [d for d in "xyz" if d in curves.columns]


def _distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def with_halo(curves: DataFrame, before: int, after: int, block: int = BLOCK) -> tuple[DataFrame, Window]:
    """Vertices by block with ``before`` / ``after`` copies from the neighbours, and the window over a block.

    ``_core`` marks the block's own vertices; frames that stay inside the halo see exactly what they would see on the
    whole curve.
    """
    first, last = F.floor((C("seq") - after) / block), F.floor((C("seq") + before) / block)
    out = curves.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    out = out.withColumn("_core", F.floor(C("seq") / block) == C("_block"))
    return out, Window.partitionBy("curve_id", "_block").orderBy("seq")


def _core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_block", "_core")


def running_sum(curves: DataFrame, column: str, out: str, block: int = BLOCK) -> DataFrame:
    """Running sum along each curve: inside blocks by window, plus the totals of the blocks before."""
    cut = curves.withColumn("_block", F.floor(C("seq") / block))
    totals = cut.groupBy("curve_id", "_block").agg(F.sum(column).alias("_t"))  # one row per block
    earlier = Window.partitionBy("curve_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("curve_id", "_block", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy("curve_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(out, F.sum(column).over(inside)).join(offsets, ["curve_id", "_block"]).withColumn(
        out, C(out) + C("_before")).drop("_block", "_before")


def arc_length(curves: DataFrame) -> DataFrame:
    """Add ``cdf`` (length so far), ``length`` (of the curve) and ``t = cdf / length``."""
    dims = _dims(curves)
    halo, w = with_halo(curves, 0, 1)
    step = _distance([C(d) for d in dims], [F.lag(d).over(w) for d in dims])
    steps = _core(halo.withColumn("_step", F.coalesce(step, F.lit(0.0))))
    out = running_sum(steps, "_step", "cdf").drop("_step")
    lengths = out.groupBy("curve_id").agg(F.max("cdf").alias("length"))
    return out.join(lengths, "curve_id").withColumn("t", C("cdf") / F.when(C("length") > 0, C("length")))


def chord_length(curves: DataFrame, eps: float = 0.05) -> DataFrame:
    """Distance from start to end and ``closed`` (distance below ``eps``)."""
    dims = _dims(curves)
    place = F.struct(*dims)
    ends = curves.groupBy("curve_id").agg(F.min_by(place, "seq").alias("_a"), F.max_by(place, "seq").alias("_b"))
    gap = _distance([C(f"_a.{d}") for d in dims], [C(f"_b.{d}") for d in dims])
    return ends.select("curve_id", gap.alias("chord"), (gap < eps).alias("closed"))


def reclassify_outlines(curves: DataFrame, eps: float) -> DataFrame:
    """``polygon`` where the closing gap is below ``eps``, else ``line``."""
    return chord_length(curves, eps).select("curve_id", F.when(C("closed"), "polygon").otherwise("line").alias("kind"))


def _frenet(df: DataFrame, dims: list[str], before: str, here: str, after: str, spacing: Column) -> DataFrame:
    """Tangent, normal direction and curvature from three struct columns (coordinates and cdf) and their mean spacing."""
    out = df.withColumns({f"t{d}": F.try_divide(C(f"{after}.{d}") - C(f"{before}.{d}"), C(f"{after}.cdf") - C(f"{before}.cdf")) for d in dims})
    out = out.withColumn("_h", spacing).withColumns({
        f"_n{d}": F.try_divide(C(f"{after}.{d}") - 2 * C(f"{here}.{d}") + C(f"{before}.{d}"), C("_h") * C("_h")) for d in dims})
    size = F.sqrt(sum((C(f"_n{d}") * C(f"_n{d}") for d in dims[1:]), C(f"_n{dims[0]}") * C(f"_n{dims[0]}")))
    out = out.withColumn("curvature", size)
    return out.withColumns({f"n{d}": F.when(C("curvature") > 0, C(f"_n{d}") / C("curvature")) for d in dims})


def tangent_normal(curves: DataFrame) -> DataFrame:
    """Tangent, unit normal, binormal (3-D) and curvature from direct neighbours.

    Central differences inside, forward at the start and backward at the end (first differences over one step, second
    differences over two).
    """
    dims = _dims(curves)
    halo, w = with_halo(arc_length(curves).drop("t"), 2, 2)
    v = F.struct(*dims, "cdf")
    near = halo.withColumns({"_0": v, "_p": F.lag(v).over(w), "_n": F.lead(v).over(w), "_pp": F.lag(v, 2).over(w), "_nn": F.lead(v, 2).over(w)})
    near = _core(near)
    first, last = C("_p").isNull(), C("_n").isNull()
    near = near.withColumns({"_a": F.when(first, C("_0")).when(last, C("_pp")).otherwise(C("_p")),
                             "_b": F.when(first, C("_n")).when(last, C("_p")).otherwise(C("_0")),
                             "_c": F.when(first, C("_nn")).when(last, C("_0")).otherwise(C("_n"))})
    near = _frenet(near, dims, "_a", "_b", "_c", (C("_c.cdf") - C("_a.cdf")) / 2)
    one = lambda a, b, d: F.try_divide(C(f"{b}.{d}") - C(f"{a}.{d}"), C(f"{b}.cdf") - C(f"{a}.cdf"))
    near = near.withColumns({f"t{d}": F.when(first & ~last, one("_0", "_n", d)).when(last & ~first, one("_p", "_0", d)).otherwise(C(f"t{d}")) for d in dims})
    binormal = []
    if len(dims) == 3:
        from cloudframe.functions.linalg import cross
        binormal = [e.alias(f"b{d}") for d, e in zip(dims, cross([C(f"t{d}") for d in dims], [C(f"n{d}") for d in dims]))]
    return near.select("curve_id", "seq", *(f"t{d}" for d in dims), *(f"n{d}" for d in dims), *binormal, "curvature")


def _at_arc(cdf: DataFrame, step: float, band: float | None = None) -> DataFrame:
    """Add ``_p`` / ``_n``: vertices at least ``step`` before / after along the curve (nearest such; at most ``band``
    further).  Equi-join on buckets of arc length: a vertex looks into the buckets its limits fall in and the next ones
    that hold a vertex."""
    dims = _dims(cdf)
    v = F.struct("cdf", "seq", *dims)
    bucket = lambda e: F.floor(e / step)
    reach = step + (band or step)
    spans = math.ceil(reach / step) + 1
    other = cdf.select("curve_id", bucket(C("cdf")).alias("_b"), v.alias("_o"))
    def side(name, sign):
        look = F.sequence(F.lit(0), F.lit(spans)) if sign > 0 else F.sequence(F.lit(-spans), F.lit(0))
        asked = cdf.select("curve_id", "seq", C("cdf").alias("_here"), F.explode(look).alias("_k")).withColumn("_b", bucket(C("_here")) + C("_k"))
        gap = sign * (C("_o.cdf") - C("_here"))
        found = asked.join(other, ["curve_id", "_b"]).where((gap >= step) & (gap <= reach))
        best = F.min("_o") if sign > 0 else F.max("_o")
        return found.groupBy("curve_id", "seq").agg(best.alias(name))
    out = cdf.join(side("_p", -1), ["curve_id", "seq"], "left").join(side("_n", 1), ["curve_id", "seq"], "left")
    return out


def tangent_normal_by_arc(curves: DataFrame, step: float, reach: float) -> DataFrame:
    """Central tangent and curvature over vertices at least ``step`` (at most ``step + reach``) away along the curve."""
    dims = _dims(curves)
    near = _at_arc(arc_length(curves).drop("t", "length"), step, reach).where(C("_p").isNotNull() & C("_n").isNotNull())
    near = near.withColumn("_0", F.struct(*dims, "cdf"))
    near = _frenet(near, dims, "_p", "_0", "_n", (C("_n.cdf") - C("_p.cdf")) / 2)
    return near.select("curve_id", "seq", *(f"t{d}" for d in dims), *(f"n{d}" for d in dims), "curvature")


def curve_curvature_3pt(curves: DataFrame, step: float, tolerance: float = 0.05) -> DataFrame:
    """``4 A / (a b c)`` of the vertex and the vertices ``step`` (within ``tolerance``) before and after; 0 without them."""
    dims = _dims(curves)
    near = _at_arc(arc_length(curves).drop("t", "length"), step - tolerance, 2 * tolerance)
    p, o, n = ([C(f"{s}.{d}") if s else C(d) for d in dims] for s in ("_p", "", "_n"))
    a, b, c = _distance(n, o), _distance(p, n), _distance(o, p)
    near = near.withColumns({"_la": a, "_lb": b, "_lc": c})
    half = (C("_la") + C("_lb") + C("_lc")) / 2
    area = F.sqrt(F.greatest(F.lit(0.0), half * (half - C("_la")) * (half - C("_lb")) * (half - C("_lc"))))
    return near.select("curve_id", "seq", F.coalesce(4 * area / F.when(C("_la") * C("_lb") * C("_lc") > 0, C("_la") * C("_lb") * C("_lc")), F.lit(0.0)).alias("curvature"))


def resample_curve(curves: DataFrame, step: float) -> DataFrame:
    """Points every ``step`` along each curve (linear interpolation) and its last vertex: ``curve_id, tau, x, y[, z]``.

    Each segment makes its own samples, so nothing is joined.
    """
    dims = _dims(curves)
    halo, w = with_halo(arc_length(curves).drop("t"), 1, 0)
    seg = _core(halo.withColumns({f"_n{d}": F.lead(d).over(w) for d in (*dims, "cdf")}))
    low, high = F.ceil(C("cdf") / step), F.ceil(C("_ncdf") / step) - 1
    inner = seg.where(C("_ncdf").isNotNull() & (low <= high)).withColumn("_k", F.explode(F.sequence(low, high)))
    f = (C("_k") * step - C("cdf")) / (C("_ncdf") - C("cdf"))
    samples = inner.select("curve_id", (C("_k") * step).alias("tau"), *((C(d) + f * (C(f"_n{d}") - C(d))).alias(d) for d in dims))
    ends = seg.where(C("_ncdf").isNull()).select("curve_id", C("cdf").alias("tau"), *dims)
    return samples.unionByName(ends)


def curve_derivatives_closed(curves: DataFrame) -> DataFrame:
    """Central first and second differences per vertex with wrap-around, over the length of the step that follows
    (the mean step for the last vertex)."""
    dims = _dims(curves)
    v = F.struct(*dims)
    ends = curves.groupBy("curve_id").agg(F.min_by(v, "seq").alias("_first"), F.max_by(v, "seq").alias("_last"), F.count(F.lit(1)).alias("_n"))
    whole = arc_length(curves).drop("t")
    halo, w = with_halo(whole, 1, 1)
    near = _core(halo.withColumns({"_p": F.lag(v).over(w), "_q": F.lead(v).over(w), "_cn": F.lead("cdf").over(w)})).join(ends, "curve_id")
    near = near.withColumns({"_p": F.coalesce("_p", "_last"), "_q": F.coalesce("_q", "_first"),
                             "_h": F.coalesce(C("_cn") - C("cdf"), C("length") / F.when(C("_n") > 1, C("_n") - 1))})
    h = F.when(C("_h") > 0, C("_h"))
    return near.select("curve_id", "seq", *(((C(f"_q.{d}") - C(f"_p.{d}")) / (2 * h)).alias(f"d{d}") for d in dims),
                       *(((C(f"_q.{d}") + C(f"_p.{d}") - 2 * C(d)) / (h * h)).alias(f"d2{d}") for d in dims))


def curve_smoothing(curves: DataFrame, step: int) -> DataFrame:
    """Inverse-distance mean of the ``step`` vertices on both sides; the first and last ``step`` vertices stay."""
    dims = _dims(curves)
    halo, w = with_halo(curves, step, step)
    v = F.struct(*dims)
    names = [f"_{s}{i}" for i in range(1, step + 1) for s in "pn"]
    near = halo.withColumns({f"_{s}{i}": f(v, i).over(w) for i in range(1, step + 1) for s, f in (("p", F.lag), ("n", F.lead))})
    near = _core(near)
    weights = {n: F.try_divide(F.lit(1.0), _distance([C(f"{n}.{d}") for d in dims], [C(d) for d in dims])) for n in names}
    near = near.withColumns({f"_w{n}": e for n, e in weights.items()})
    total = sum((C(f"_w{n}") for n in names[1:]), C(f"_w{names[0]}"))
    moved = lambda d: C(d) + sum((C(f"_w{n}") * (C(f"{n}.{d}") - C(d)) for n in names[1:]), C(f"_w{names[0]}") * (C(f"{names[0]}.{d}") - C(d))) / total
    return near.select("curve_id", "seq", *(F.coalesce(moved(d), C(d)).alias(d) for d in dims))


def thin_curve(curves: DataFrame, step: float) -> DataFrame:
    """Keep the first vertex and then, again and again, the next one at least ``step`` further along the curve.

    The next kept vertex of *every* vertex is known at once; which vertices are reached from the start is found by
    doubling the jumps, in log2(longest curve) rounds instead of one walk per curve.
    """
    cdf = arc_length(curves).select("curve_id", "seq", "cdf")
    # The next vertex at or beyond cdf + step lies in the target's own bucket of length or opens a later bucket; every
    # bucket on the way (occupied or just aimed at) knows the first vertex behind it.
    bucket = lambda e: F.floor(e / step)
    want = cdf.withColumns({"_t": C("cdf") + step, "_b": bucket(C("cdf") + step)})
    placed = cdf.select("curve_id", bucket(C("cdf")).alias("_b"), "seq", "cdf")
    near = (want.select("curve_id", "_b", C("seq").alias("_from"), "_t").join(placed, ["curve_id", "_b"])
            .where(C("cdf") >= C("_t")).groupBy("curve_id", "_from").agg(F.min("seq").alias("_to")))
    marks = placed.groupBy("curve_id", "_b").agg(F.min("seq").alias("_first")).unionByName(
        want.select("curve_id", "_b", F.lit(None).cast("bigint").alias("_first"))).groupBy("curve_id", "_b").agg(F.min("_first").alias("_first"))
    ahead = Window.partitionBy("curve_id").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    marks = marks.withColumn("_far", F.min("_first").over(ahead)).drop("_first")  # one row per bucket, not per vertex
    reach = want.select("curve_id", "_b", C("seq").alias("_from")).join(marks, ["curve_id", "_b"]).drop("_b")
    jumps = (cdf.select("curve_id", C("seq").alias("_from")).join(near, ["curve_id", "_from"], "left").join(reach, ["curve_id", "_from"], "left")
             .select("curve_id", "_from", F.coalesce("_to", "_far").alias("_to")).where(C("_to").isNotNull()))
    jumps = cut_lineage(jumps)
    kept = curves.select("curve_id", F.lit(0).cast("bigint").alias("_at")).distinct()
    while not jumps.isEmpty():
        moved = kept.withColumnRenamed("_at", "_from").join(jumps, ["curve_id", "_from"]).select("curve_id", C("_to").alias("_at"))
        kept = cut_lineage(kept.union(moved).distinct())
        nxt = jumps.select("curve_id", C("_from").alias("_at2"), C("_to").alias("_mid")).join(
            jumps.select("curve_id", C("_from").alias("_mid"), "_to"), ["curve_id", "_mid"])
        jumps = cut_lineage(nxt.select("curve_id", C("_at2").alias("_from"), "_to"))
    return curves.join(kept.withColumnRenamed("_at", "seq"), ["curve_id", "seq"], "left_semi")


def simplify_curve(curves: DataFrame, epsilon: float) -> DataFrame:
    """Douglas-Peucker: all open pieces of all curves are split at their farthest vertex in the same round.

    A round is one map-side combined aggregation per piece and a join back; pieces within ``epsilon`` drop out, so the
    work shrinks from round to round.
    """
    v = F.struct("seq", "x", "y")
    ends = curves.groupBy("curve_id").agg(F.min_by(v, "seq").alias("_a"), F.max_by(v, "seq").alias("_b"))
    kept = [ends.select("curve_id", C("_a.seq").alias("seq")).union(ends.select("curve_id", C("_b.seq"))).distinct()]
    open_ = cut_lineage(curves.select("curve_id", "seq", "x", "y").join(ends, "curve_id").where((C("seq") > C("_a.seq")) & (C("seq") < C("_b.seq"))))
    while not open_.isEmpty():
        far = point_line_distance([C("x"), C("y")], [C("_a.x"), C("_a.y")], [C("_b.x"), C("_b.y")])
        # The first of the farthest vertices splits the piece.
        split = open_.withColumn("_d", far).groupBy("curve_id", C("_a.seq").alias("_s")).agg(
            F.max(F.struct("_d", (-C("seq")).alias("k"), v.alias("v"))).alias("_m")).where((C("_m._d") >= epsilon) & (C("_m._d") > 0))
        split = cut_lineage(split.select("curve_id", "_s", C("_m.v").alias("_v")))
        kept.append(split.select("curve_id", C("_v.seq")))
        if len(kept) == ROUNDS:
            kept = [cut_lineage(functools.reduce(DataFrame.union, kept))]
        joined = open_.withColumn("_s", C("_a.seq")).join(split, ["curve_id", "_s"]).where(C("seq") != C("_v.seq"))
        left = C("seq") < C("_v.seq")
        open_ = cut_lineage(joined.select("curve_id", "seq", "x", "y", F.when(left, C("_a")).otherwise(C("_v")).alias("_a"),
                                          F.when(left, C("_v")).otherwise(C("_b")).alias("_b")))
    return curves.join(functools.reduce(DataFrame.union, kept), ["curve_id", "seq"], "left_semi")


def curve_cross_correlation(a: DataFrame, b: DataFrame, pairs: DataFrame, max_lag: int) -> DataFrame:
    """Sum of products per pair (``id_a, id_b``), lag and axis, for lags up to ``max_lag`` vertices.

    Vertices meet on (pair, seq + lag): an equi-join on unique keys, reduced before the shuffle.
    """
    dims = _dims(a)
    lhs = pairs.join(a.select(C("curve_id").alias("id_a"), C("seq").alias("_s"), *(C(d).alias(f"_a{d}") for d in dims)), "id_a")
    lhs = lhs.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("_s", C("_s") + C("lag"))
    rhs = b.select(C("curve_id").alias("id_b"), C("seq").alias("_s"), *(C(d).alias(f"_b{d}") for d in dims))
    return lhs.join(rhs, ["id_b", "_s"]).groupBy("id_a", "id_b", "lag").agg(*(F.sum(C(f"_a{d}") * C(f"_b{d}")).alias(f"corr_{d}") for d in dims))


def shorter_curve(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Order each pair by length: ``shorter, longer`` (the first when equal)."""
    j = pairs.join(lengths.select(C("curve_id").alias("id_a"), C("length").alias("_la")), "id_a").join(
        lengths.select(C("curve_id").alias("id_b"), C("length").alias("_lb")), "id_b")
    return j.select("id_a", "id_b", F.when(C("_la") <= C("_lb"), C("id_a")).otherwise(C("id_b")).alias("shorter"),
                    F.when(C("_la") <= C("_lb"), C("id_b")).otherwise(C("id_a")).alias("longer"))
