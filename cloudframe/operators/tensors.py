"""Covariance tensors as mergeable sums.

Everything here is a sum over rows, so it runs as partial and final hash aggregation: nothing is collected per group,
and a group of any size costs one row per task before the shuffle.  Coordinates are taken relative to a common shift
(the mean of the whole table is enough) so that the products do not lose digits far from the origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.functions.linalg import SYMMETRIC
from cloudframe.operators.joins import centre, every

C = F.col
PAIRS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def multiplicity(edges: DataFrame) -> Column:
    """How many points a row stands for: its ``m`` column, or one."""
    return C("m").cast("double") if "m" in edges.columns else F.lit(1.0)


def _sums(prefix: str, weight: Column) -> list[Column]:
    axes = {a: C(f"{prefix}{a}") for a in "xyz"}
    return ([F.sum(weight).alias("_w")]
            + [F.sum(weight * axes[a]).alias(f"_s{a}") for a in "xyz"]
            + [F.sum(weight * axes[a] * axes[b]).alias(f"_s{a}{b}") for a, b in PAIRS])


def _identity_below(df: DataFrame, min_points: int) -> DataFrame:
    """Fewer than ``min_points`` points: the covariance is the identity."""
    few = C("n") < min_points
    return df.withColumns({c: F.when(few, 1.0 if c in ("cxx", "cyy", "czz") else 0.0).otherwise(C(c)) for c in SYMMETRIC})


def moments(points: DataFrame, keys: list[str], weight: str | None = None, sample: bool = False,
            min_points: int = 3) -> DataFrame:
    """Tensor per group: ``n``, centroid ``cx, cy, cz`` and (weighted) covariance ``cxx .. czz`` about the centroid.

    Population covariance, or with ``sample`` the n-1 form.  Without weights one pass with Spark's own stable, mergeable
    covariance; weighted sums are taken about the mean of the table.  Without ``keys`` one row for the whole table.
    """
    if weight is None and "m" not in points.columns:
        covar = F.covar_samp if sample else F.covar_pop
        out = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"c{a}") for a in "xyz"),
                                        *(covar(a, b).alias(f"c{a}{b}") for a, b in PAIRS))
        return (_identity_below(out, min_points) if min_points else out).select(*keys, "n", "cx", "cy", "cz", *SYMMETRIC)
    w = C(weight) if weight else multiplicity(points)
    shift = points.agg(F.struct(*(F.avg(a).alias(a) for a in "xyz")).alias("s")).scalar()
    moved = points.withColumn("_shift", shift).withColumns({f"_d{a}": C(a) - C(f"_shift.{a}") for a in "xyz"})
    count = F.sum(C("m")) if "m" in points.columns else F.count(F.lit(1))
    totals = moved.groupBy(*keys).agg(count.cast("bigint").alias("n"), F.first("_shift").alias("_shift"),
                                      *_sums("_d", w))
    totals = totals.withColumns({f"_c{a}": F.try_divide(f"_s{a}", "_w") for a in "xyz"})
    scale = C("n") / F.when(C("n") > 1, C("n") - 1) if sample else F.lit(1.0)
    out = totals.withColumns({f"c{a}": C(f"_c{a}") + C(f"_shift.{a}") for a in "xyz"})
    out = out.withColumns({f"c{a}{b}": (F.try_divide(f"_s{a}{b}", "_w") - C(f"_c{a}") * C(f"_c{b}")) * scale for a, b in PAIRS})
    out = _identity_below(out, min_points) if min_points else out
    return out.select(*keys, "n", "cx", "cy", "cz", *SYMMETRIC)


def tensor_from_neighbors(edges: DataFrame, gaussian: bool = False, about: str = "center",
                          min_points: int = 3, points: DataFrame | None = None) -> DataFrame:
    """Tensor per ``point_id`` from its edges; the centre itself never counts.

    With ``points`` every point has a row: those without edges have ``n = 0`` and, like all below ``min_points``, the
    identity.

    ``about='center'`` takes the covariance about the point, ``'centroid'`` about the mean of the neighbours.  With
    ``gaussian`` a neighbour weighs ``exp(-d^2 / 2s^2) / sqrt(2 pi s^2)``, s = a third of the neighbourhood's mean radius;
    edges that carry it as ``sigma`` need no join.
    """
    m = multiplicity(edges)
    if gaussian:
        if "sigma" not in edges.columns:
            radius = neighborhood_stats(edges).select("point_id", (C("mean_radius") / 3).alias("sigma"))
            edges = edges.join(radius, "point_id")
        weight = m * gaussian_density(C("dist"), C("sigma"))
    else:
        weight = m
    sums = edges.groupBy(*centre(edges)).agg(F.sum(m).cast("bigint").alias("n"), *_sums("d", weight))
    sums = sums.withColumns({f"c{a}": F.try_divide(f"_s{a}", "_w") for a in "xyz"})
    if about == "center":
        out = sums.withColumns({f"c{a}{b}": F.try_divide(f"_s{a}{b}", "_w") for a, b in PAIRS})
    else:
        out = sums.withColumns({f"c{a}{b}": F.try_divide(f"_s{a}{b}", "_w") - C(f"c{a}") * C(f"c{b}") for a, b in PAIRS})
    if points is not None:
        out = every(points, out, n=0)
    return _identity_below(out, min_points).select("point_id", "n", "cx", "cy", "cz", *SYMMETRIC)


def gaussian_density(distance: Column, sigma: Column) -> Column:
    return F.exp(-distance * distance / (2 * sigma * sigma)) / F.sqrt(2 * F.pi() * sigma * sigma)


def merge_tensors(tensors: DataFrame, keys: list[str]) -> DataFrame:
    """Pool the tensors of each group: exact counts, centroids and covariances of the united point sets.

    ``n_tensors`` counts the merged tensors.
    """
    shift = tensors.agg(F.struct(*(F.avg(f"c{a}").alias(a) for a in "xyz")).alias("s")).scalar()
    moved = tensors.withColumn("_shift", shift).withColumns({f"_d{a}": C(f"c{a}") - C(f"_shift.{a}") for a in "xyz"})
    sums = moved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tensors"), F.sum("n").cast("bigint").alias("_n"), F.first("_shift").alias("_shift"),
        *(F.sum(C("n") * C(f"_d{a}")).alias(f"_s{a}") for a in "xyz"),
        *(F.sum(C("n") * (C(f"c{a}{b}") + C(f"_d{a}") * C(f"_d{b}"))).alias(f"_s{a}{b}") for a, b in PAIRS))
    sums = sums.withColumns({f"_c{a}": C(f"_s{a}") / C("_n") for a in "xyz"})
    return sums.select(*keys, "n_tensors", C("_n").alias("n"),
                       *((C(f"_c{a}") + C(f"_shift.{a}")).alias(f"c{a}") for a in "xyz"),
                       *((C(f"_s{a}{b}") / C("_n") - C(f"_c{a}") * C(f"_c{b}")).alias(f"c{a}{b}") for a, b in PAIRS))


def neighborhood_stats(edges: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Per point: neighbours ``n`` (centre left out) and ``mean_radius``, the mean distance with the centre's zero.

    With ``points`` those without edges have a row too: 0 and 0.
    """
    m = multiplicity(edges)
    sums = edges.groupBy(*centre(edges)).agg(F.sum(m).cast("bigint").alias("n"), F.sum(m * C("dist")).alias("_d"))
    out = sums.select("point_id", "n", (C("_d") / (C("n") + 1)).alias("mean_radius"))
    return out if points is None else every(points, out, n=0, mean_radius=0.0)


def average_neighborhood(edges: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Mean radius and whole-number mean size (centre counted) over all neighbourhoods; ``points`` may be positions with
    their multiplicity ``m``."""
    stats = neighborhood_stats(edges, points)
    if points is None or "m" not in points.columns:
        return stats.agg(F.avg("mean_radius").alias("mean_radius"), F.floor(F.avg(C("n") + 1)).cast("bigint").alias("mean_size"))
    stats = stats.join(points.select("point_id", "m"), "point_id")
    return stats.agg((F.sum(C("m") * C("mean_radius")) / F.sum("m")).alias("mean_radius"),
                     F.floor(F.sum(C("m") * (C("n") + 1)) / F.sum("m")).cast("bigint").alias("mean_size"))
