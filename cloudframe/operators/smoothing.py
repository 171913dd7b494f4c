"""Smoothing of points and values, voxels and uniform cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.operators.joins import centre
from cloudframe.operators.tensors import multiplicity
from cloudframe.ordering import global_rank

C = F.col
XYZ = ("x", "y", "z")


def extent(points: DataFrame, dims: tuple[str, ...] = XYZ) -> Column:
    """Smallest and largest coordinates as a struct column (``x_min, x_max, ..``), evaluated once per query."""
    return points.agg(F.struct(*(f(a).alias(f"{a}_{n}") for a in dims
                                 for f, n in ((F.min, "min"), (F.max, "max")))).alias("extent")).scalar()


def voxel_downsample(points: DataFrame, size: float, dims: tuple[str, ...] = XYZ) -> tuple[DataFrame, DataFrame]:
    """(points with their ``voxel`` key, one centroid per voxel with its size ``n``).

    Voxels start at the smallest coordinates.  The key is a text of the cell numbers, so no numbering pass is needed.
    """
    labelled = points.withColumn("_e", extent(points, dims))
    cells = [F.floor((C(a) - C(f"_e.{a}_min")) / size) for a in dims]
    labelled = labelled.withColumn("voxel", F.concat_ws("_", *(c.cast("string") for c in cells))).drop("_e")
    centroids = labelled.groupBy("voxel").agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(a) for a in XYZ))
    return labelled, centroids


def uniform_cells(points: DataFrame, size: float) -> DataFrame:
    """``row, col`` of XY cells from the lower left corner and a dense ``label`` in (row, col) order.

    Only the occupied cells are numbered, not the points.
    """
    placed = points.withColumn("_e", extent(points, ("x", "y")))
    placed = placed.withColumns({"row": F.floor((C("y") - C("_e.y_min")) / size).cast("int"),
                                 "col": F.floor((C("x") - C("_e.x_min")) / size).cast("int")}).drop("_e")
    labels = global_rank(placed.select("row", "col").distinct(), ["row", "col"], "label")
    return placed.join(labels.withColumn("label", C("label") - 1), ["row", "col"])


def smooth_within_cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """Replace z by the mean z of the cell (an aggregate and a join: a crowded cell never sits in one task)."""
    means = points.groupBy(*keys).agg(F.avg("z").alias("_z"))
    return points.join(means, keys).withColumn("z", C("_z")).drop("_z")


def smooth_mean_position(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Every point becomes the mean of its neighbourhood, itself included."""
    m = multiplicity(edges)
    sums = edges.groupBy(*centre(edges)).agg((F.sum(m) + 1).alias("_n"), *(F.sum(m * C(f"d{a}")).alias(f"_s{a}") for a in XYZ))
    joined = points.join(sums, "point_id", "left")
    return joined.select("point_id", *(F.coalesce(C(a) + C(f"_s{a}") / C("_n"), C(a)).alias(a) for a in XYZ))


def neighborhood_mean(value: Column, m: Column) -> Column:
    return F.sum(m * value) / F.sum(m)


def neighborhood_median(value: Column, m: Column) -> Column:
    """Median of a neighbourhood; a value that stands for many points enters once with its frequency."""
    return F.percentile(value, F.lit(0.5), m.cast("bigint"))


def smooth_property(values: DataFrame, edges: DataFrame, column: str,
                    operator: Callable[[Column, Column], Column] = neighborhood_mean) -> DataFrame:
    """Any aggregate of a column over each neighbourhood, the point itself included.

    ``values`` holds ``point_id`` and ``column``; ``operator(value, multiplicity)`` builds the aggregate.
    """
    m = multiplicity(edges)
    own = values.select("point_id", C(column).alias("_v"), F.lit(1.0).alias("_m"))
    near = (edges.select("point_id", "nid", m.alias("_m"))
            .join(values.select(C("point_id").alias("nid"), C(column).alias("_v")), "nid").select("point_id", "_v", "_m"))
    return own.union(near).groupBy("point_id").agg(operator(C("_v"), C("_m")).alias(column))


def smooth_range_gaussian(edges: DataFrame, sigma: float) -> DataFrame:
    """Gaussian mean of the range over an angular window (edges of ``spherical_neighbors``); ``sigma`` in radians."""
    squares = F.radians("daz") * F.radians("daz") + F.radians("del") * F.radians("del")
    w = multiplicity(edges) * F.exp(-squares / (2 * sigma * sigma))
    return edges.groupBy(*centre(edges)).agg((F.sum(w * C("nrange")) / F.sum(w)).alias("range")).select("point_id", "range")
