"""Curvature and saliency of uniform cells, given back to the points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cloudframe.functions import linalg
from cloudframe.lineage import cut_lineage
from cloudframe.operators import saliency, smoothing, tensors

C = F.col


def cellwise_umbrella_curvature(points: DataFrame, cell: float, phenomenon: float, valid_sectors: int = 7,
                                curvature_std: float = 0.05) -> DataFrame:
    """``point_id, curvature, saliency`` from cell centroids (0 for points of cells with too few populated sectors)."""
    buffer = max(1, int(math.ceil(phenomenon / cell) / 2))
    labelled = cut_lineage(smoothing.uniform_cells(points, cell))
    cells = labelled.groupBy("label").agg(F.first("row").alias("row"), F.first("col").alias("col"),
                                          *(F.avg(a).alias(a) for a in "xyz"))
    cells = cut_lineage(cells)
    edges, sectors = saliency.cell_neighbors_8sector(cells, buffer)
    there = cells.select(C("label").alias("nlabel"), *(C(a).alias(f"_t{a}") for a in "xyz"))
    deltas = (edges.join(there, "nlabel").join(cells.select("label", "x", "y", "z"), "label")
              .select(C("label").alias("point_id"), *((C(f"_t{a}") - C(a)).alias(f"d{a}") for a in "xyz")))
    deltas = deltas.withColumn("dist", linalg.norm([C("dx"), C("dy"), C("dz")]))
    axes = linalg.with_eigen(tensors.tensor_from_neighbors(deltas)).withColumnRenamed("point_id", "label")
    up = F.when(C("plate")[2] < 0, -1.0).otherwise(1.0)
    normals = axes.select("label", *((up * C("plate")[i]).alias(n) for i, n in enumerate(("nx", "ny", "nz"))))
    values = saliency.cell_umbrella_curvature(edges, cells, normals)
    values = (cells.select("label").join(values, "label", "left").join(sectors, "label", "left")
              .withColumn("valid", F.coalesce(C("sectors") >= valid_sectors, F.lit(False))))
    k = F.when(C("valid") & (F.abs("curvature") >= curvature_std), C("curvature")).otherwise(0.0)
    values = cut_lineage(values.select("label", "valid", k.alias("curvature")))
    wide, _ = saliency.cell_neighbors_8sector(cells, int(buffer * 1.5))
    scores = saliency.cell_saliency(wide, values, buffer)
    per_cell = values.join(scores, "label").select(
        "label", "curvature", F.when(C("valid"), C("saliency")).otherwise(0.0).alias("saliency"))
    return labelled.select("point_id", "label").join(per_cell, "label").select("point_id", "curvature", "saliency")
