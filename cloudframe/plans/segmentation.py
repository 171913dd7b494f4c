"""Points -> surface elements -> similarity graph -> segments -> labels of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.operators import graph, segments
from cloudframe.skew import lookup

C = F.col


def surface_segments(points: DataFrame, leaf_size: int, smallest: float, neighbors: int, variance: float, normal_difference: float,
                     distance: float, linearity: float = 5.0, dominant: int = 10, small: int = 5) -> DataFrame:
    """``point_id, element, segment``: hierarchical segmentation with dissolved and merged segments."""
    elements = cut_lineage(segments.adaptive_cells(points, leaf_size, smallest).withColumnRenamed("cell", "key"))
    tensors = cut_lineage(segments.tensors_of(elements, "key"))
    similarity = cut_lineage(segments.similarity_graph(tensors, neighbors, variance, normal_difference, distance, linearity))
    found = cut_lineage(segments.tensor_components(tensors, similarity))
    links = similarity.select(C("a").alias("point_id"), C("b").alias("nid"))
    def adjacency(current):
        return graph.segment_adjacency(current.select(C("key").alias("point_id"), C("segment").alias("label")), links)
    dissolved = cut_lineage(segments.dissolve_entrapped(tensors, found, adjacency(found), dominant, small, variance, distance))
    merged = segments.merge_dominant(tensors, dissolved, adjacency(dissolved), dominant)
    return lookup(elements.select("point_id", C("key").alias("element")), merged.withColumnRenamed("key", "element"), ["element"])
