"""Connected components by alternating stars (Kiveris et al. 2014), safe for stars of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm.common import C, summary_by_group


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the smallest node of the component."""
    def state(links):
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(links)) != before:
        before = now
        both = links.unionByName(links.select(C("b").alias("a"), C("a").alias("b")))
        large = (summary_by_group(both, ["a"], ["b"], {"m": ("min", "b")}).where("b > a")
                 .select(C("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct())
        small = summary_by_group(large, ["a"], ["b"], {"m": ("min", "b")})
        small = small.select(F.explode(F.array(F.struct("a", C("m").alias("b")), F.struct(C("b").alias("a"), C("m").alias("b")))).alias("e"))
        links = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct())
    nodes = links.select(C("a").alias("node"), C("b").alias("root"))
    return nodes.unionByName(links.select(C("b").alias("node"), C("b").alias("root")).distinct())
