"""Global order without a single task: ranks, running sums and percentiles of whole tables.

A window without partition keys would pull the table into one task.  Here the table is range-partitioned by its order,
each partition is summed on its own, and the (few) partition totals are added as offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloudframe.lineage import cut_lineage

C = F.col


def global_running_sum(df: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows up to and including this one, in ``order``.

    ``order`` must identify a row, so that no value fills a partition of its own.  The range partitions are
    materialised, because their bounds are sampled and must not change between the two uses.
    """
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_weight", weight)
    placed = cut_lineage(placed)
    parts = placed.groupBy("_part").agg(F.sum("_weight").alias("_total"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, C("_before") + F.sum("_weight").over(inside)).drop("_part", "_weight", "_before"))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add the 1-based rank of every row in ``order`` (which must identify a row)."""
    return global_running_sum(df, order, F.lit(1).cast("bigint"), name)


def percentile(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row ``p0, p1, ..``: percentiles of a whole column with linear interpolation (exact).

    Equal values are counted before they are ordered, so a value shared by many rows is one row.
    """
    values = (df.where(C(column).isNotNull()).groupBy(C(column).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    ranked = global_running_sum(values, ["_v"], C("_n"), "_upto")
    total = ranked.agg(F.max("_upto")).scalar()
    ranked = ranked.withColumn("_total", total)
    picks = []
    for i, share in enumerate(shares):
        position = F.lit(share) * (C("_total") - 1)
        low = F.min(F.when(C("_upto") > F.floor(position), C("_v")))
        high = F.min(F.when(C("_upto") > F.ceil(position), C("_v")))
        part = F.max(position - F.floor(position))
        picks.append((low + (high - low) * part).alias(f"p{i}"))
    return ranked.agg(*picks)


def worst_mean(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row ``w0, w1, ..``: mean of the ``ceil(share * n)`` largest values for each share."""
    values = df.groupBy(C(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_running_sum(values, ["_v"], C("_n"), "_upto")
    ranked = ranked.withColumn("_total", ranked.agg(F.max("_upto")).scalar())
    means = []
    for i, share in enumerate(shares):
        size = F.ceil(F.lit(share) * C("_total"))
        # How many of the rows with this value are among the largest `size`.
        taken = F.greatest(F.lit(0), F.least(C("_n"), C("_upto") - (C("_total") - size)))
        means.append((F.sum(taken * C("_v")) / F.sum(taken)).alias(f"w{i}"))
    return ranked.agg(*means)
