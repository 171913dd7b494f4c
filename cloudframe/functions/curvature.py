"""Measures derived from the principal curvatures k1 >= k2."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.functions.quantiles import normal_quantile

C = F.col
# Fill value of outliers in normalised curvature.
OUTLIER = 1.5


def mean_k(k1: Column, k2: Column) -> Column:
    return (k1 + k2) / 2


def gaussian_k(k1: Column, k2: Column) -> Column:
    return k1 * k2


def curvedness(k1: Column, k2: Column) -> Column:
    return F.sqrt((k1 * k1 + k2 * k2) / 2)


def shape_index(k1: Column, k2: Column) -> Column:
    """``atan2(k2 + k1, k2 - k1) / pi``; 0 where the curvatures are equal (within 1e-6)."""
    return F.when(F.abs(k1 - k2) >= 1e-6, F.atan2(k2 + k1, k2 - k1) / math.pi).otherwise(0.0)


def similarity_curvature(k1: Column, k2: Column) -> dict[str, Column]:
    """Ratio min/max of the absolute curvatures on two signed axes (``e``, ``h``) and its colour code ``r, g, b``.

    Same signs go to e (positive red, negative green); opposite signs go to h, positive (red and green) where k1 is the
    larger in size and negative (blue) where k2 is.
    """
    a, b = F.abs(k1), F.abs(k2)
    large = F.greatest(a, b)
    ratio = F.when(large > 0, F.least(a, b) / large)
    signs = F.signum(k1) + F.signum(k2)
    both_up, both_down = signs == 2, signs == -2
    mixed = (signs == 0) & (large > 0)
    k1_larger = mixed & (a >= b)
    k2_larger = mixed & (a < b)
    return {"e": F.when(both_up, ratio).when(both_down, -ratio).otherwise(0.0),
            "h": F.when(k1_larger, ratio).when(k2_larger, -ratio).otherwise(0.0),
            "r": F.when(both_up | k1_larger, ratio).otherwise(0.0),
            "g": F.when(both_down | k1_larger, ratio).otherwise(0.0),
            "b": F.when(k2_larger, ratio).otherwise(0.0)}


def normalize_curvature(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale to [-1, 1] over the values within three standard deviations of the mean; the others become 1.5."""
    stats = df.agg(F.struct(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")).alias("s")).scalar()
    df = df.withColumn("_s", stats)
    df = df.withColumn("_core", F.when(F.abs(C(column) - C("_s.mean")) <= 3 * C("_s.std"), C(column))).drop("_s")
    limits = df.agg(F.struct(F.min("_core").alias("lo"), F.max("_core").alias("hi")).alias("s")).scalar()
    df = df.withColumn("_s", limits)
    scaled = F.try_divide(2 * (C("_core") - C("_s.lo")), C("_s.hi") - C("_s.lo")) - 1
    return df.withColumn(out, F.when(C("_core").isNotNull(), scaled).when(C(column).isNotNull(), OUTLIER)).drop("_s", "_core")


def significance_zero(value: Column, mean: float = 0.0, std: float = 1.0, alpha: float = 0.05,
                      posonly: bool = False) -> Column:
    """0 where the value does not differ from ``mean`` at level ``alpha``; ``posonly`` also zeroes positive values."""
    z = normal_quantile(1 - alpha / 2)
    kept = F.when(F.abs((value - mean) / std) < z, 0.0).otherwise(value)
    return F.when(kept > 0, 0.0).otherwise(kept) if posonly else kept
