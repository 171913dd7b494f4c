"""Context saliency: a pixel is salient when even the pixels most like it, wherever they are, differ or lie far away.

Every pixel needs the ``k`` pixels of the whole image whose values are closest to its own.  Values are whole millionths of
the image's range, so there are a million at most, and pixels of equal value have the same closest ones: the search is per
value.  Of a value only its first ``k`` pixels can be chosen.  These are ranked by value in range partitions; the closest
of a value lie within ``2 k`` ranks of it, in the two or three blocks of ``2 k`` ranks around it, so a block meets a value
in an equi-join and no key holds more than a few ``k`` rows, however many pixels share a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.operators.raster import bounds, box_mean
from cloudframe.ordering import global_rank
from cloudframe.skew import salted

C = F.col
#: Steps into which the range of the smoothed image is divided (what single precision tells apart).
STEPS = 1_000_000
# Keeps the rounding of a value away from short decimals.
_TIE = 0.4876543


def value_steps(raster: DataFrame, size: int) -> DataFrame:
    """``row, col, _i, _v``: pixels with their number along the rows and their mean over ``size x size`` cells in steps."""
    smooth = raster.select("row", "col", "value") if size == 1 else box_mean(raster, size, size, border="reflect")
    smooth = smooth.where("value IS NOT NULL")
    stats = smooth.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("s")).scalar()
    placed = smooth.withColumns({"_s": stats, "_b": bounds(raster)})
    number = (C("row") - C("_b.r0")).cast("bigint") * (C("_b.c1") - C("_b.c0") + 1) + (C("col") - C("_b.c0"))
    step = F.floor(F.coalesce(F.try_divide(C("value") - C("_s.lo"), C("_s.hi") - C("_s.lo")), F.lit(0.0)) * STEPS + _TIE)
    return placed.select("row", "col", number.alias("_i"), step.cast("bigint").alias("_v"))


def closest_values(pixels: DataFrame, k: int) -> DataFrame:
    """``_v, _near``: for each value the ``k`` pixels with the closest values (ties: the first pixels), as an array."""
    first = pixels.withColumn("_no", F.row_number().over(Window.partitionBy("_v").orderBy("_i"))).where(C("_no") <= k)
    ranked = global_rank(first.drop("_no"), ["_v", "_i"], "_at")
    span = cut_lineage(ranked.groupBy("_v").agg(F.min("_at").alias("_s"), F.max("_at").alias("_e")))
    block = 2 * k
    offered = ranked.join(span.withColumnsRenamed({"_s": "_ws", "_e": "_we"}), "_v").withColumnRenamed("_v", "_w")
    offered = offered.withColumn("_b", F.floor(C("_at") / block))
    asked = span.withColumn("_b", F.explode(F.sequence(F.floor((C("_s") - block) / block), F.floor((C("_e") + block) / block))))
    # All pixels of a value are offered if fewer than k lie between; ties take the first of either side.
    met = asked.join(offered, "_b").where((C("_we") >= C("_s") - k) & (C("_ws") <= C("_e") + k))
    met = met.withColumn("d", F.abs(C("_v") - C("_w")))
    met = met.withColumn("_no", F.row_number().over(Window.partitionBy("_v").orderBy("d", "_i"))).where(C("_no") <= k)
    return met.groupBy("_v").agg(F.collect_list(F.struct("row", "col", "d")).alias("_near"))


def context_of_scale(raster: DataFrame, size: int, k: int, constant: float) -> DataFrame:
    """``row, col, saliency`` at one patch size.

    Every ``size // 2``-th pixel is judged: ``1 - exp(-mean(d / (1 + constant * distance)))`` over its ``k`` closest.  A
    pixel has the value of the last judged pixel that is itself or has it among its closest, 0 without any.
    """
    pixels = cut_lineage(value_steps(raster, size))
    none = pixels.select("row", "col", F.lit(-1).cast("bigint").alias("_i"), F.lit(0.0).alias("s"))
    if size // 2 == 0:
        return none.select("row", "col", C("s").alias("saliency"))
    near = cut_lineage(closest_values(pixels, k))
    judged = pixels.where(C("_i") % (size // 2) == 0)
    left, right, on = salted(judged, near, ["_v"], C("_i"), C("_v"), count="left")
    part = lambda n: n["d"] / float(STEPS) / (1 + constant * F.sqrt((C("row") - n["row"]) * (C("row") - n["row"])
                                                                    + (C("col") - n["col"]) * (C("col") - n["col"])))
    mean = F.aggregate(F.transform("_near", part), F.lit(0.0), lambda total, x: total + x) / F.size("_near")
    judged = cut_lineage(left.join(right, on).select("row", "col", "_i", "_v", (1 - F.exp(-mean)).alias("s")))
    # Judged pixels of one value hand their value to the same pixels: only the last of them counts.
    last = judged.groupBy("_v").agg(F.max(F.struct("_i", "s")).alias("_l"))
    handed = last.join(near, "_v").select(F.explode("_near").alias("_n"), "_l").select("_n.row", "_n.col", "_l._i", "_l.s")
    told = none.union(judged.select("row", "col", "_i", "s")).union(handed)
    return told.groupBy("row", "col").agg(F.max(F.struct("_i", "s")).alias("_l")).select("row", "col", C("_l.s").alias("saliency"))


def context_saliency(raster: DataFrame, scale: int, scales: int = 4, k: int = 64, constant: float = 3.0) -> DataFrame:
    """``row, col, value``: mean saliency over the patch sizes ``scale, scale / 2, ..`` (those that are at least one pixel).

    Voids have no row.
    """
    sizes = [size for size in (int(scale * 2.0 ** -n) for n in range(scales)) if size]
    if not sizes:
        raise ValueError("the scale is below one pixel")
    parts = [context_of_scale(raster, size, k, constant) for size in sizes]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union.groupBy("row", "col").agg((F.sum("saliency") / len(sizes)).alias("value"))
