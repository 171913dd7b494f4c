"""Selections, updates, set operations and grid statistics of point tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloudframe.functions import linalg
from cloudframe.operators.smoothing import extent
from cloudframe.operators.tensors import PAIRS, moments
from cloudframe.lineage import cut_lineage
from cloudframe.ordering import global_rank
from cloudframe.skew import lookup, salted

C = F.col


# --- selections -------------------------------------------------------------------------------------------------------

def subset(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Points whose id is listed."""
    return points.join(ids.select("point_id"), "point_id", "left_semi")


def difference_rows(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Points whose id is not listed."""
    return points.join(ids.select("point_id"), "point_id", "left_anti")


def update_fields(points: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Overwrite ``fields`` by the non-null values of ``updates`` (keyed by ``point_id``)."""
    new = updates.select("point_id", *(C(f).alias(f"_new_{f}") for f in fields))
    joined = points.join(new, "point_id", "left")
    return joined.withColumns({f: F.coalesce(C(f"_new_{f}"), C(f)) for f in fields}).drop(*(f"_new_{f}" for f in fields))


def swap_axes(points: DataFrame) -> DataFrame:
    """x, z, y order."""
    return points.withColumns({"y": C("z"), "z": C("y")})


def fields_dimension(points: DataFrame, fields: tuple[str, ...] = ("x", "y", "z", "intensity", "r", "g", "b")) -> int:
    return sum(f in points.columns for f in fields)


def size(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n"))


def bounding_box_filter(points: DataFrame, **limits: float | None) -> DataFrame:
    """Add ``keep`` and ``segment`` (0 kept, 1 rest) for the inclusive box xmin .. zmax; missing limits do not bound."""
    keep = F.lit(True)
    for a in "xyz":
        if limits.get(f"{a}min") is not None:
            keep = keep & (C(a) >= limits[f"{a}min"])
        if limits.get(f"{a}max") is not None:
            keep = keep & (C(a) <= limits[f"{a}max"])
    return points.withColumn("keep", keep).withColumn("segment", F.when(C("keep"), 0).otherwise(1))


def spherical_filter(points: DataFrame, **limits: float | None) -> DataFrame:
    """Add ``keep`` and ``segment`` for inclusive limits ``az_min, az_max, el_min, el_max, range_min, range_max``."""
    keep = F.lit(True)
    for name in ("az", "el", "range"):
        low, high = limits.get(f"{name}_min"), limits.get(f"{name}_max")
        keep = keep & (C(name) >= low) if low is not None else keep
        keep = keep & (C(name) <= high) if high is not None else keep
    return points.withColumn("keep", keep).withColumn("segment", F.when(C("keep"), 0).otherwise(1))


def window_filter(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    return points.where(C("x").between(xmin, xmax) & C("y").between(ymin, ymax))


def slope_ground_filter(points: DataFrame, radius: float, slope: float) -> DataFrame:
    """Add ``segment``: 1 (not ground) if a lower point within the XY radius lies below a slope steeper than ``slope``
    degrees, else 0.

    Only the lowest z of each XY place can decide, so crowded places are folded to one row on both sides before the join.
    Its output becomes one height limit per place on the map side; a point above the limit of its place is not ground.
    """
    lows = points.groupBy("x", "y").agg(F.min("z").alias("_z"), F.max("z").alias("_top"))
    keys = ["_c0", "_c1"]
    cell = lambda a: F.floor(C(a) / F.lit(radius))
    lhs = lows.select("x", "y", "_top")
    for i, a in enumerate("xy"):
        lhs = lhs.withColumn(f"_c{i}", F.explode(F.array(cell(a) - 1, cell(a), cell(a) + 1)))
    rhs = lows.select(C("x").alias("_x"), C("y").alias("_y"), "_z", *(cell(a).alias(f"_c{i}") for i, a in enumerate("xy")))
    lhs, rhs, on = salted(lhs, rhs, keys, F.struct("x", "y"), F.struct("_x", "_y"))
    flat = F.sqrt((C("x") - C("_x")) * (C("x") - C("_x")) + (C("y") - C("_y")) * (C("y") - C("_y")))
    pairs = lhs.join(rhs, on).where(C("_z") < C("_top")).withColumn("_flat", flat).where(C("_flat") < radius)
    limits = pairs.groupBy("x", "y").agg(F.min(C("_z") + math.tan(math.radians(slope)) * C("_flat")).alias("_limit"))
    return points.join(limits, ["x", "y"], "left").withColumn("segment", F.when(C("z") > C("_limit"), 1).otherwise(0)).drop("_limit")


def data_snooping(df: DataFrame, column: str, stds: float) -> DataFrame:
    """Rows strictly within ``stds`` population standard deviations of the mean."""
    stats = df.agg(F.struct(F.avg(column).alias("a"), F.stddev_pop(column).alias("s")).alias("s")).scalar()
    inside = (C(column) > C("_s.a") - stds * C("_s.s")) & (C(column) < C("_s.a") + stds * C("_s.s"))
    return df.withColumn("_s", stats).where(inside).drop("_s")


def remove_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def min_size_filter(df: DataFrame, keys: list[str], least: int, most: int | None = None) -> DataFrame:
    """Rows of groups whose size lies in [least, most]; sizes are pre-aggregated, groups are never collected."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(C("_n") >= least)
    sizes = sizes if most is None else sizes.where(C("_n") <= most)
    return df.join(sizes.drop("_n"), keys, "left_semi")


def decimate(points: DataFrame, step: int, order: list[str]) -> DataFrame:
    """Every ``step``-th row of the whole table in ``order``, starting with the first (a systematic sample)."""
    return global_rank(points, order, "_rank").where(F.pmod(C("_rank") - 1, F.lit(step)) == 0).drop("_rank")


def extract_area(panorama: DataFrame, top_left: tuple[int, int], bottom_right: tuple[int, int]) -> DataFrame:
    """Rows strictly inside two (row, col) corners."""
    return panorama.where((C("row") > top_left[0]) & (C("row") < bottom_right[0])
                          & (C("col") > top_left[1]) & (C("col") < bottom_right[1]))


# --- set operations and order -----------------------------------------------------------------------------------------

def append_points(*clouds: DataFrame) -> DataFrame:
    out = clouds[0]
    for cloud in clouds[1:]:
        out = out.unionByName(cloud, allowMissingColumns=True)
    return out


def distinct_points(points: DataFrame) -> DataFrame:
    return points.select("x", "y", "z").distinct()


def intersect_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).intersect(b.select(*columns))


def attach(points: DataFrame, values: DataFrame) -> DataFrame:
    """Attach a property by ``point_id``; the query fails when a point has no value (sizes must agree)."""
    joined = points.join(values.withColumn("_has", F.lit(True)), "point_id", "left")
    checked = F.when(C("_has"), C("point_id")).otherwise(
        F.raise_error(F.concat(F.lit("no value for point "), C("point_id").cast("string"))))
    return joined.withColumn("point_id", checked).drop("_has")


def order_clusters(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.orderBy(*keys)


def k_closest_values(df: DataFrame, column: str, target: float, k: int) -> DataFrame:
    """The k rows whose value is closest to ``target`` (ties by id)."""
    return df.withColumn("difference", F.abs(C(column) - target)).orderBy("difference", "point_id").limit(k)


#: Pairs of places that are compared one by one at the end of the search for the farthest pair.
FEW_PAIRS = 5_000_000


def farthest_pair(points: DataFrame, directions: int = 16) -> DataFrame:
    """Largest XY distance between two points of each cloud, exactly; 0 for a single place.

    The extreme points of some directions give a lower bound.  Then branch and bound over square cells: pairs of cells
    whose farthest corners lie below the bound cannot hold the pair; what is left is split into quarters, and the
    points of the cells (one each, any) raise the bound, until the places that are left make ``FEW_PAIRS`` pairs at most.
    """
    places = cut_lineage(points.where("x IS NOT NULL AND y IS NOT NULL").select("cloud_id", "x", "y").distinct())
    extremes = []
    for i in range(directions):
        along = C("x") * math.cos(math.pi * i / directions) + C("y") * math.sin(math.pi * i / directions)
        extremes += [F.max_by(F.struct("x", "y"), along).alias(f"_hi{i}"), F.min_by(F.struct("x", "y"), along).alias(f"_lo{i}")]
    wide = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    row = places.groupBy("cloud_id").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), (wide * (1 + 1e-9) + 1e-300).alias("_side"), *extremes)

    def apart(a: str, b: str) -> Column:
        return F.sqrt((C(f"{a}.x") - C(f"{b}.x")) * (C(f"{a}.x") - C(f"{b}.x")) + (C(f"{a}.y") - C(f"{b}.y")) * (C(f"{a}.y") - C(f"{b}.y")))

    row = row.withColumn("best", F.greatest(*(apart(f"_hi{i}", f"_lo{i}") for i in range(directions)))).select("cloud_id", "_x0", "_y0", "_side", "best")
    bounds, level, pairs = cut_lineage(row), 3, None
    open_ = places
    while True:
        level += 1
        step = C("_side") / 2.0 ** level
        cell = F.struct(F.floor((C("x") - C("_x0")) / step).alias("i"), F.floor((C("y") - C("_y0")) / step).alias("j"))
        cells = (lookup(open_, bounds, ["cloud_id"]).groupBy("cloud_id", cell.alias("c"))
                 .agg(F.min(F.struct("x", "y")).alias("p"), F.count(F.lit(1)).alias("n")))
        cells = cut_lineage(cells)
        mine = cells.select("cloud_id", C("c").alias("a"), C("p").alias("pa"), C("n").alias("na"))
        other = cells.select("cloud_id", C("c").alias("b"), C("p").alias("pb"), C("n").alias("nb"))
        if pairs is None:  # 16 x 16 cells a cloud at most
            pairs = mine.join(other, "cloud_id").where("a.i < b.i OR (a.i = b.i AND a.j <= b.j)")
        else:
            quarters = lambda n: F.explode(F.array(*(F.struct((C(f"{n}.i") * 2 + i).alias("i"), (C(f"{n}.j") * 2 + j).alias("j")) for i in (0, 1) for j in (0, 1))))
            pairs = pairs.withColumn("a", quarters("a")).withColumn("b", quarters("b")).join(mine, ["cloud_id", "a"]).join(other, ["cloud_id", "b"])
        gap = lambda k: F.abs(C(f"a.{k}") - C(f"b.{k}")) + 1
        reach = F.sqrt(gap("i") * gap("i") + gap("j") * gap("j")) * step * (1 + 1e-9)
        pairs = cut_lineage(lookup(pairs, bounds.select("cloud_id", "_side"), ["cloud_id"])
                            .select("cloud_id", "a", "b", reach.alias("reach"), apart("pa", "pb").alias("d"), (C("na") * C("nb")).alias("n")))
        better = pairs.groupBy("cloud_id").agg(F.max("d").alias("_d"))
        bounds = cut_lineage(bounds.join(better, "cloud_id", "left").withColumn("best", F.greatest("best", F.coalesce("_d", F.lit(0.0)))).drop("_d"))
        # Of the quarters of one cell each pair is needed once.
        once = f"{int(level == 4)} = 1 OR shiftright(a.i, 1) <> shiftright(b.i, 1) OR shiftright(a.j, 1) <> shiftright(b.j, 1) OR a.i < b.i OR (a.i = b.i AND a.j <= b.j)"
        pairs = cut_lineage(lookup(pairs.where(f"n > 1 AND ({once})"), bounds.select("cloud_id", "best"), ["cloud_id"])
                            .where(C("reach") > C("best")).select("cloud_id", "a", "b", "n"))
        if (pairs.agg(F.sum("n")).first()[0] or 0) <= FEW_PAIRS:
            inside = lookup(open_, bounds, ["cloud_id"]).select("cloud_id", cell.alias("c"), F.struct("x", "y").alias("p"))
            left = inside.select("cloud_id", C("c").alias("a"), C("p").alias("pa"))
            right = inside.select("cloud_id", C("c").alias("b"), C("p").alias("pb"))
            found = pairs.join(left, ["cloud_id", "a"]).join(right, ["cloud_id", "b"]).groupBy("cloud_id").agg(F.max(apart("pa", "pb")).alias("_d"))
            return bounds.join(found, "cloud_id", "left").select("cloud_id", F.greatest("best", F.coalesce("_d", F.lit(0.0))).alias("dist"))
        pairs = pairs.drop("n")
        needed = pairs.select("cloud_id", C("a").alias("c")).union(pairs.select("cloud_id", C("b").alias("c"))).distinct()
        inside = lookup(open_, bounds, ["cloud_id"]).withColumn("c", cell).join(needed, ["cloud_id", "c"], "left_semi")
        open_ = cut_lineage(inside.select("cloud_id", "x", "y"))


# --- grids ------------------------------------------------------------------------------------------------------------

def grid_cell_features(points: DataFrame, big: float, small: float, least: int = 10) -> DataFrame:
    """Two-level XY grid: per small cell with more than ``least`` points its eigenvalues (sample covariance), normal,
    normal in the frame of the big cell, and roughness.

    Roughness is the spread of the heights over the big cell's plane, ``sqrt(r' C r)`` of the small cell's covariance and
    the big cell's normal r: no second pass over the points.
    """
    placed = points.withColumn("_e", extent(points, ("x", "y")))
    cell = lambda a, s: F.floor((C(a) - C(f"_e.{a}_min")) / s).cast("int")
    placed = placed.withColumns({"big_row": cell("y", big), "big_col": cell("x", big), "row": cell("y", small),
                                 "col": cell("x", small)}).drop("_e")
    parent_keys, keys = ["big_row", "big_col"], ["big_row", "big_col", "row", "col"]
    parents = linalg.with_eigen(moments(placed, parent_keys, sample=True, min_points=0).where(C("n") > least))
    parents = parents.select(*parent_keys, C("plate").alias("_up"), C("stick").alias("_along"))
    cells = linalg.with_eigen(moments(placed, keys, sample=True, min_points=0).where(C("n") > least))
    joined = cells.join(parents, parent_keys)
    up = [C("_up")[i] for i in range(3)]
    along = [C("_along")[i] for i in range(3)]
    across = linalg.cross(up, along)
    n = [C("plate")[i] for i in range(3)]
    matrix = {f"{a}{b}": C(f"c{a}{b}") for a, b in PAIRS}
    quadratic = sum((up["xyz".index(a)] * up["xyz".index(b)] * matrix[f"{a}{b}"] * (1 if a == b else 2) for a, b in PAIRS), F.lit(0.0))
    population = quadratic * (C("n") - 1) / C("n")
    return joined.select(*keys, "n", "l1", "l2", "l3", *(e.alias(f"n{a}") for e, a in zip(n, "xyz")),
                         linalg.dot(along, n).alias("rel_x"), linalg.dot(across, n).alias("rel_y"), linalg.dot(up, n).alias("rel_z"),
                         F.sqrt(F.greatest(F.lit(0.0), population)).alias("roughness"))


def cell_normal_idw(points: DataFrame, size: float) -> DataFrame:
    """Mean normal per XY cell, weighted by the inverse distance to the cell centre, and its angle to z (0 .. 90 deg)."""
    placed = points.withColumn("_e", extent(points, ("x", "y")))
    placed = placed.withColumns({"row": F.floor((C("y") - C("_e.y_min")) / size).cast("int"),
                                 "col": F.floor((C("x") - C("_e.x_min")) / size).cast("int")})
    ox, oy = C("x") - (C("_e.x_min") + (C("col") + 0.5) * size), C("y") - (C("_e.y_min") + (C("row") + 0.5) * size)
    placed = placed.withColumn("_w", 1 / F.greatest(F.lit(1e-9), F.sqrt(ox * ox + oy * oy)))
    sums = placed.groupBy("row", "col").agg(*(F.sum(C("_w") * C(f"n{a}")).alias(f"_s{a}") for a in "xyz"))
    length = linalg.norm([C(f"_s{a}") for a in "xyz"])
    sums = sums.withColumn("_len", F.when(length > 0, length))
    sums = sums.select("row", "col", *((C(f"_s{a}") / C("_len")).alias(f"n{a}") for a in "xyz"))
    return sums.withColumn("angle", F.degrees(F.acos(F.least(F.lit(1.0), F.abs("nz")))))


def overlap_percent(points: DataFrame, size: float = 10.0) -> DataFrame:
    """Per pair of clouds: XY cells that hold both over cells that hold either, in percent.

    Each cell becomes the sorted set of its clouds; pairs are counted from those sets.
    """
    placed = points.withColumn("_e", extent(points, ("x", "y")))
    cell = lambda a: F.floor((C(a) - C(f"_e.{a}_min")) / size)
    cells = placed.select("cloud_id", cell("x").alias("_i"), cell("y").alias("_j")).distinct()
    totals = cells.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    sets = cells.groupBy("_i", "_j").agg(F.sort_array(F.collect_set("cloud_id")).alias("_s"))
    sets = sets.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    pairs = sets.select("_n", "_s", F.explode("_s").alias("a")).select("_n", "a", F.explode("_s").alias("b")).where("a < b")
    both = pairs.groupBy("a", "b").agg(F.sum("_n").alias("both"))
    left, right = totals.select(C("cloud_id").alias("a"), C("n").alias("_na")), totals.select(C("cloud_id").alias("b"), C("n").alias("_nb"))
    return both.join(left, "a").join(right, "b").select("a", "b", (100.0 * C("both") / (C("_na") + C("_nb") - C("both"))).alias("overlap"))


def normal_angle_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Cells of two clouds whose normal angles differ by less than ``threshold`` (band join on angle buckets).

    ``a`` and ``b`` hold ``row, col, angle``; the result names the cells of both.
    """
    bucket = F.floor(C("angle") / threshold)
    lhs = a.select(C("row").alias("row_a"), C("col").alias("col_a"), C("angle").alias("angle_a"),
                   F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    rhs = b.select(C("row").alias("row_b"), C("col").alias("col_b"), C("angle").alias("angle_b"), bucket.alias("_b"))
    lhs, rhs, on = salted(lhs, rhs, ["_b"], F.struct("row_a", "col_a"), F.struct("row_b", "col_b"))
    return lhs.join(rhs, on).where(F.abs(C("angle_a") - C("angle_b")) < threshold).select(
        "row_a", "col_a", "row_b", "col_b", "angle_a", "angle_b")


def color_normalize(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Add ``<c>_norm``: channels rescaled to [0, 1] over the range of all channels."""
    low = F.least(*(F.min(c) for c in channels))
    high = F.greatest(*(F.max(c) for c in channels))
    stats = df.agg(F.struct(low.alias("lo"), high.alias("hi")).alias("s")).scalar()
    return df.withColumn("_s", stats).withColumns({
        f"{c}_norm": F.try_divide(C(c) - C("_s.lo"), C("_s.hi") - C("_s.lo")) for c in channels}).drop("_s")


def color_restore(norm: Column) -> Column:
    return F.round(norm * 255).cast("int")
