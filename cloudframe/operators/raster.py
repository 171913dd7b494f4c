"""Rasters as long tables ``row, col, value`` (a void is a missing row or a NULL).

Neighbour access is one operator: every cell sends its value to the cells that need it, and a map-side combined
aggregation collects them.  Rows are first laid out by tile, so that nearly all of a tile's messages meet before the
shuffle instead of in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

C = F.col
TILE = 64
Kernel = list[list[float]]


def bounds(raster: DataFrame) -> Column:
    """Struct (r0, r1, c0, c1) of the first and last row and column, evaluated once per query."""
    return raster.agg(F.struct(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"),
                               F.max("col").alias("c1")).alias("b")).scalar()


def by_tile(raster: DataFrame) -> DataFrame:
    return raster.repartition(F.floor(C("row") / TILE), F.floor(C("col") / TILE))


def expand_bounds(raster: DataFrame, pad: int, mode: str = "mirror") -> DataFrame:
    """Add ``pad`` border rows and columns and mark them ``inner = false``.

    ``mirror``: the edge row repeats first (cba|abc); ``reflect``: the edge row does not repeat (dcb|abc);
    ``replicate``: the edge value repeats; ``panorama``: columns wrap around and rows mirror; ``zero``: nothing is added.
    """
    if mode == "zero" or pad == 0:
        return raster.withColumn("inner", F.lit(True))
    values = [c for c in raster.columns if c not in ("row", "col")]
    ext = raster.withColumn("_b", bounds(raster))
    def images(axis, low, high, kind):
        p, a, b = C(axis), C(f"_b.{low}"), C(f"_b.{high}")
        if kind == "wrap":
            size = b - a + 1
            extra = [F.when(p > b - pad, p - size), F.when(p < a + pad, p + size)]
        elif kind == "mirror":
            extra = [F.when(p < a + pad, 2 * a - 1 - p), F.when(p > b - pad, 2 * b + 1 - p)]
        elif kind == "reflect":
            extra = [F.when((p > a) & (p <= a + pad), 2 * a - p), F.when((p < b) & (p >= b - pad), 2 * b - p)]
        else:
            extra = [e for i in range(1, pad + 1) for e in (F.when(p == a, p - i), F.when(p == b, p + i))]
        return F.explode(F.array_compact(F.array(p, *extra)))
    row_kind = {"panorama": "mirror"}.get(mode, mode)
    col_kind = {"panorama": "wrap"}.get(mode, mode)
    ext = ext.withColumn("_row", images("row", "r0", "r1", row_kind)).withColumn("_col", images("col", "c0", "c1", col_kind))
    inner = (C("_row") == C("row")) & (C("_col") == C("col"))
    return ext.select(C("_row").cast("int").alias("row"), C("_col").cast("int").alias("col"), *values, inner.alias("inner"))


def shrink_bounds(expanded: DataFrame) -> DataFrame:
    return expanded.where("inner").drop("inner")


def stencil(raster: DataFrame, offsets: dict[str, tuple[int, int]], column: str = "value", border: str = "replicate") -> DataFrame:
    """Existing cells with one column per named neighbour offset (NULL where there is none)."""
    pad = max(max(abs(r), abs(c)) for r, c in offsets.values())
    ext = expand_bounds(by_tile(raster.select("row", "col", column)), pad, border)
    sends = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(c).alias("c")) for i, (r, c) in enumerate(offsets.values())),
                    F.struct(F.lit(-1).alias("i"), F.lit(0).alias("r"), F.lit(0).alias("c")))
    sent = ext.withColumn("_o", F.explode(sends)).select(
        (C("row") - C("_o.r")).alias("row"), (C("col") - C("_o.c")).alias("col"), C("_o.i").alias("_i"), column, "inner")
    got = sent.groupBy("row", "col").agg(F.max(F.when((C("_i") == -1) & C("inner"), 1)).alias("_here"), *(
        F.max(F.when(C("_i") == i, C(column))).alias(name) for i, name in enumerate(offsets)))
    return got.where(C("_here") == 1).drop("_here")


def conv2d(raster: DataFrame, kernel: Kernel, column: str = "value", out: str = "value", border: str = "zero", flip: bool = False) -> DataFrame:
    """Correlation with a small kernel (convolution when ``flip``); the centre of an even kernel lies right and below.

    A cell none of whose taps meets a value is NULL.
    """
    if flip:
        kernel = [row[::-1] for row in kernel[::-1]]
    h, w = len(kernel), len(kernel[0])
    taps = [(i - h // 2, j - w // 2, float(v)) for i, row in enumerate(kernel) for j, v in enumerate(row) if v]
    pad = max(h, w) // 2
    ext = expand_bounds(by_tile(raster.select("row", "col", column)), pad, border)
    sends = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(v).alias("w"), F.lit(False).alias("own")) for r, c, v in taps),
                    F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("w"), F.lit(True).alias("own")))
    sent = ext.withColumn("_o", F.explode(sends)).select(
        (C("row") - C("_o.r")).alias("row"), (C("col") - C("_o.c")).alias("col"),
        F.when(~C("_o.own"), C(column) * C("_o.w")).alias("_v"), (C("_o.own") & C("inner")).alias("_own"))
    sums = sent.groupBy("row", "col").agg(F.max("_own").alias("_here"), F.sum("_v").alias(out))
    return sums.where("_here").select("row", "col", out)


def gaussian_kernel(sigma: float = 0.0, size: int = 0) -> list[float]:
    """Normalised 1-D Gaussian; a missing size covers three sigma, a missing sigma follows from the size."""
    if size <= 0:
        size = int(round(sigma * 6 + 1)) | 1
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [v / sum(raw) for v in raw]


def gaussian_blur(raster: DataFrame, sigma: float = 0.0, size: int = 0, column: str = "value", border: str = "reflect") -> DataFrame:
    """Separable Gaussian blur: one pass along the columns, one along the rows."""
    k = gaussian_kernel(sigma, size)
    across = conv2d(raster, [k], column, column, border)
    return conv2d(across, [[v] for v in k], column, column, border)


def _join(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, ["row", "col"])
    return out


def dog(raster: DataFrame, first: float, second: float, by_size: bool = False) -> DataFrame:
    """Wider blur minus narrower blur."""
    low, high = sorted((first, second))
    blur = lambda v: gaussian_blur(raster, size=int(v)) if by_size else gaussian_blur(raster, v)
    both = blur(high).withColumnRenamed("value", "_b").join(blur(low).withColumnRenamed("value", "_a"), ["row", "col"])
    return both.select("row", "col", (C("_b") - C("_a")).alias("value"))


# Sobel weights of a 3x3 window (d/dcol and d/drow).
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


def sobel(raster: DataFrame, order: int = 1, sigma: float = 0.0, border: str = "reflect") -> DataFrame:
    """``zx, zy`` and, for order 2, ``zxx, zyy, zxy`` (each optionally blurred)."""
    def once(frame, column, kernel, out):
        result = conv2d(frame, kernel, column, out, border)
        return gaussian_blur(result, sigma, column=out, border=border) if sigma else result
    first = {"zx": once(raster, "value", SOBEL_X, "zx"), "zy": once(raster, "value", SOBEL_Y, "zy")}
    frames = list(first.values())
    if order == 2:
        frames += [once(first["zx"], "zx", SOBEL_X, "zxx"), once(first["zy"], "zy", SOBEL_Y, "zyy"), once(first["zx"], "zx", SOBEL_Y, "zxy")]
    return _join(frames)


def derivatives4(raster: DataFrame, step: int = 1, resolution: float = 1.0, column: str = "value") -> DataFrame:
    """Central differences over ``step`` cells: ``zx, zy, zxx, zyy, zxy`` (edges repeat)."""
    s = step
    near = stencil(raster, {"_c": (0, 0), "_e": (0, s), "_w": (0, -s), "_s": (s, 0), "_n": (-s, 0), "_se": (s, s), "_nw": (-s, -s),
                            "_sw": (s, -s), "_ne": (-s, s)}, column, "replicate")
    h = s * resolution
    return near.select("row", "col", ((C("_e") - C("_w")) / (2 * h)).alias("zx"), ((C("_s") - C("_n")) / (2 * h)).alias("zy"),
                       ((C("_e") + C("_w") - 2 * C("_c")) / (h * h)).alias("zxx"), ((C("_s") + C("_n") - 2 * C("_c")) / (h * h)).alias("zyy"),
                       ((C("_se") + C("_nw") - C("_sw") - C("_ne")) / (4 * h * h)).alias("zxy"))


def derivatives8(raster: DataFrame) -> DataFrame:
    """Eight-neighbour Laplacian."""
    return conv2d(raster, [[1, 1, 1], [1, -8, 1], [1, 1, 1]], border="replicate")


def gradient(raster: DataFrame, kind: str = "L1", sigma: float = 0.0, numeric: bool = False) -> DataFrame:
    """Gradient size: L1 or L2 of Sobel (or central) differences, or LoG; optionally blurred."""
    if kind == "LoG":
        size = int(4 * sigma + 0.5) * 2 + 1
        half = size // 2
        raw = [[((x * x + y * y - 2 * sigma * sigma) / sigma ** 4) * math.exp(-(x * x + y * y) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)
                for x in range(-half, half + 1)] for y in range(-half, half + 1)]
        return conv2d(raster, raw, border="mirror")
    d = derivatives4(raster) if numeric else sobel(raster)
    value = F.abs("zx") + F.abs("zy") if kind == "L1" else F.sqrt(C("zx") * C("zx") + C("zy") * C("zy"))
    out = d.select("row", "col", value.alias("value"))
    return gaussian_blur(out, sigma) if sigma else out


def principal_curvatures_raster(raster: DataFrame, step: int = 1) -> DataFrame:
    """``k1 >= k2`` of the second differences."""
    root = F.sqrt((C("zxx") - C("zyy")) * (C("zxx") - C("zyy")) + 4 * C("zxy") * C("zxy"))
    return derivatives4(raster, step).select("row", "col", ((C("zxx") + C("zyy") + root) / 2).alias("k1"), ((C("zxx") + C("zyy") - root) / 2).alias("k2"))


# --- terrain ----------------------------------------------------------------------------------------------------------

WINDOW = {f"_{n}": o for n, o in zip("abcdefghi", [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)])}


def terrain(raster: DataFrame, cell: float = 1.0) -> DataFrame:
    """Horn ``slope`` (rise over run) and ``slope_deg``, ``aspect`` (degrees clockwise from north), and Zevenbergen-Thorne
    ``curvature``, ``planform`` and ``profile`` curvature (x100).  NULL neighbours count as the centre."""
    near = stencil(raster, WINDOW, border="replicate")
    near = near.withColumns({n: F.coalesce(C(n), C("_e")) for n in WINDOW})
    a, b, c, d, e, f, g, h, i = (C(n) for n in WINDOW)
    near = near.withColumns({"_zx": ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * cell), "_zy": ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * cell),
                             "_D": ((d + f) / 2 - e) / (cell * cell), "_E": ((b + h) / 2 - e) / (cell * cell),
                             "_F": (c + g - a - i) / (4 * cell * cell), "_G": (f - d) / (2 * cell), "_H": (b - h) / (2 * cell)})
    rise = F.sqrt(C("_zx") * C("_zx") + C("_zy") * C("_zy"))
    angle = F.degrees(F.atan2(C("_zy"), -C("_zx")))
    compass = F.when(angle > 90, 450 - angle).otherwise(90 - angle)
    gh = C("_G") * C("_G") + C("_H") * C("_H")
    plan = F.when(gh > 0, -200 * (C("_D") * C("_H") * C("_H") + C("_E") * C("_G") * C("_G") - C("_F") * C("_G") * C("_H")) / gh).otherwise(0.0)
    prof = F.when(gh > 0, 200 * (C("_D") * C("_G") * C("_G") + C("_E") * C("_H") * C("_H") + C("_F") * C("_G") * C("_H")) / gh).otherwise(0.0)
    return near.select("row", "col", rise.alias("slope"), F.degrees(F.atan(rise)).alias("slope_deg"),
                       F.when((C("_zx") == 0) & (C("_zy") == 0), 0.0).otherwise(compass).alias("aspect"),
                       (-200 * (C("_D") + C("_E"))).alias("curvature"), plan.alias("planform"), prof.alias("profile"))


def hillshade(raster: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shade 0..255 from central differences inside and one-sided differences at the edges."""
    near = stencil(raster, {"_n": (-1, 0), "_s": (1, 0), "_w": (0, -1), "_e": (0, 1), "_c": (0, 0)}, border="zero")
    slope = lambda low, high: F.when(C(low).isNotNull() & C(high).isNotNull(), (C(high) - C(low)) / 2).when(
        C(high).isNotNull(), C(high) - C("_c")).when(C(low).isNotNull(), C("_c") - C(low)).otherwise(0.0)
    near = near.withColumns({"_dr": slope("_n", "_s"), "_dc": slope("_w", "_e")})
    steep = math.pi / 2 - F.atan(F.sqrt(C("_dr") * C("_dr") + C("_dc") * C("_dc")))
    aspect = F.atan2(-C("_dr"), C("_dc"))
    az, alt = math.radians(azimuth), math.radians(altitude)
    shade = math.sin(alt) * F.sin(steep) + math.cos(alt) * F.cos(steep) * F.cos(az - aspect)
    return near.select("row", "col", (255 * (shade + 1) / 2).alias("value"))


def nonmax_suppression(raster: DataFrame, border: str = "reflect") -> DataFrame:
    """Cells that are not smaller than both neighbours along the gradient direction keep their value, others become 0."""
    near = stencil(raster, WINDOW, border="zero").join(sobel(raster, border=border), ["row", "col"])
    angle = F.degrees(F.atan2("zx", "zy"))
    near = near.withColumn("_t", F.when(angle < 0, angle + 360).otherwise(angle))
    turn = F.floor(F.pmod(C("_t") + 22.5, F.lit(180.0)) / 45)
    pair = {0: ("_d", "_f"), 1: ("_c", "_g"), 2: ("_b", "_h"), 3: ("_a", "_i")}
    top = F.lit(False)
    for k, (p, o) in pair.items():
        top = top | ((turn == k) & (C("_e") >= C(p)) & (C("_e") >= C(o)))
    return near.select("row", "col", F.when(top, C("_e")).otherwise(0.0).alias("value"))


# --- values -----------------------------------------------------------------------------------------------------------

def fill_void(raster: DataFrame) -> DataFrame:
    """Every void of the raster's rectangle (missing row or NULL) becomes the mean of the valid cells."""
    mean = raster.agg(F.avg("value")).scalar()
    grid = full_grid(raster)
    return grid.join(raster, ["row", "col"], "left").withColumn("_m", mean).select("row", "col", F.coalesce("value", "_m").alias("value"))


def full_grid(raster: DataFrame) -> DataFrame:
    """All (row, col) of the raster's rectangle, made in parallel from one sequence per row."""
    b = raster.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    rows = b.select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1")
    return rows.repartition("row").select("row", F.explode(F.sequence("c0", "c1")).alias("col"))


def pixel_to_world(row: Column, col: Column, x0: float, y0: float, sx: float, sy: float) -> dict[str, Column]:
    return {"x": sx * col + x0, "y": sy * row + y0}


def world_to_pixel(x: Column, y: Column, x0: float, y0: float, sx: float, sy: float) -> dict[str, Column]:
    return {"row": (y - y0) / sy, "col": (x - x0) / sx}


def raster_to_points(raster: DataFrame, x0: float, y0: float, sx: float, sy: float, window: tuple | None = None) -> DataFrame:
    """World x, y and value per cell, optionally inside (xmin, ymin, xmax, ymax)."""
    world = pixel_to_world(C("row"), C("col"), x0, y0, sx, sy)
    out = raster.select(world["x"].alias("x"), world["y"].alias("y"), C("value").alias("z"))
    return out if window is None else out.where(C("x").between(window[0], window[2]) & C("y").between(window[1], window[3]))


def points_to_raster(points: DataFrame, size: float, column: str = "z") -> DataFrame:
    """Mean of a column per XY cell."""
    cell = lambda a: F.floor((C(a) - C(f"_e.{a}_min")) / size).cast("int")
    from cloudframe.operators.smoothing import extent
    return points.withColumn("_e", extent(points, ("x", "y"))).groupBy(cell("y").alias("row"), cell("x").alias("col")).agg(F.avg(column).alias("value"))


def interpolate_nearest(points: DataFrame, size: float, column: str = "z") -> DataFrame:
    """Grid over the points' extent; each node takes the value of the nearest point in XY."""
    from cloudframe.operators.joins import knn
    b = points.agg(*(f(a).alias(f"{a}{n}") for a in "xy" for f, n in ((F.min, 0), (F.max, 1))))
    steps = lambda a: F.sequence(F.lit(0), (F.ceil((C(f"{a}1") - C(f"{a}0")) / size) - 1).cast("int"))
    nodes = b.select("*", F.explode(steps("y")).alias("row")).repartition("row").select("*", F.explode(steps("x")).alias("col"))
    nodes = nodes.select(F.struct("row", "col").alias("point_id"), (C("x0") + C("col") * size).alias("x"), (C("y0") + C("row") * size).alias("y"))
    near = knn(nodes, points, 1, ("x", "y"), include_zero=True)
    return near.join(points.select(C("point_id").alias("nid"), C(column).alias("value")), "nid").select(
        C("point_id.row").alias("row"), C("point_id.col").alias("col"), "value")


def sample_raster(places: DataFrame, raster: DataFrame, method: str = "bilinear") -> DataFrame:
    """``point_id, value`` at fractional ``row, col``: four corners joined and weighted; NULL when a needed corner is void."""
    if method == "nearest":
        at = places.select("point_id", F.rint("row").cast("int").alias("row"), F.rint("col").cast("int").alias("col"))
        return at.join(raster, ["row", "col"], "left").select("point_id", "value")
    near = lambda c: F.when(F.abs(C(c) - F.rint(c)) < 1e-8, F.rint(c)).otherwise(C(c))
    p = places.select("point_id", near("row").alias("_r"), near("col").alias("_c")).withColumns({"_i": F.floor("_r"), "_j": F.floor("_c")})
    p = p.withColumns({"_fr": C("_r") - C("_i"), "_fc": C("_c") - C("_j")})
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    p = p.withColumn("_k", F.explode(corners))
    w = F.when(C("_k.a") == 1, C("_fr")).otherwise(1 - C("_fr")) * F.when(C("_k.b") == 1, C("_fc")).otherwise(1 - C("_fc"))
    p = p.select("point_id", (C("_i") + C("_k.a")).cast("int").alias("row"), (C("_j") + C("_k.b")).cast("int").alias("col"), w.alias("_w"))
    got = p.join(raster, ["row", "col"], "left").groupBy("point_id").agg(
        F.sum(C("_w") * C("value")).alias("_v"), F.max((C("_w") > 0) & C("value").isNull()).alias("_void"))
    return got.select("point_id", F.when(~C("_void"), C("_v")).alias("value"))


def resample_raster(raster: DataFrame, shift_row: float, shift_col: float, rate: float) -> DataFrame:
    """Shifted, coarser grid by bilinear lookup."""
    grid = full_grid(raster).withColumn("_b", bounds(raster))
    nodes = grid.select(F.struct("row", "col").alias("point_id"), (C("_b.r0") + shift_row + (C("row") - C("_b.r0")) * rate).alias("row"),
                        (C("_b.c0") + shift_col + (C("col") - C("_b.c0")) * rate).alias("col"), "_b")
    inside = nodes.where((C("row") <= C("_b.r1")) & (C("col") <= C("_b.c1"))).drop("_b")
    return sample_raster(inside, raster).select(C("point_id.row").alias("row"), C("point_id.col").alias("col"), "value")


def map_algebra(bands: dict[str, DataFrame], expression: str) -> DataFrame:
    """Expression over aligned bands; a void in any band gives a void."""
    joined = _join([f.select("row", "col", C("value").alias(n)) for n, f in bands.items()])
    return joined.select("row", "col", F.expr(expression).alias("value"))


def reclassify(raster: DataFrame, classes: list[tuple[float, float, float]]) -> DataFrame:
    """Replace values in [low, high] by the class; later classes win, other values stay."""
    value = C("value")
    out = value
    for low, high, new in classes:
        out = F.when(value.between(low, high), float(new)).otherwise(out)
    return raster.withColumn("value", out)


def apply_lut(raster: DataFrame, lut: DataFrame) -> DataFrame:
    """Replace values by a lookup table (``key, new``); values without an entry stay."""
    return raster.join(lut.withColumnRenamed("key", "value"), "value", "left").select(
        "row", "col", F.coalesce("new", "value").alias("value"))


def mosaic(rasters: list[DataFrame]) -> DataFrame:
    """Later rasters overwrite earlier ones where they are not void."""
    parts = [r.select("row", "col", "value", F.lit(i).alias("_seq")) for i, r in enumerate(rasters)]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union.where(C("value").isNotNull()).groupBy("row", "col").agg(F.max_by("value", "_seq").alias("value"))


def raster_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of differing cells and the largest difference."""
    both = a.select("row", "col", C("value").alias("_a")).join(b.select("row", "col", C("value").alias("_b")), ["row", "col"], "full")
    gap = F.abs(C("_a") - C("_b"))
    return both.agg(F.sum(F.when(C("_a").eqNullSafe(C("_b")), 0).otherwise(1)).cast("bigint").alias("n_diff"), F.max(gap).alias("max_diff"))


def region_means(image: DataFrame, heaviside: DataFrame) -> DataFrame:
    """Mean of the image inside (weights H) and outside (1 - H)."""
    j = image.join(heaviside.select("row", "col", C("value").alias("_h")), ["row", "col"])
    return j.agg(F.try_divide(F.sum(C("value") * C("_h")), F.sum("_h")).alias("c1"),
                 F.try_divide(F.sum(C("value") * (1 - C("_h"))), F.sum(1 - C("_h"))).alias("c2"))


# --- image saliency ---------------------------------------------------------------------------------------------------

def frequency_saliency(raster: DataFrame, filters: list[float], by_size: bool = False) -> DataFrame:
    """Mean over neighbouring filter pairs of ``|image - DoG|``."""
    pairs = list(zip(filters[:-1], filters[1:]))
    joined = _join([raster.select("row", "col", "value")] + [
        dog(raster, a, b, by_size).withColumnRenamed("value", f"_d{i}") for i, (a, b) in enumerate(pairs)])
    total = sum((F.abs(C("value") - C(f"_d{i}")) for i in range(len(pairs))), F.lit(0.0))
    return joined.select("row", "col", (total / len(pairs)).alias("value"))


def box_mean(raster: DataFrame, rows: int, cols: int, border: str = "zero") -> DataFrame:
    """Mean over a box of cells, absent cells as zero, separable."""
    across = conv2d(raster, [[1.0 / cols] * cols], border=border)
    return conv2d(across, [[1.0 / rows]] * rows, border=border)


def contrast_saliency(raster: DataFrame, region: int, sizes: list[int]) -> DataFrame:
    """Mean over the large boxes of ``|small box mean - large box mean|``."""
    joined = _join([box_mean(raster, region, region).withColumnRenamed("value", "_s")] + [
        box_mean(raster, s, s).withColumnRenamed("value", f"_l{i}") for i, s in enumerate(sizes)])
    total = sum((F.abs(C("_s") - C(f"_l{i}")) for i in range(len(sizes))), F.lit(0.0))
    return joined.select("row", "col", (total / len(sizes)).alias("value"))


def directional_kernels(n: int) -> list[Kernel]:
    """Horizontal, vertical and the two diagonal lines of an odd window, the centre balancing the sum."""
    half = n // 2
    lines = [lambda i, j: i == half, lambda i, j: j == half, lambda i, j: i == j, lambda i, j: i == n - 1 - j]
    return [[[(-(n - 1.0) if i == half and j == half else 1.0) if on(i, j) else 0.0 for j in range(n)] for i in range(n)] for on in lines]


def directional_saliency_raster(bands: list[DataFrame], weights: list[float], window: int = 3) -> DataFrame:
    """Sum of all line kernels over all weighted bands, scaled to [0, 1]; linear, so the kernels are added first."""
    from cloudframe.operators.saliency import scale_values
    kernels = directional_kernels(window)
    total = [[sum(k[i][j] for k in kernels) for j in range(window)] for i in range(window)]
    joined = _join([b.select("row", "col", C("value").alias(f"_b{i}")) for i, b in enumerate(bands)])
    mixed = joined.select("row", "col", sum((C(f"_b{i}") * w for i, w in enumerate(weights)), F.lit(0.0)).alias("value"))
    return scale_values(conv2d(mixed, total, border="zero", flip=True), "value", "value")


def ring_saliency_raster(curvature: DataFrame, dn: DataFrame, window: int, rho: float, sigma: float, weight: float = 0.5) -> DataFrame:
    """``w |ring * curvature| + (1 - w) dn`` with a Gaussian ring of radius ``rho`` and centre -1 (cells as unit)."""
    centre = window // 2
    kernel = [[-1.0 if i == centre and j == centre else math.exp(-((math.hypot(i - centre, j - centre) - rho) ** 2) / (2 * sigma * sigma))
               / (math.sqrt(2 * math.pi) * sigma) for j in range(window)] for i in range(window)]
    ring = conv2d(curvature, kernel, border="mirror", flip=True).withColumnRenamed("value", "_k")
    return ring.join(dn.select("row", "col", C("value").alias("_n")), ["row", "col"]).select(
        "row", "col", (F.abs("_k") * weight + F.coalesce("_n", F.lit(0.0)) * (1 - weight)).alias("value"))


# --- level sets -------------------------------------------------------------------------------------------------------

def heaviside(x: Column, epsilon: float = 1.0, kind: int = 0) -> Column:
    """0: sharp; 1: sine ramp over [-eps, eps]; 2: arctangent."""
    if kind == 0:
        return F.when(x >= 0, 1.0).otherwise(0.0)
    if kind == 1:
        ramp = 0.5 * (1 + x / epsilon + F.sin(math.pi * x / epsilon) / math.pi)
        return F.when(x > epsilon, 1.0).when(x < -epsilon, 0.0).otherwise(ramp)
    return 0.5 * (1 + 2 / math.pi * F.atan(x / epsilon))


def dirac(x: Column, epsilon: float = 1.0, kind: int = 0) -> Column:
    """Delta matching ``heaviside``; values below 2e-5 become 0."""
    if kind == 0:
        d = F.when(F.abs(x) <= epsilon, 1.0).otherwise(0.0)
    elif kind == 1:
        d = F.when(F.abs(x) <= epsilon, (1 + F.cos(math.pi * x / epsilon)) / (2 * epsilon)).otherwise(0.0)
    else:
        d = epsilon / math.pi / (epsilon * epsilon + x * x)
    return F.when(F.abs(d) < 2e-5, 0.0).otherwise(d)


def levelset_geometry(raster: DataFrame, eps: float = 2.220446049250313e-16) -> DataFrame:
    """``norm`` of the gradient (L1, L2) and curvature numerator over it."""
    d = derivatives4(raster)
    d = d.withColumns({c: F.when(F.abs(c) < 1e-5, 0.0).otherwise(C(c)) for c in ("zx", "zy", "zxx", "zyy", "zxy")})
    l2 = F.sqrt(C("zx") * C("zx") + C("zy") * C("zy"))
    kappa = (C("zxx") * C("zy") * C("zy") + C("zyy") * C("zx") * C("zx") - 2 * C("zxy") * C("zx") * C("zy")) / (l2 + eps)
    return d.select("row", "col", (F.abs("zx") + F.abs("zy")).alias("l1"), l2.alias("l2"), kappa.alias("kappa"))


def signed_distance(shape: str, row: Column, col: Column, resolution: float = 0.5, **p) -> Column:
    """Level functions of a circle (center, radius), an ellipse (center, axes), a checkerboard (denominator) or repeated
    circles (dx, dy, radius)."""
    if shape == "checkerboard":
        return F.sin(math.pi / p["denominator"] * col) * F.sin(math.pi / p["denominator"] * row)
    if shape == "circles":
        centre = lambda e, d: (F.floor((e - d / 2) / (d + p["radius"]))) * (d + p["radius"]) + d / 2 + p["radius"]
        y, x = (row - centre(row, p["dy"])) * resolution, (col - centre(col, p["dx"])) * resolution
        return F.when((row >= p["dy"] / 2) & (col >= p["dx"] / 2), p["radius"] * resolution - F.sqrt(x * x + y * y)).otherwise(-1.0)
    y, x = (row - p["center"][0]) * resolution, (col - p["center"][1]) * resolution
    if shape == "circle":
        return p["radius"] * resolution - F.sqrt(x * x + y * y)
    return F.sqrt((x / p["axes"][0]) * (x / p["axes"][0]) + (y / p["axes"][1]) * (y / p["axes"][1])) - 1


# --- panoramas --------------------------------------------------------------------------------------------------------

def panorama(points: DataFrame, spacing_az: float = 0.057, spacing_el: float = 0.057) -> DataFrame:
    """``row, col, point_id, range, value`` from points with ``az, el, range``; of several points in a cell the last id wins."""
    stats = points.agg(F.struct(F.min("az").alias("az"), F.max("el").alias("el")).alias("s")).scalar()
    placed = points.withColumn("_s", stats).withColumns({"row": F.floor((C("_s.el") - C("el")) / spacing_el).cast("int"),
                                                         "col": F.floor((C("az") - C("_s.az")) / spacing_az).cast("int")})
    value = C("intensity") if "intensity" in points.columns else F.lit(None).cast("double")
    last = placed.groupBy("row", "col").agg(F.max(F.struct("point_id", "range", value.alias("value"))).alias("_p"))
    return last.select("row", "col", C("_p.point_id").alias("point_id"), C("_p.range").alias("range"), C("_p.value").alias("value"))


def pano_angles(row: Column, col: Column, spacing_az: float, spacing_el: float) -> dict[str, Column]:
    return {"az": F.radians(col * spacing_az), "el": math.pi / 2 - F.radians(row * spacing_el)}


def normals_panorama(pano: DataFrame, spacing_az: float, spacing_el: float) -> DataFrame:
    """Unit cross product of the elevation and azimuth derivatives of the xyz images."""
    from cloudframe.functions.linalg import cross, norm
    a = pano_angles(C("row"), C("col"), spacing_az, spacing_el)
    xyz = {"x": C("range") * F.cos(a["el"]) * F.cos(a["az"]), "y": C("range") * F.cos(a["el"]) * F.sin(a["az"]), "z": C("range") * F.sin(a["el"])}
    frames = []
    for name, e in xyz.items():
        d = sobel(pano.select("row", "col", e.alias("value")))
        frames.append(d.select("row", "col", C("zx").alias(f"_a{name}"), C("zy").alias(f"_e{name}")))
    joined = _join(frames)
    joined = joined.withColumns(dict(zip(("_nx", "_ny", "_nz"), cross([C(f"_e{n}") for n in "xyz"], [C(f"_a{n}") for n in "xyz"]))))
    joined = joined.withColumn("_len", norm([C("_nx"), C("_ny"), C("_nz")]))
    return joined.select("row", "col", *(F.when(C("_len") > 0, C(f"_n{n}") / C("_len")).alias(f"n{n}") for n in "xyz"))


def adaptive_smoothing(pano: DataFrame, size: float, resolution: float, column: str = "range") -> DataFrame:
    """Gaussian per pixel with sigma ``2.5 size / (range resolution)`` over valid pixels of its window, renormalised."""
    from cloudframe.operators.joins import window_pairs
    sigma = 2.5 * size / (C("range") * resolution)
    half = (F.ceil(2 * C("_sigma") + 1).cast("int") / 2).cast("int")
    cells = pano.where(C("range") > 0).select("row", "col", sigma.alias("_sigma"))
    pairs = window_pairs(cells, half, half, pano.select("row", "col", C(column).alias("value")))
    d2 = (C("nrow") - C("row")) * (C("nrow") - C("row")) + (C("ncol") - C("col")) * (C("ncol") - C("col"))
    w = F.exp(-d2 / (2 * C("_sigma") * C("_sigma")))
    return pairs.groupBy("row", "col").agg((F.sum(w * C("nvalue")) / F.sum(w)).alias("value"))


def adaptive_derivatives(pano: DataFrame, size: float, resolution: float, column: str = "value") -> DataFrame:
    """Central differences over ``ceil(size / (range resolution))`` pixels; columns wrap around, rows mirror."""
    b = bounds(pano)
    cells = pano.where(C("range") > 0).withColumn("_b", b).withColumn("_d", F.ceil(size / (C("range") * resolution)).cast("int"))
    height, width = C("_b.r1") - C("_b.r0") + 1, C("_b.c1") - C("_b.c0") + 1
    ends = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, r, c in (("e", 0, 1), ("w", 0, -1), ("s", 1, 0), ("n", -1, 0))))
    sent = cells.withColumn("_k", F.explode(ends))
    turn = F.pmod(C("row") - C("_b.r0") + C("_k.r") * C("_d"), 2 * height)
    sent = sent.select("row", "col", "_d", C("_k.n").alias("_n"), (C("_b.r0") + F.when(turn < height, turn).otherwise(2 * height - 1 - turn)).cast("int").alias("_r"),
                       (C("_b.c0") + F.pmod(C("col") - C("_b.c0") + C("_k.c") * C("_d"), width)).cast("int").alias("_c"))
    target = pano.select(C("row").alias("_r"), C("col").alias("_c"), C(column).alias("_v"))
    got = sent.join(target, ["_r", "_c"], "left").groupBy("row", "col").agg(F.first("_d").alias("_d"), *(
        F.max(F.when(C("_n") == n, C("_v"))).alias(f"_{n}") for n in "ewsn"))
    scale = 2 * resolution * C("_d")
    return got.select("row", "col", ((C("_e") - C("_w")) / scale).alias("zx"), ((C("_s") - C("_n")) / scale).alias("zy"))


def adaptive_gradient(pano: DataFrame, size: float, resolution: float, kind: str = "L1") -> DataFrame:
    d = adaptive_derivatives(pano, size, resolution)
    value = F.abs("zx") + F.abs("zy") if kind == "L1" else F.sqrt(C("zx") * C("zx") + C("zy") * C("zy"))
    return d.select("row", "col", value.alias("value"))


def panorama_neighbors(pano: DataFrame, radius: float, spacing_az: float, spacing_el: float) -> DataFrame:
    """Edges ``point_id, nid`` of the pixels within ``ceil(radius / (range * spacing))`` of each pixel; columns wrap, rows mirror."""
    from cloudframe.operators.joins import window_pairs
    half = lambda s: F.ceil(radius / (C("range") * math.radians(s))).cast("int")
    cells = pano.where(C("range") > 0).select("row", "col", "point_id", "range")
    widest = cells.agg(F.max(F.greatest(half(spacing_az), half(spacing_el)))).first()[0] or 0
    images = expand_bounds(pano.select("row", "col", C("point_id").alias("id")), widest, "panorama").drop("inner")
    pairs = window_pairs(cells, half(spacing_el), half(spacing_az), images)
    return pairs.where(C("nid") != C("point_id")).select("point_id", "nid").distinct()
