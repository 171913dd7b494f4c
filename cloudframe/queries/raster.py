"""Rasters, terrain, images, level sets and panoramas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudframe.functions import geometry
from cloudframe.operators import context, graph, joins, points, raster
from cloudframe.queries import _data as d
from cloudframe.queries.points import SPH, _sph
from cloudframe.registry import Q, q, query

C = F.col
BOUNDS = 'b AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM raster)'
FOLD = {
    "replicate": lambda e, a, z: f"least(greatest({e}, {a}), {z})",
    "reflect": lambda e, a, z: f"CASE WHEN {e} < {a} THEN 2 * {a} - ({e}) WHEN {e} > {z} THEN 2 * {z} - ({e}) ELSE {e} END",
    "mirror": lambda e, a, z: f"CASE WHEN {e} < {a} THEN 2 * {a} - 1 - ({e}) WHEN {e} > {z} THEN 2 * {z} + 1 - ({e}) ELSE {e} END",
    "zero": lambda e, a, z: e,
}


def conv_sql(name: str, kernel, src: str = "raster", border: str = "zero", column: str = "value", out: str = "value") -> str:
    h, w = len(kernel), len(kernel[0])
    taps = ", ".join(f"({i - h // 2}, {j - w // 2}, {float(v)!r}::DOUBLE)" for i, row in enumerate(kernel) for j, v in enumerate(row) if v)
    fold = FOLD[border]
    return f"""{name} AS (SELECT a."row", a.col, sum(k.w * s.{column}) AS {out} FROM {src} a, b, (VALUES {taps}) k(dr, dc, w)
  LEFT JOIN {src} s ON s."row" = ({fold('a."row" + k.dr', 'b.r0', 'b.r1')}) AND s.col = ({fold('a.col + k.dc', 'b.c0', 'b.c1')}) GROUP BY 1, 2)"""


def blur_sql(name: str, sigma: float = 0.0, size: int = 0, src: str = "raster", border: str = "reflect") -> list[str]:
    k = raster.gaussian_kernel(sigma, size)
    return [conv_sql(f"{name}_x", [k], src, border), conv_sql(name, [[v] for v in k], f"{name}_x", border)]


def near_sql(name: str, offsets: dict, border: str = "replicate", src: str = "raster", column: str = "value") -> str:
    fold = FOLD[border]
    joins_ = "".join(f"""
  LEFT JOIN {src} {n} ON {n}."row" = ({fold(f'a."row" + {r}', 'b.r0', 'b.r1')}) AND {n}.col = ({fold(f'a.col + {c}', 'b.c0', 'b.c1')})""" for n, (r, c) in offsets.items())
    return f"""{name} AS (SELECT a."row", a.col, {', '.join(f'{n}.{column} AS {n}' for n in offsets)} FROM {src} a CROSS JOIN b{joins_})"""


def _r(body: str, ctes: list[str] | None = None) -> str:
    return d.select_sql([d.RASTER, BOUNDS] + (ctes or []), body)


def cells(expressions: dict[str, str], source: str, digits: int = 5) -> str:
    return 'SELECT "row", col, ' + ", ".join(f"{Q(e, digits)} AS {n}" for n, e in expressions.items()) + f" FROM {source}"


def rounded(df, *names, digits: int = 5):
    return df.select("row", "col", *(q(n, digits).alias(n) for n in names))


KERNEL = [[0.5, 1, 0, 0, 0], [0, 2, 0, 0, 0], [0, 0, -3, 0, 0.25], [0, 0, 0, 1, 0], [0, 0, 0, 0, 4]]

for _border in ("zero", "replicate", "reflect", "mirror"):
    def _conv(spark, sf, border=_border):
        return rounded(raster.conv2d(d.raster(spark, sf), KERNEL, border=border), "value")
    query(f"conv2d_{_border}", _r(cells({"value": "value"}, "k"), [conv_sql("k", KERNEL, border=_border)]))(_conv)

D4 = {"c": (0, 0), "e": (0, 2), "w": (0, -2), "s": (2, 0), "n": (-2, 0), "se": (2, 2), "nw": (-2, -2), "sw": (2, -2), "ne": (-2, 2)}
D4_OUT = {"zx": "(e - w) / 4", "zy": "(s - n) / 4", "zxx": "(e + w - 2 * c) / 4", "zyy": "(s + n - 2 * c) / 4", "zxy": "(se + nw - sw - ne) / 16"}


@query("derivatives4", _r(cells(D4_OUT, "n"), [near_sql("n", D4)]))
def derivatives4(spark, sf):
    return rounded(raster.derivatives4(d.raster(spark, sf), 2), *D4_OUT)


@query("derivatives8", _r(cells({"value": "value"}, "k"), [conv_sql("k", [[1, 1, 1], [1, -8, 1], [1, 1, 1]], border="replicate")]))
def derivatives8(spark, sf):
    return rounded(raster.derivatives8(d.raster(spark, sf)), "value")


SX, SY = raster.SOBEL_X, raster.SOBEL_Y
SOBEL2 = [conv_sql("fx", SX, border="reflect", out="value"), conv_sql("fy", SY, border="reflect"),
          conv_sql("fxx", SX, "fx", "reflect"), conv_sql("fyy", SY, "fy", "reflect"), conv_sql("fxy", SY, "fx", "reflect")]


@query("sobel", _r(f"""SELECT "row", col, {', '.join(f"{Q(f'{s}.value')} AS z{s[1:]}" for s in ('fx', 'fy', 'fxx', 'fyy', 'fxy'))}
FROM fx JOIN fy USING ("row", col) JOIN fxx USING ("row", col) JOIN fyy USING ("row", col) JOIN fxy USING ("row", col)""", SOBEL2))
def sobel(spark, sf):
    return rounded(raster.sobel(d.raster(spark, sf), 2), "zx", "zy", "zxx", "zyy", "zxy", digits=6)


@query("gradient", _r(f"""SELECT "row", col, {Q('abs(fx.value) + abs(fy.value)')} AS l1, {Q('sqrt(fx.value ** 2 + fy.value ** 2)')} AS l2 FROM fx JOIN fy USING ("row", col)""", SOBEL2[:2]))
def gradient(spark, sf):
    r = d.raster(spark, sf)
    a, b = raster.gradient(r, "L1"), raster.gradient(r, "L2")
    return a.withColumnRenamed("value", "l1").join(b.withColumnRenamed("value", "l2"), ["row", "col"]).select("row", "col", q("l1").alias("l1"), q("l2").alias("l2"))


@query("gradient_log", _r(cells({"value": "value"}, "k"), [conv_sql("k", [[((x * x + y * y - 2) / 1.0) * math.exp(-(x * x + y * y) / 2) / (2 * math.pi) for x in range(-4, 5)] for y in range(-4, 5)], border="mirror")]))
def gradient_log(spark, sf):
    return rounded(raster.gradient(d.raster(spark, sf), "LoG", 1.0), "value")


@query("gaussian_blur", _r(cells({"value": "value"}, "g"), blur_sql("g", 1.0)))
def gaussian_blur(spark, sf):
    return rounded(raster.gaussian_blur(d.raster(spark, sf), 1.0), "value")


@query("dog", _r(f"""SELECT "row", col, {Q('h.value - g.value', 5)} AS value FROM g JOIN h USING ("row", col)""", blur_sql("g", 0.8) + blur_sql("h", 1.3)))
def dog(spark, sf):
    return rounded(raster.dog(d.raster(spark, sf), 1.3, 0.8), "value")


@query("frequency_saliency", _r(f"""SELECT "row", col, {Q('(abs(raster.value - (g2.value - g1.value)) + abs(raster.value - (g3.value - g2.value))) / 2', 5)} AS value
FROM raster JOIN g1 USING ("row", col) JOIN g2 USING ("row", col) JOIN g3 USING ("row", col)""", blur_sql("g1", size=3) + blur_sql("g2", size=5) + blur_sql("g3", size=7)))
def frequency_saliency(spark, sf):
    return rounded(raster.frequency_saliency(d.raster(spark, sf), [3, 5, 7], by_size=True), "value")


def _box(name, n):
    return [conv_sql(f"{name}_x", [[1.0 / n] * n]), conv_sql(name, [[1.0 / n]] * n, f"{name}_x")]


@query("contrast_saliency", _r(f"""SELECT "row", col, {Q('(abs(s.value - l1.value) + abs(s.value - l2.value)) / 2', 5)} AS value FROM s JOIN l1 USING ("row", col) JOIN l2 USING ("row", col)""",
                               _box("s", 3) + _box("l1", 9) + _box("l2", 5)))
def contrast_saliency(spark, sf):
    return rounded(raster.contrast_saliency(d.raster(spark, sf), 3, [9, 5]), "value")


def _context_sql(size: int, k: int) -> list[str]:
    """Context saliency of one patch size by comparing all pixels."""
    n = f"c{size}"
    return [conv_sql(f"{n}_x", [[1.0 / size] * size], border="reflect"), conv_sql(f"{n}_a", [[1.0 / size]] * size, f"{n}_x", "reflect"),
            f"""{n}_v AS (SELECT "row", col, ("row" - r0)::BIGINT * (c1 - c0 + 1) + col - c0 AS i,
  floor((value - lo) / (hi - lo) * 1000000 + 0.4876543::DOUBLE)::BIGINT AS v FROM {n}_a, b, (SELECT min(value) AS lo, max(value) AS hi FROM {n}_a))""",
            f"""{n}_n AS (SELECT q.i AS qi, p."row", p.col, abs(q.v - p.v) AS d, sqrt((q."row" - p."row") ** 2 + (q.col - p.col) ** 2) AS far
  FROM {n}_v q, {n}_v p WHERE q.i % {size // 2} = 0 QUALIFY row_number() OVER (PARTITION BY q.i ORDER BY abs(q.v - p.v), p.i) <= {k})""",
            f"{n}_s AS (SELECT qi, 1 - exp(-avg(d / 1000000.0::DOUBLE / (1 + 3 * far))) AS s FROM {n}_n GROUP BY 1)",
            f"""{n}_l AS (SELECT "row", col, max(qi) AS qi FROM (SELECT "row", col, qi FROM {n}_n UNION ALL SELECT "row", col, i FROM {n}_v WHERE i % {size // 2} = 0) GROUP BY 1, 2)""",
            f'{n} AS (SELECT "row", col, coalesce(s, 0) AS value FROM {n}_v LEFT JOIN {n}_l USING ("row", col) LEFT JOIN {n}_s USING (qi))']


@query("context_saliency", _r(f"""SELECT "row", col, {Q('(c4.value + c2.value + 0) / 3')} AS value FROM c4 JOIN c2 USING ("row", col)""", _context_sql(4, 16) + _context_sql(2, 16)))
def context_saliency(spark, sf):
    return context.context_saliency(d.raster(spark, sf), 4, 3, 16).select("row", "col", q("value").alias("value"))


_TOTAL = [[sum(k[i][j] for k in raster.directional_kernels(5)) for j in range(5)] for i in range(5)]


@query("directional_saliency_raster", _r(cells({"value": "(value - lo) / (hi - lo)"}, "k, (SELECT min(value) AS lo, max(value) AS hi FROM k)"), [
    'm AS (SELECT "row", col, 0.5::DOUBLE * value + 0.25::DOUBLE * (value * value / 100) AS value FROM raster)', conv_sql("k", [r[::-1] for r in _TOTAL[::-1]], "m")]))
def directional_saliency_raster(spark, sf):
    r = d.raster(spark, sf)
    squared = r.withColumn("value", C("value") * C("value") / 100)
    return rounded(raster.directional_saliency_raster([r, squared], [0.5, 0.25], 5), "value")


_RING = [[-1.0 if (i, j) == (2, 2) else math.exp(-((math.hypot(i - 2, j - 2) - 1.5) ** 2) / (2 * 0.49)) / (math.sqrt(2 * math.pi) * 0.7) for j in range(5)] for i in range(5)]


@query("ring_saliency_raster", _r(f"""SELECT "row", col, {Q('abs(k.value) * 0.5 + raster.value / 100 * 0.5', 5)} AS value FROM k JOIN raster USING ("row", col)""", [conv_sql("k", _RING, border="mirror")]))
def ring_saliency_raster(spark, sf):
    r = d.raster(spark, sf)
    return rounded(raster.ring_saliency_raster(r, r.withColumn("value", C("value") / 100), 5, 1.5, 0.7), "value")


@query("principal_curvatures_raster", _r(cells({"k1": "(zxx + zyy + sqrt((zxx - zyy) ** 2 + 4 * zxy * zxy)) / 2", "k2": "(zxx + zyy - sqrt((zxx - zyy) ** 2 + 4 * zxy * zxy)) / 2"}, "x"), [
    near_sql("n", {k: (r // 2, c // 2) for k, (r, c) in D4.items()}),
    'x AS (SELECT "row", col, e + w - 2 * c AS zxx, s + n - 2 * c AS zyy, (se + nw - sw - ne) / 4 AS zxy FROM n)']))
def principal_curvatures_raster(spark, sf):
    return rounded(raster.principal_curvatures_raster(d.raster(spark, sf)), "k1", "k2")


WIN = {n: (r, c) for n, (r, c) in zip(("wa", "wb", "wc", "wd", "we", "wf", "wg", "wh", "wi"), [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)])}
TERRAIN = [near_sql("n0", WIN), 'n1 AS (SELECT "row", col, ' + ", ".join(f"coalesce({w}, we) AS {w[1]}" for w in WIN) + " FROM n0)",
           """n2 AS (SELECT *, ((c + 2*f + i) - (a + 2*d + g)) / 8 AS zx, ((g + 2*h + i) - (a + 2*b + c)) / 8 AS zy, (d + f) / 2 - e AS td, (b + h) / 2 - e AS te,
  (c + g - a - i) / 4 AS tf, (f - d) / 2 AS tg, (b - h) / 2 AS th FROM n1)"""]


@query("terrain", _r(cells({"slope": "sqrt(zx*zx + zy*zy)", "slope_deg": "degrees(atan(sqrt(zx*zx + zy*zy)))",
                            "aspect": "CASE WHEN zx = 0 AND zy = 0 THEN 0 WHEN degrees(atan2(zy, -zx)) > 90 THEN 450 - degrees(atan2(zy, -zx)) ELSE 90 - degrees(atan2(zy, -zx)) END",
                            "curvature": "-200 * (td + te)",
                            "planform": "CASE WHEN tg*tg + th*th > 0 THEN -200 * (td*th*th + te*tg*tg - tf*tg*th) / (tg*tg + th*th) ELSE 0 END",
                            "profile": "CASE WHEN tg*tg + th*th > 0 THEN 200 * (td*tg*tg + te*th*th + tf*tg*th) / (tg*tg + th*th) ELSE 0 END"}, "n2", 4), TERRAIN))
def terrain(spark, sf):
    return rounded(raster.terrain(d.raster(spark, sf)), "slope", "slope_deg", "aspect", "curvature", "planform", "profile", digits=4)


@query("hillshade", _r(cells({"value": "255 * (sin(radians(45)) * sin(s) + cos(radians(45)) * cos(s) * cos(radians(315) - asp) + 1) / 2"}, "t", 4), [
    near_sql("nn", {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1), "c": (0, 0)}, "zero"),
    """g AS (SELECT "row", col, CASE WHEN n IS NOT NULL AND s IS NOT NULL THEN (s - n) / 2 WHEN s IS NOT NULL THEN s - c WHEN n IS NOT NULL THEN c - n ELSE 0 END AS dr,
  CASE WHEN w IS NOT NULL AND e IS NOT NULL THEN (e - w) / 2 WHEN e IS NOT NULL THEN e - c WHEN w IS NOT NULL THEN c - w ELSE 0 END AS dc FROM nn)""",
    't AS (SELECT "row", col, pi() / 2 - atan(sqrt(dr*dr + dc*dc)) AS s, atan2(-dr, dc) AS asp FROM g)']))
def hillshade(spark, sf):
    return rounded(raster.hillshade(d.raster(spark, sf)), "value", digits=4)


@query("nonmax_suppression", _r(cells({"value": """CASE WHEN (k = 0 AND we >= wd AND we >= wf) OR (k = 1 AND we >= wc AND we >= wg) OR (k = 2 AND we >= wb AND we >= wh) OR (k = 3 AND we >= wa AND we >= wi) THEN we ELSE 0 END"""}, "t"),
                                SOBEL2[:2] + [near_sql("n0", WIN, "zero"), """t AS (SELECT n0.*, floor(((t + 22.5::DOUBLE) % 180) / 45) AS k FROM n0 JOIN (
  SELECT "row", col, CASE WHEN a < 0 THEN a + 360 ELSE a END AS t FROM (SELECT "row", col, degrees(atan2(fx.value, fy.value)) AS a FROM fx JOIN fy USING ("row", col))) USING ("row", col))"""]))
def nonmax_suppression(spark, sf):
    return rounded(raster.nonmax_suppression(d.raster(spark, sf)), "value")


GRID = 'grid AS (SELECT r::INT AS "row", c::INT AS col FROM b, generate_series(r0, r1) x(r), generate_series(c0, c1) y(c))'


@query("fill_void", _r(f"""SELECT "row", col, {Q('coalesce(value, m)')} AS value FROM grid LEFT JOIN raster USING ("row", col), (SELECT avg(value) AS m FROM raster)""", [GRID]))
def fill_void(spark, sf):
    return raster.fill_void(d.raster(spark, sf)).select("row", "col", q("value").alias("value"))


@query("raster_to_points", _r(f"""SELECT {Q('0.5 * col + 100')} AS x, {Q('-0.25 * "row" + 50')} AS y, {Q('value')} AS z FROM raster WHERE 0.5 * col + 100 BETWEEN 102 AND 110 AND -0.25 * "row" + 50 BETWEEN 20 AND 45"""))
def raster_to_points(spark, sf):
    return raster.raster_to_points(d.raster(spark, sf), 100.0, 50.0, 0.5, -0.25, (102, 20, 110, 45)).select(q("x").alias("x"), q("y").alias("y"), q("z").alias("z"))


@query("world_to_pixel", d.select_sql(d.PTS, f"SELECT point_id, {Q('(y - 50) / -0.25')} AS row_f, {Q('(x - 100) / 0.5')} AS col_f FROM pts"))
def world_to_pixel(spark, sf):
    p = raster.world_to_pixel(C("x"), C("y"), 100.0, 50.0, 0.5, -0.25)
    return d.points(spark, sf).select("point_id", q(p["row"]).alias("row_f"), q(p["col"]).alias("col_f"))


@query("points_to_raster", d.select_sql(d.PTS, f"""SELECT floor((y - y0) / 2.0::DOUBLE)::INT AS "row", floor((x - x0) / 2.0::DOUBLE)::INT AS col, {Q('avg(z)')} AS value FROM pts, (SELECT min(x) AS x0, min(y) AS y0 FROM pts) GROUP BY 1, 2"""))
def points_to_raster(spark, sf):
    return raster.points_to_raster(d.points(spark, sf), 2.0).select("row", "col", q("value").alias("value"))


@query("interpolate_nearest", d.select_sql([d.SMALL, "e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts)",
    'g AS (SELECT r::INT AS "row", c::INT AS col, x0 + c * 0.02::DOUBLE AS gx, y0 + r * 0.02::DOUBLE AS gy FROM e, generate_series(0, ceil((y1 - y0) / 0.02::DOUBLE)::INT - 1) a(r), generate_series(0, ceil((x1 - x0) / 0.02::DOUBLE)::INT - 1) b(c))'],
    f"""SELECT "row", col, {Q('z')} AS value FROM (SELECT "row", col, z, row_number() OVER (PARTITION BY "row", col ORDER BY sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)), point_id) AS k FROM g, pts) WHERE k = 1"""))
def interpolate_nearest(spark, sf):
    return raster.interpolate_nearest(d.small_points(spark, sf), 0.02).select("row", "col", q("value").alias("value"))


PLACES = "places AS (SELECT c_custkey AS point_id, (c_custkey % 1490) / 10.0::DOUBLE AS pr, (c_custkey * 7 % 290) / 10.0::DOUBLE AS pc FROM customer)"


@query("sample_raster_at_points", _r(f"""SELECT point_id, {Q('CASE WHEN NOT bool_or(w > 0 AND value IS NULL) THEN sum(w * value) END', 5)} AS value FROM (
  SELECT point_id, CASE WHEN i = 1 THEN fr ELSE 1 - fr END * CASE WHEN j = 1 THEN fc ELSE 1 - fc END AS w, value FROM (
    SELECT point_id, floor(pr) + i AS rr, floor(pc) + j AS cc, pr - floor(pr) AS fr, pc - floor(pc) AS fc, i, j FROM places, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j))
  LEFT JOIN raster ON "row" = rr AND col = cc) GROUP BY point_id""", [PLACES]))
def sample_raster_at_points(spark, sf):
    places = d.table(spark, sf, "customer").select(C("c_custkey").alias("point_id"), ((C("c_custkey") % 1490) / 10.0).alias("row"), ((C("c_custkey") * 7 % 290) / 10.0).alias("col"))
    return raster.sample_raster(places, d.raster(spark, sf)).select("point_id", q("value", 5).alias("value"))


@query("resample_raster", _r(f"""SELECT gr AS "row", gc AS col, {Q('CASE WHEN NOT bool_or(w > 0 AND value IS NULL) THEN sum(w * value) END', 5)} AS value FROM (
  SELECT gr, gc, CASE WHEN i = 1 THEN fr ELSE 1 - fr END * CASE WHEN j = 1 THEN fc ELSE 1 - fc END AS w, value FROM (
    SELECT gr, gc, floor(pr) + i AS rr, floor(pc) + j AS cc, pr - floor(pr) AS fr, pc - floor(pc) AS fc, i, j FROM (
      SELECT "row" AS gr, col AS gc, r0 + 0.25::DOUBLE + ("row" - r0) * 2.5::DOUBLE AS pr, c0 + 0.5::DOUBLE + (col - c0) * 2.5::DOUBLE AS pc, r1, c1 FROM grid, b), (VALUES (0),(1)) a(i), (VALUES (0),(1)) z(j) WHERE pr <= r1 AND pc <= c1)
  LEFT JOIN raster ON "row" = rr AND col = cc) GROUP BY 1, 2""", [GRID]))
def resample_raster(spark, sf):
    return raster.resample_raster(d.raster(spark, sf), 0.25, 0.5, 2.5).select("row", "col", q("value", 5).alias("value"))


@query("map_algebra", _r(f"""SELECT "row", col, {Q('a.value * 2 - b2.value / 3')} AS value FROM raster a JOIN (SELECT user_id::INT AS "row", (dayofyear(ts) - 1)::INT AS col, max(value) AS value FROM events GROUP BY 1, 2) b2 USING ("row", col)"""))
def map_algebra(spark, sf):
    high = d.table(spark, sf, "events").groupBy(C("user_id").cast("int").alias("row"), (F.dayofyear("ts") - 1).cast("int").alias("col")).agg(F.max("value").alias("value"))
    return raster.map_algebra({"a": d.raster(spark, sf), "b": high}, "a * 2 - b / 3").select("row", "col", q("value").alias("value"))


@query("reclassify", _r(cells({"value": "CASE WHEN value BETWEEN 40 AND 60 THEN 2 WHEN value BETWEEN 0 AND 50 THEN 1 ELSE value END"}, "raster")))
def reclassify(spark, sf):
    return rounded(raster.reclassify(d.raster(spark, sf), [(0, 50, 1), (40, 60, 2)]), "value")


@query("apply_lut", 'SELECT user_id::INT AS "row", event_id::INT AS col, CASE event_type WHEN \'click\' THEN 1.0::DOUBLE WHEN \'view\' THEN 2.0::DOUBLE ELSE length(event_type)::DOUBLE + 10 END AS value FROM events')
def apply_lut(spark, sf):
    cells_ = d.table(spark, sf, "events").select(C("user_id").cast("int").alias("row"), C("event_id").cast("int").alias("col"),
        F.when(C("event_type") == "click", -1.0).when(C("event_type") == "view", -2.0).otherwise(F.length("event_type").cast("double") + 10).alias("value"))
    lut = d.table(spark, sf, "region").where("r_regionkey < 2").select((-1.0 - C("r_regionkey")).alias("key"), (1.0 + C("r_regionkey")).alias("new"))
    return raster.apply_lut(cells_, lut)


@query("mosaic", _r(f"""SELECT "row", col, {Q('coalesce(n.value, raster.value)')} AS value FROM raster FULL JOIN (SELECT "row" + 1 AS "row", col, value * 2 AS value FROM raster WHERE value > 50) n USING ("row", col)"""))
def mosaic(spark, sf):
    r = d.raster(spark, sf)
    second = r.select((C("row") + 1).alias("row"), "col", F.when(C("value") > 50, C("value") * 2).alias("value"))
    return raster.mosaic([r, second]).select("row", "col", q("value").alias("value"))


@query("raster_histogram", _r("SELECT least(15, floor(value / 10))::INT AS bin, count(*) AS n FROM raster WHERE value BETWEEN 0 AND 160 GROUP BY 1"))
def raster_histogram(spark, sf):
    from cloudframe.operators.saliency import histogram
    return histogram(d.raster(spark, sf), "value", 0.0, 160.0, 16)


@query("raster_diff", _r(f"""SELECT count(*) FILTER (WHERE a.value IS DISTINCT FROM b2.value) AS n_diff, {Q('max(abs(a.value - b2.value))')} AS max_diff FROM raster a FULL JOIN (SELECT "row" + 1 AS "row", col, value FROM raster) b2 USING ("row", col)"""))
def raster_diff(spark, sf):
    r = d.raster(spark, sf)
    return raster.raster_diff(r, r.withColumn("row", C("row") + 1)).select("n_diff", q("max_diff").alias("max_diff"))


@query("region_means", _r(f"SELECT {Q('sum(value * h) / sum(h)', 4)} AS c1, {Q('sum(value * (1 - h)) / sum(1 - h)', 4)} AS c2 FROM (SELECT value, 0.5 * (1 + 2 / pi() * atan((value - 50) / 5)) AS h FROM raster)"))
def region_means(spark, sf):
    r = d.raster(spark, sf)
    return raster.region_means(r, r.withColumn("value", raster.heaviside(C("value") - 50, 5.0, 2))).select(q("c1", 4).alias("c1"), q("c2", 4).alias("c2"))


@query("heaviside_dirac", _r(cells({"h0": "CASE WHEN x >= 0 THEN 1 ELSE 0 END", "h1": "CASE WHEN x > 5 THEN 1 WHEN x < -5 THEN 0 ELSE 0.5 * (1 + x / 5 + sin(pi() * x / 5) / pi()) END",
    "h2": "0.5 * (1 + 2 / pi() * atan(x / 5))", "d0": "CASE WHEN abs(x) <= 5 THEN 1 ELSE 0 END", "d1": "CASE WHEN abs(x) <= 5 AND (1 + cos(pi() * x / 5)) / 10 >= 2e-5 THEN (1 + cos(pi() * x / 5)) / 10 ELSE 0 END",
    "d2": "CASE WHEN 5 / pi() / (25 + x * x) < 2e-5 THEN 0 ELSE 5 / pi() / (25 + x * x) END"}, '(SELECT "row", col, value - 50 AS x FROM raster)')))
def heaviside_dirac(spark, sf):
    x = C("value") - 50
    named = {f"h{k}": raster.heaviside(x, 5.0, k) for k in range(3)} | {f"d{k}": raster.dirac(x, 5.0, k) for k in range(3)}
    return d.raster(spark, sf).select("row", "col", *(q(e, 5).alias(n) for n, e in named.items()))


@query("levelset_geometry", _r(cells({"l1": "abs(zx) + abs(zy)", "l2": "sqrt(zx*zx + zy*zy)", "kappa": "(zxx*zy*zy + zyy*zx*zx - 2*zxy*zx*zy) / (sqrt(zx*zx + zy*zy) + 2.220446049250313e-16)"}, "z", 4), [
    near_sql("n", {k: (r // 2, c // 2) for k, (r, c) in D4.items()}),
    'z AS (SELECT "row", col, ' + ", ".join(f"CASE WHEN abs({e}) < 1e-5 THEN 0 ELSE {e} END AS {n}" for n, e in {"zx": "(e - w) / 2", "zy": "(s - n) / 2", "zxx": "e + w - 2 * c", "zyy": "s + n - 2 * c", "zxy": "(se + nw - sw - ne) / 4"}.items()) + " FROM n)"]))
def levelset_geometry(spark, sf):
    return rounded(raster.levelset_geometry(d.raster(spark, sf)), "l1", "l2", "kappa", digits=4)


@query("signed_distance_shapes", _r(cells({"circle": 'm * 0.5 - sqrt(((col - 15) * 0.5) ** 2 + (("row" - 60) * 0.5) ** 2)', "ellipse": 'sqrt(((col - 15) * 0.5 / 4) ** 2 + (("row" - 60) * 0.5 / 9) ** 2) - 1',
    "checker": 'sin(pi() / 30 * col) * sin(pi() / 30 * "row")'}, 'raster, (SELECT 12.0::DOUBLE AS m)')))
def signed_distance_shapes(spark, sf):
    r, c = C("row"), C("col")
    return d.raster(spark, sf).select("row", "col", q(raster.signed_distance("circle", r, c, center=(60, 15), radius=12.0), 5).alias("circle"),
        q(raster.signed_distance("ellipse", r, c, center=(60, 15), axes=(4.0, 9.0)), 5).alias("ellipse"), q(raster.signed_distance("checkerboard", r, c, denominator=30), 5).alias("checker"))


@query("raster_neighbors", _r("""SELECT a."row", a.col, n."row" AS nrow, n.col AS ncol FROM raster a JOIN raster n ON n."row" BETWEEN a."row" - 2 AND a."row" + 2 AND n.col BETWEEN a.col - 2 AND a.col + 2 WHERE NOT (a."row" = n."row" AND a.col = n.col)"""))
def raster_neighbors(spark, sf):
    return joins.raster_neighbors(d.raster(spark, sf), 5).select("row", "col", "nrow", "ncol")


@query("expand_bounds", _r(f"""SELECT "row", col, {Q('value')} AS value, "inner" FROM (SELECT x.r::INT AS "row", y.c::INT AS col, value, x.r BETWEEN r0 AND r1 AND y.c BETWEEN c0 AND c1 AS "inner" FROM b, generate_series(r0 - 3, r1 + 3) x(r), generate_series(c0 - 3, c1 + 3) y(c)
JOIN raster s ON s."row" = ({FOLD['mirror']('x.r', 'r0', 'r1')}) AND s.col = c0 + (y.c - c0 + (c1 - c0 + 1)) % (c1 - c0 + 1))"""))
def expand_bounds(spark, sf):
    """Panorama border: columns wrap, rows mirror."""
    return raster.expand_bounds(d.raster(spark, sf), 3, "panorama").select("row", "col", q("value").alias("value"), "inner")


@query("shrink_bounds", _r(cells({"value": "value"}, "raster")))
def shrink_bounds(spark, sf):
    return rounded(raster.shrink_bounds(raster.expand_bounds(d.raster(spark, sf), 4, "mirror")), "value")


@query("label_components", _r("""SELECT "row", col, first(root_row)::INT AS root_row, first(root_col)::INT AS root_col, first(area) AS area FROM (
  SELECT c, r // 100000 AS "row", r % 100000 AS col, root // 100000 AS root_row, root % 100000 AS root_col, area FROM (SELECT r, min(s) AS root, r AS c FROM reach GROUP BY r)
  JOIN (SELECT root AS root2, count(*) AS area FROM (SELECT r, min(s) AS root FROM reach GROUP BY r) GROUP BY 1) ON root = root2 WHERE area >= 3) GROUP BY 1, 2""".replace('SELECT "row", col, first', 'SELECT "row"::INT AS "row", col::INT AS col, first')).replace("WITH raster", "WITH RECURSIVE raster").replace(BOUNDS, BOUNDS + """,
m AS (SELECT "row" * 100000 + col AS i, "row", col FROM raster WHERE value > 55),
link AS (SELECT a.i AS p, c.i AS n FROM m a JOIN m c ON abs(a."row" - c."row") + abs(a.col - c.col) = 1),
reach AS (SELECT i AS r, i AS s FROM m UNION SELECT link.n, reach.s FROM reach JOIN link ON link.p = reach.r)"""))
def label_components(spark, sf):
    return graph.label_components(d.raster(spark, sf).where("value > 55"), 4, 3).select(
        "row", "col", C("component.row").alias("root_row"), C("component.col").alias("root_col"), "area")


# --- panoramas ------------------------------------------------------------------------------------------------------------

PANO = """pano AS (SELECT "row", col, max(point_id) AS point_id, arg_max(range, point_id) AS range, arg_max(intensity, point_id) AS value FROM (
  SELECT *, floor((e1 - el) / 1.0::DOUBLE)::INT AS "row", floor((az - a0) / 1.0::DOUBLE)::INT AS col FROM sph, (SELECT min(az) AS a0, max(el) AS e1 FROM sph)) GROUP BY 1, 2)"""


def _pano(spark, sf):
    return raster.panorama(_sph(spark, sf), 1.0, 1.0)


@query("panorama", d.select_sql([d.PTS, SPH, PANO], f"""SELECT "row", col, point_id, {Q('range')} AS range, {Q('value')} AS value FROM pano"""))
def panorama(spark, sf):
    return _pano(spark, sf).select("row", "col", "point_id", q("range").alias("range"), q("value").alias("value"))


@query("pano_angles", d.select_sql([d.PTS, SPH, PANO], f"""SELECT "row", col, {Q('radians(col * 1.0::DOUBLE)')} AS az, {Q('pi() / 2 - radians("row" * 1.0::DOUBLE)')} AS el FROM pano"""))
def pano_angles(spark, sf):
    a = raster.pano_angles(C("row"), C("col"), 1.0, 1.0)
    return _pano(spark, sf).select("row", "col", q(a["az"]).alias("az"), q(a["el"]).alias("el"))


@query("extract_area", d.select_sql([d.PTS, SPH, PANO], """SELECT point_id FROM pano WHERE "row" > 5 AND "row" < 40 AND col > 10 AND col < 60"""))
def extract_area(spark, sf):
    return points.extract_area(_pano(spark, sf), (5, 10), (40, 60)).select("point_id")


@query("adaptive_smoothing", d.select_sql([d.PTS, SPH, PANO, """s AS (SELECT "row", col, 2.5::DOUBLE * 0.05::DOUBLE / (range * 0.0175::DOUBLE) AS s FROM pano WHERE range > 0)"""],
    f"""SELECT a."row", a.col, {Q('sum(exp(-((n."row" - a."row") ** 2 + (n.col - a.col) ** 2) / (2 * s * s)) * n.range) / sum(exp(-((n."row" - a."row") ** 2 + (n.col - a.col) ** 2) / (2 * s * s)))')} AS value
FROM s a JOIN pano n ON abs(n."row" - a."row") <= ceil(2 * s + 1)::INT // 2 AND abs(n.col - a.col) <= ceil(2 * s + 1)::INT // 2 GROUP BY 1, 2"""))
def adaptive_smoothing(spark, sf):
    return raster.adaptive_smoothing(_pano(spark, sf), 0.05, 0.0175).select("row", "col", q("value").alias("value"))


@query("adaptive_derivatives", d.select_sql([d.PTS, SPH, PANO, 'b AS (SELECT min("row") AS r0, max("row") - min("row") + 1 AS h, min(col) AS c0, max(col) - min(col) + 1 AS w FROM pano)',
    'p AS (SELECT "row", col, ceil(0.5::DOUBLE / (range * 0.0175::DOUBLE))::INT AS d FROM pano WHERE range > 0)',
    """t AS (SELECT p."row", p.col, d, k, r0 + CASE WHEN tr < h THEN tr ELSE 2 * h - 1 - tr END AS nr, c0 + (((p.col - c0 + dc * d) % w) + w) % w AS nc FROM (
  SELECT p.*, k, dc, h, w, r0, c0, (((p."row" - r0 + dr * d) % (2 * h)) + 2 * h) % (2 * h) AS tr FROM p, b, (VALUES ('e', 0, 1), ('w', 0, -1), ('s', 1, 0), ('n', -1, 0)) v(k, dr, dc)) p)""",
    """g AS (SELECT t."row", t.col, any_value(d) AS d, max(value) FILTER (WHERE k = 'e') AS e, max(value) FILTER (WHERE k = 'w') AS w, max(value) FILTER (WHERE k = 's') AS s, max(value) FILTER (WHERE k = 'n') AS n
  FROM t LEFT JOIN (SELECT "row" AS nr, col AS nc, value FROM pano) USING (nr, nc) GROUP BY 1, 2)"""],
    f"""SELECT "row", col, {Q('(e - w) / (2 * 0.0175::DOUBLE * d)')} AS zx, {Q('(s - n) / (2 * 0.0175::DOUBLE * d)')} AS zy, {Q('abs((e - w) / (2 * 0.0175::DOUBLE * d)) + abs((s - n) / (2 * 0.0175::DOUBLE * d))')} AS l1 FROM g"""))
def adaptive_derivatives(spark, sf):
    pano = _pano(spark, sf)
    both = raster.adaptive_derivatives(pano, 0.5, 0.0175).join(raster.adaptive_gradient(pano, 0.5, 0.0175, "L1").withColumnRenamed("value", "l1"), ["row", "col"])
    return both.select("row", "col", q("zx").alias("zx"), q("zy").alias("zy"), q("l1").alias("l1"))


@query("panorama_neighbors")
def panorama_neighbors(spark, sf):
    return raster.panorama_neighbors(_pano(spark, sf), 0.5, 1.0, 1.0)


@query("normals_panorama")
def normals_panorama(spark, sf):
    return raster.normals_panorama(_pano(spark, sf), 1.0, 1.0)
