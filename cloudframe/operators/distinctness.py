"""Distinctness of points by their feature histograms: exact comparison with the whole cloud.

The root of the chi-square distance of histograms is a metric.  A bounded number of pivots therefore bounds the distance of
a point to every member of a pivot's cell, and a point visits only the cells that can hold its farthest histogram, and then
only those that can hold one close enough.  Points and members of a cell meet in blocks of bounded size: rows are dealt by
cell, part of the cell and chunk of the points, so a cell with any share of the cloud is as many tasks as it needs.  The
high level compares every point with all focus points, as its definition asks; nothing is cut to nearest neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.operators import joins
from cloudframe.operators.tensors import multiplicity

C = F.col
#: Pivots, candidates among which they are chosen (both only change how much is compared), rows of a block and of a tile.
PIVOTS, CANDIDATES, BLOCK, _TILE = 64, 2048, 4096, (64, 256)
#: Keeps empty bins from dividing by zero.
TINY = 1e-10
# Bounds are widened by this share for what the rounding and the summand above may take off.
_SLACK = 1e-6
_ROW = "point_id string, x double, y double, z double, m double, h binary"


def chi2_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chi-square distance of each row of ``a`` to each of ``b``."""
    out = np.zeros((len(a), len(b)))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    # Tiles small enough for the cache of a core; a bin that is empty on both sides adds nothing.
    for i in range(0, out.shape[0], _TILE[0]):
        for j in range(0, out.shape[1], _TILE[1]):
            tile = out[i:i + _TILE[0], j:j + _TILE[1]]
            apart, sums = np.empty(tile.shape), np.empty(tile.shape)
            for x, y in zip(a[:, i:i + _TILE[0]], b[:, j:j + _TILE[1]]):
                if x.any() or y.any():
                    np.subtract(x[:, None], y[None], out=apart)
                    np.add(x[:, None], y[None] + TINY, out=sums)
                    np.multiply(apart, apart, out=apart)
                    np.divide(apart, sums, out=apart)
                    np.add(tile, apart, out=tile)
    return out


def _histograms(column: pa.Array) -> np.ndarray:
    raws = column.to_pylist()
    return np.frombuffer(b"".join(raws)).reshape(len(raws), -1)


def _spread_out(candidates: np.ndarray, count: int) -> np.ndarray:
    """Pivots that lie far from one another: each the candidate farthest from those before it."""
    chosen = [0]
    nearest = chi2_matrix(candidates[:1], candidates)[0]
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, chi2_matrix(candidates[chosen[-1:]], candidates)[0])
    return candidates[chosen]


def placed_by_pivots(points: DataFrame, histograms: DataFrame) -> tuple[DataFrame, list[float], list[int]]:
    """Points with histogram, cell (nearest pivot) and distances ``reach`` to all pivots; radius and size of each cell."""
    rows = points.select("point_id", "x", "y", "z", multiplicity(points).cast("double").alias("m")).join(histograms.select("point_id", "h"), "point_id")
    rows = cut_lineage(rows)
    sample = rows.orderBy(F.xxhash64("point_id"), "point_id").limit(CANDIDATES).select("h").collect()
    if not sample:
        return rows.select("*").withColumn("cell", F.lit(0)).withColumn("reach", F.array(F.lit(0.0))).limit(0), [], []
    pivots = _spread_out(np.array([r.h for r in sample]), PIVOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            reach = np.sqrt(chi2_matrix(h, pivots))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array([v.tobytes() for v in h], pa.binary()),
                                              pa.array(reach.argmin(axis=1).astype(np.int32)), pa.array(list(reach), pa.list_(pa.float64()))],
                                             [*batch.schema.names[:5], "h", "cell", "reach"])

    kind = points.schema["point_id"].dataType.simpleString()
    placed = cut_lineage(rows.mapInArrow(run, f"{_ROW.replace('string', kind, 1)}, cell int, reach array<double>"))
    found = {r.cell: r for r in placed.groupBy("cell").agg(F.max(F.element_at("reach", C("cell") + 1)).alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    cells = range(len(pivots))
    return placed, [found[c].r if c in found else 0.0 for c in cells], [found[c].n if c in found else 0 for c in cells]


def _parts(n: int) -> int:
    return max(1, -(-n // BLOCK))


def _met(asks: DataFrame, targets: DataFrame, parts: list[int], chunks: int, summed: Callable, result: str, far: bool = True) -> DataFrame:
    """Rows of ``asks`` (with ``cell, limit``) and of ``targets`` (with ``cell``) meet by cell in blocks; ``summed`` gets both."""
    columns = ["point_id", "x", "y", "z", "m", "h"]
    sizes = F.array(*(F.lit(p) for p in parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    number = lambda n: F.pmod(F.xxhash64("point_id"), n).cast("int")
    left = asks.select("cell", number(F.lit(chunks)).alias("chunk"), every(F.element_at(sizes, C("cell") + 1)).alias("part"), F.lit(True).alias("asks"), "limit", *columns)
    right = targets.select("cell", every(F.lit(chunks)).alias("chunk"), number(F.element_at(sizes, C("cell") + 1)).alias("part"),
                           F.lit(False).alias("asks"), F.lit(0.0).alias("limit"), *columns)

    def run(table: pa.Table) -> pa.Table:
        asking = table["asks"].to_numpy()
        if asking.all() or not asking.any():
            return pa.Table.from_batches([], schema=shape)
        sides = []
        for side in (asking, ~asking):
            some = table.filter(pa.array(side)).combine_chunks()
            xyz = np.stack([some[a].to_numpy() for a in "xyz"], axis=1)
            sides.append((some["point_id"], xyz, some["m"].to_numpy(), _histograms(some["h"]), some["limit"].to_numpy()))
        (ids, xyz, m, h, limit), (other, there, n, g, _) = sides
        numbers = {v: k for k, v in enumerate(other.to_pylist())}
        own = np.array([numbers.get(v, -1) for v in ids.to_pylist()])
        out = []
        for k in range(0, len(h), 256):
            chi = chi2_matrix(h[k:k + 256], g)
            apart = np.sqrt(sum((xyz[k:k + 256, a, None] - there[None, :, a]) ** 2 for a in range(3))) if far else None
            out.append(summed(chi, apart, m[k:k + 256], n, own[k:k + 256], limit[k:k + 256]))
        return pa.Table.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in zip(*out))], names=shape.names)

    kind = asks.schema["point_id"].dataType
    shape = pa.schema([("point_id", table_type(kind)), *((n.split()[0], pa.float64()) for n in result.split(", "))])
    return left.union(right).groupBy("cell", "part", "chunk").applyInArrow(run, f"point_id {kind.simpleString()}, {result}")


def table_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def low_level_distinctness(points: DataFrame, histograms: DataFrame, share: float = 0.01) -> DataFrame:
    """``point_id, distinctness, farthest, close, compared``: ``1 - exp(-mean(chi2 / (1 + dist)))`` over the other points
    whose chi-square distance is at most ``share`` of the largest to any point; 0 without any.

    ``farthest`` is that largest distance, ``close`` the number of points within the share, ``compared`` that of histograms
    looked at for it.  ``points`` may be positions with a multiplicity ``m``.
    """
    placed, radius, sizes = placed_by_pivots(points, histograms)
    kind = points.schema["point_id"].dataType.simpleString()
    if not sizes:
        return points.sparkSession.createDataFrame([], f"point_id {kind}, distinctness double, farthest double, close bigint, compared bigint")
    parts, chunks = [_parts(n) for n in sizes], _parts(sum(sizes))
    wide = np.array(radius)

    def visiting(rows, test):
        """Rows (with ``limit``) once for each ``cell`` that ``test`` finds in the distances to all pivots."""
        columns = ["point_id", "x", "y", "z", "m", "h", "limit"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reach = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                row, cell = np.nonzero(test(reach, batch.column(6).to_numpy(zero_copy_only=False)[:, None]))
                again = batch.select(columns).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cell.astype(np.int32))], [*columns, "cell"])

        return rows.select(*columns, "reach").mapInArrow(run, f"{_ROW.replace('string', kind, 1)}, limit double, cell int")

    def farthest(asks):
        met = _met(asks, placed, parts, chunks, lambda chi, far, m, n, own, limit: (chi.max(axis=1), np.full(len(chi), float(chi.shape[1]))),
                   "farthest double, compared double", far=False)
        return met.groupBy("point_id").agg(F.max("farthest").alias("farthest"), F.sum("compared").alias("_first"))

    # The cell whose far side is farthest first; then those whose far side is beyond what was found there.
    def first_cell(reach, limit):
        beyond = reach + wide
        return beyond >= beyond.max(axis=1, keepdims=True)

    def later_cells(reach, limit):
        return ~first_cell(reach, limit) & ((reach + wide) * (1 + _SLACK) + _SLACK >= limit)

    first = cut_lineage(farthest(visiting(placed.withColumn("limit", F.lit(0.0)), first_cell)))
    known = placed.join(first.select("point_id", F.sqrt("farthest").alias("limit")), "point_id")
    others = farthest(visiting(known, later_cells))
    largest = first.unionByName(others).groupBy("point_id").agg(F.max("farthest").alias("farthest"), F.sum("_first").alias("_first"))
    largest = cut_lineage(largest)
    limited = placed.join(largest, "point_id").withColumn("limit", C("farthest") * share)
    asks = visiting(limited, lambda reach, limit: reach - wide <= np.sqrt(limit) * (1 + _SLACK) + _SLACK)

    def close(chi, far, m, n, own, limit):
        inside = chi <= limit[:, None]
        weight = np.where(inside, n[None, :], 0.0)
        rows = np.flatnonzero(own >= 0)
        weight[rows, own[rows]] = m[rows] - 1  # the copies of a point, not itself
        return (weight * chi / (1 + far)).sum(axis=1), weight.sum(axis=1), np.full(len(chi), float(chi.shape[1]))

    near = _met(asks, placed, parts, chunks, close, "s double, n double, compared double").groupBy("point_id").agg(*(F.sum(c).alias(c) for c in ("s", "n", "compared")))
    mean = F.coalesce(F.try_divide("s", "n"), F.lit(0.0))
    return near.join(largest, "point_id").select("point_id", (1 - F.exp(-mean)).alias("distinctness"), "farthest", C("n").cast("bigint").alias("close"),
                                                 (C("compared") + C("_first")).cast("bigint").alias("compared"))


def high_level_distinctness(points: DataFrame, foci: DataFrame, histograms: DataFrame) -> DataFrame:
    """``point_id, distinctness``: ``1 - exp(-mean(chi2 * log(1 + dist)))`` over all focus points."""
    packed = F.transform("h", lambda v: v)
    rows = points.select("point_id", "x", "y", "z", multiplicity(points).cast("double").alias("m")).join(histograms.select("point_id", packed.alias("h")), "point_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array([v.tobytes() for v in h], pa.binary())], batch.schema.names)

    kind = points.schema["point_id"].dataType.simpleString()
    rows = cut_lineage(rows.mapInArrow(run, _ROW.replace("string", kind, 1)).withColumns({"cell": F.lit(0), "limit": F.lit(0.0)}))
    targets = cut_lineage(rows.join(foci.select("point_id"), "point_id", "left_semi"))

    def all_(chi, far, m, n, own, limit):
        return (n[None, :] * chi * np.log1p(far)).sum(axis=1), np.full(len(chi), n.sum())

    met = _met(rows, targets, [_parts(targets.count())], _parts(rows.count()), all_, "s double, n double")
    sums = met.groupBy("point_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return points.select("point_id").join(sums, "point_id", "left").select(
        "point_id", (1 - F.exp(-F.coalesce(F.try_divide("s", "n"), F.lit(0.0)))).alias("distinctness"))


def point_association(points: DataFrame, foci: DataFrame, sigma: float = 0.05) -> DataFrame:
    """Distinctness of the nearest focus point, faded with a Gaussian of its distance: ``point_id, association``."""
    nearest = joins.knn(points, foci, 1, include_zero=True)
    score = foci.select(C("point_id").alias("nid"), "distinctness")
    return nearest.join(score, "nid").select("point_id", (
        C("distinctness") * F.exp(-C("dist") * C("dist") / (2 * sigma * sigma))).alias("association"))


def hierarchical_saliency(points: DataFrame, histograms: DataFrame, low_share: float = 0.01, focus_share: float = 0.2, high_share: float = 0.1,
                          sigma: float = 0.05) -> DataFrame:
    """``point_id, saliency, compared``: half low-level distinctness and association to the focus points, half high-level
    distinctness against the most distinct ``high_share``.

    All of it compares with the whole cloud; the high level costs the points times the focus points by its definition.
    """
    from cloudframe.operators.saliency import top_fraction
    histograms = cut_lineage(histograms)
    low = cut_lineage(low_level_distinctness(points, histograms, low_share))
    scored = points.join(low, "point_id")
    foci = cut_lineage(top_fraction(scored, "distinctness", focus_share, "floor"))
    distinct = cut_lineage(top_fraction(scored, "distinctness", high_share, "floor"))
    near = point_association(points, foci, sigma)
    high = high_level_distinctness(points, distinct, histograms).withColumnRenamed("distinctness", "_high")
    return low.join(near, "point_id", "left").join(high, "point_id").select("point_id", (
        0.5 * (C("distinctness") + F.coalesce("association", F.lit(0.0))) + 0.5 * C("_high")).alias("saliency"), "compared")
