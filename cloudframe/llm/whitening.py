"""Whitened principal components of embeddings by QDWH spectral divide-and-conquer.

The vectors become whole numbers, so count, sums, deviations and the covariance are exact however large the table is: tasks
add up products of centred whole numbers and Spark adds up the tasks.  The covariance (dimension by dimension, whatever the
number of rows) is split on the driver: the polar factor of the shifted matrix, found by dynamically weighted Halley
iterations, is its matrix sign, whose projectors split the space into the directions above and below the shift; each part
is split again, the upper one first, until the wanted components lie alone.  Components are a few rows; they are broadcast
and every vector is projected where it lies.

Defined cases: vectors that are NULL, empty or hold NULL, NaN or infinite entries are dropped.  Vectors whose length is not
the commonest one (of equally common lengths the greatest) are of another space and dropped too.  Repeated rows and NULL
ids are rows like any other; other columns are ignored.  Components without variance (an empty table, equal vectors, fewer
different vectors than components) have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm.common import C

EPS = np.finfo(float).eps
#: Entries are counted in units of one part in so many.
UNITS = 256
#: Vectors that a task multiplies at a time.
_BLOCK = 4096


# --- spectral divide-and-conquer --------------------------------------------------------------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations on QR factors."""
    d = len(a)
    x = a / np.linalg.norm(a)  # all singular values are at most 1 now
    # A lower bound of the smallest one; too small a bound costs an iteration or two, no accuracy.
    low, eye = EPS / d, np.eye(d)
    for _ in range(60):
        l2 = low * low
        h = (4 * (1 - l2) / (l2 * l2)) ** (1 / 3)
        root = np.sqrt(1 + h)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * h + 8 * (2 - l2) / (l2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
        new = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 1e-15 and moved < 1e-12 * np.sqrt(d):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None for a multiple of the identity.

    A shift that lies on an eigenvalue gives no projector; the next one is tried.
    """
    d, scale = len(a), np.linalg.norm(a)
    middle = np.trace(a) / d
    if np.linalg.norm(a - middle * np.eye(d)) <= 4 * EPS * d * scale:
        return None
    radii = np.abs(a - np.diag(np.diag(a))).sum(axis=1)
    top, bottom = (np.diag(a) + radii).max(), (np.diag(a) - radii).min()
    shifts = [np.median(np.diag(a)), middle, *(middle + (top - middle) * s for s in (0.03, 0.11, 0.37)),
              *(middle + (bottom - middle) * s for s in (0.03, 0.11, 0.37))]
    best = None
    for shift in shifts:
        shifted = a - shift * np.eye(d)
        if not np.linalg.norm(shifted):
            continue
        projector = (polar(shifted) + np.eye(d)) / 2
        k = int(round(float(np.trace(projector))))
        if not 0 < k < d:
            continue
        # The k strongest columns, pivoted, span the upper space; one step of subspace iteration makes it exact.
        left, basis = projector.copy(), np.empty((d, 0))
        for _ in range(k):
            column = left[:, np.argmax((left * left).sum(axis=0))]
            column = column - basis @ (basis.T @ column)
            column /= np.linalg.norm(column)
            basis = np.column_stack([basis, column])
            left = left - np.outer(column, column @ left)
        whole = np.linalg.qr(projector @ basis, mode="complete")[0]
        upper, lower = whole[:, :k], whole[:, k:]
        wrong = np.linalg.norm(lower.T @ a @ upper)
        if wrong <= 16 * EPS * d * scale:
            return upper, lower
        if best is None or wrong < best[0]:
            best = wrong, upper, lower
    return None if best is None or best[0] > 1e-10 * scale else best[1:]


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Each subspace is split until it is a line or has one eigenvalue only; lower halves that are not asked for stay whole.
    """
    values, vectors = [], []

    def descend(basis: np.ndarray) -> None:
        if len(values) >= count:
            return
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        halves = split(part) if basis.shape[1] > 1 else None
        if halves is None:
            values.extend(np.diag(part))
            vectors.extend(basis.T)
            return
        for half in halves:
            descend(basis @ half)

    descend(np.eye(len(a)))
    vectors = np.array(vectors).reshape(-1, len(a))
    # One Rayleigh step against the whole matrix, then the order by value.
    values = np.einsum("ij,jk,ik->i", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")[:count]
    vectors = vectors[order]
    strongest = np.abs(vectors).argmax(axis=1) if len(vectors) else np.zeros(0, int)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), strongest])[:, None]
    return values[order], vectors.T


# --- whole numbers ----------------------------------------------------------------------------------------------------

def _pack(column: pa.Array, units: int) -> tuple[list[bytes | None], list[int | None]]:
    """``floor(units * entry)`` of each vector as bytes, and its length; None for vectors that are dropped.

    The first byte is the number of bytes an entry takes (0: as many as there is room for), so equal vectors have equal
    bytes.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
    packed: list[bytes | None] = [None] * len(sizes)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        vectors = entries[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(vectors).all(axis=1)
        rows, vectors = rows[good], vectors[good]
        with np.errstate(over="ignore"):
            scaled = np.floor(vectors * units)
        most = np.abs(scaled).max(axis=1)
        done = np.zeros(len(rows), bool)
        for width in (1, 2, 4, 8):
            now = ~done & (most < min(2.0 ** 53, 2.0 ** (8 * width - 1)))
            whole = scaled[now].astype(f"<i{width}")
            for row, vector in zip(rows[now], whole):
                packed[row] = bytes([width]) + vector.tobytes()
            done |= now
        for row, vector in zip(rows[~done], vectors[~done]):
            numbers = [math.floor(Fraction(float(c)) * units) for c in vector]
            width = max(v.bit_length() // 8 + 1 for v in numbers)
            packed[row] = bytes([0]) + b"".join(v.to_bytes(width, "little", signed=True) for v in numbers)
    return packed, [int(s) if p is not None else None for s, p in zip(sizes, packed)]


def _unpacked(raws: list[bytes], d: int) -> np.ndarray:
    """Packed vectors as rows of one matrix of 64-bit numbers, or of Python's if some do not fit."""
    kinds = {raw[0] for raw in raws}
    if kinds <= {1, 2, 4, 8}:
        out = np.empty((len(raws), d), np.int64)
        for kind in kinds:
            where = [i for i, raw in enumerate(raws) if raw[0] == kind]
            out[where] = np.frombuffer(b"".join(raws[i][1:] for i in where), f"<i{kind}").reshape(len(where), d)
        return out
    rows = []
    for raw in raws:
        width = (len(raw) - 1) // d
        rows.append([int.from_bytes(raw[i:i + width], "little", signed=True) for i in range(1, len(raw), width)])
    return np.array(rows, object)


def _products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers without rounding."""
    most = max(1, int(np.abs(y).max()))
    if y.dtype != object and most * most * len(y) < 1 << 53:
        return (y.astype(float).T @ y.astype(float)).astype(np.int64)
    if most * most * len(y) < 1 << 62:
        return y.T @ y
    y = y.astype(object)
    return y.T @ y


def whole_vectors(rows: DataFrame, vec_id: str, embedding: str, units: int) -> tuple[DataFrame, int]:
    """``_id, _packed`` of the rows that stay, and the dimension."""
    kind = rows.schema[vec_id].dataType.simpleString()
    rows = rows.select(C(vec_id).alias("_id"), C(embedding).alias("_vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, sizes = _pack(batch.column(1), units)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())], ["_id", "_packed", "_size"])

    packed = rows.mapInArrow(run, f"_id {kind}, _packed binary, _size int").where(C("_packed").isNotNull())
    packed = cut_lineage(packed)
    commonest = packed.groupBy("_size").count().orderBy(F.desc("count"), F.desc("_size")).first()
    d = commonest["_size"] if commonest else 0
    return packed.where(C("_size") == d).drop("_size"), d


# --- the operator -----------------------------------------------------------------------------------------------------

def whiten(rows: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding", units: int = UNITS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: the leading components of every vector.

    They are fitted to the different vectors, each once.  ``deviation`` is the exact squared distance from their mean times
    ``n`` squared (NULL beyond 64 bits), ``explained`` the component's share of the variance, ``identity_error`` how far the
    covariance of the whitened vectors is from the identity.
    """
    kind = rows.schema[vec_id].dataType.simpleString()
    vectors, d = whole_vectors(rows, vec_id, embedding, units)
    schema = f"{vec_id} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = cut_lineage(vectors.select("_packed").distinct())
    n, sums = _sums(fit, d)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    cov, unit = _covariance(fit, n, sums, d)
    values, axes = leading(cov, components)
    trace = float(np.trace(cov))
    real = int((values > EPS * d * trace).sum())
    values, axes = values[:real], axes[:, :real]
    if not real:
        return rows.sparkSession.createDataFrame([], schema)
    axes = axes / np.sqrt(values)
    explained = (values / trace).tolist()
    error = _identity_error(fit, n, sums, axes, d, unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _away(batch.column(1).to_pylist(), d, n, sums)
            deviation = [v if v < 1 << 63 else None for v in _squares(away)]
            projected = _centred(away, n, unit) @ axes
            again = np.repeat(np.arange(batch.num_rows), real)
            pick = lambda array: array.take(pa.array(again))
            yield pa.RecordBatch.from_arrays(
                [pick(batch.column(0)), pa.array(np.tile(np.arange(1, real + 1, dtype=np.int32), batch.num_rows)),
                 pa.array(np.full(len(again), n, np.int64)), pick(pa.array(deviation, pa.int64())), pa.array(projected.ravel()),
                 pa.array(explained * batch.num_rows, pa.float64()), pa.array(np.full(len(again), error))],
                [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def _away(raws: list[bytes], d: int, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` of each vector, exact."""
    x = _unpacked(raws, d)
    if x.dtype != object and n * int(np.abs(x).max()) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(away: np.ndarray, n: int, unit: int) -> np.ndarray:
    """``x - S / n`` in doubles, in units of ``unit``."""
    return (away / (n * unit)).astype(float)


def _squares(away: np.ndarray) -> list[int]:
    most = int(np.abs(away).max())
    if most * most * away.shape[1] >= 1 << 63:
        away = away.astype(object)
    return [int(v) for v in (away * away).sum(axis=1)]


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of ``i, j, part``, whole numbers in base 10**15 (so that no sum of any table overflows); at most d * d keys."""
    rows = parts.groupBy("i", "j", "digit").agg(F.sum("part").alias("part")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        out[r.i, r.j] = out.get((r.i, r.j), 0) + int(r.part) * 10 ** (15 * r.digit)
    return out


def _digits(entries: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, digit, part = [], [], [], []
    for a, b, value in entries:
        sign, value, place = (-1 if value < 0 else 1), abs(int(value)), 0
        while value or not place:
            value, low = divmod(value, 10 ** 15)
            i.append(a), j.append(b), digit.append(place), part.append(sign * low)
            place += 1
    columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(digit, pa.int32()), pa.array(part, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", "digit", "part"])


def _by_task(fit: DataFrame, summed) -> DataFrame:
    """``i, j, digit, part``: what ``summed`` makes of each block of packed vectors, added up per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            raws = batch.column(0).to_pylist()
            for k in range(0, len(raws), _BLOCK):
                block = summed(raws[k:k + _BLOCK]).astype(object)
                total = block if total is None else total + block
        if total is not None:
            yield _digits((a, b, total[a, b]) for a in range(total.shape[0]) for b in range(total.shape[1]) if b >= a or total.shape[0] != total.shape[1])

    parts = fit.mapInArrow(run, "i int, j int, digit int, part bigint")
    return parts.withColumn("part", C("part").cast("decimal(38,0)"))


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and sum of each dimension."""
    def summed(raws: list[bytes]) -> np.ndarray:
        x = _unpacked(raws, d)
        x = x if int(np.abs(x).max()) < 1 << 48 else x.astype(object)
        return np.concatenate([x.sum(axis=0).astype(object), [len(raws)]]).reshape(1, -1)

    found = _added(_by_task(fit, summed))
    return found.get((0, d), 0), [found.get((0, k), 0) for k in range(d)]


def _covariance(fit: DataFrame, n: int, sums: list[int], d: int) -> tuple[np.ndarray, int]:
    """Covariance with divisor n: centred on the rounded mean in whole numbers before multiplying, the rest taken off exactly.

    It is that of the vectors in units of the second result, 1 unless doubles could not hold it.
    """
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]  # the sums of what is multiplied
    small = max(map(abs, centre)) < 1 << 62

    def summed(raws: list[bytes]) -> np.ndarray:
        x = _unpacked(raws, d)
        if x.dtype != object and small and int(np.abs(x).max()) < 1 << 62:
            return _products(x - np.array(centre, np.int64))
        return _products(x.astype(object) - np.array(centre, object))

    found = _added(_by_task(fit, summed))
    exact = {(i, j): Fraction(n * found.get((i, j), 0) - rest[i] * rest[j], n * n) for i in range(d) for j in range(i, d)}
    unit = 1 << max(0, (int(max(map(abs, exact.values()))).bit_length() - 900) // 2)
    cov = np.empty((d, d))
    for (i, j), value in exact.items():
        cov[i, j] = cov[j, i] = float(value / (unit * unit))
    return cov, unit


def _identity_error(fit: DataFrame, n: int, sums: list[int], axes: np.ndarray, d: int, unit: int) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = _centred(_away(batch.column(0).to_pylist(), d, n, sums), n, unit) @ axes
                total += w.T @ w
                first += w.sum(axis=0)
        rows = [(a, b, total[a, b]) for a in range(k) for b in range(k)] + [(a, -1, first[a]) for a in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["i", "j", "part"])

    found = {(r.i, r.j): r.part for r in fit.mapInArrow(run, "i bigint, j bigint, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).collect()}
    mean = [found[a, -1] / n for a in range(k)]
    return max(abs(found[a, b] / n - mean[a] * mean[b] - (a == b)) for a in range(k) for b in range(k))
