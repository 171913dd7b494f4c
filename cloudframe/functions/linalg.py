"""Small dense linear algebra as Column expressions, so that it stays inside whole-stage codegen.

The helpers add columns to a DataFrame step by step: each step is a projection of its own, and Catalyst keeps an
expression that is used several times in the projection that computes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

C = F.col
SYMMETRIC = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
# Eigenvalues at or below this size count as zero.
EIGEN_ZERO = 1e-8


def dot(a: list[Column], b: list[Column]) -> Column:
    total = a[0] * b[0]
    for left, right in zip(a[1:], b[1:]):
        total = total + left * right
    return total


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def vector(names: str | list[str]) -> list[Column]:
    """Columns of a vector: ``vector('nx ny nz')``, or ``vector('plate')`` for an array column of three."""
    names = names.split() if isinstance(names, str) else names
    if len(names) == 1:
        return [C(names[0])[i] for i in range(3)]
    return [C(n) for n in names]


def with_eigenvalues(df: DataFrame) -> DataFrame:
    """Add ``l1 <= l2 <= l3`` of the symmetric 3x3 matrix ``cxx .. czz`` (trigonometric closed form)."""
    third = F.lit(2.0 * math.pi / 3.0)
    zero_small = lambda e: F.when(F.abs(e) <= EIGEN_ZERO, 0.0).otherwise(e)
    df = df.withColumn("_q", (C("cxx") + C("cyy") + C("czz")) / 3)
    df = df.withColumns({"_a": C("cxx") - C("_q"), "_b": C("cyy") - C("_q"), "_c": C("czz") - C("_q")})
    df = df.withColumn("_p", F.sqrt((
        C("_a") * C("_a") + C("_b") * C("_b") + C("_c") * C("_c")
        + 2 * (C("cxy") * C("cxy") + C("cxz") * C("cxz") + C("cyz") * C("cyz"))) / 6))
    determinant = (C("_a") * (C("_b") * C("_c") - C("cyz") * C("cyz"))
                   - C("cxy") * (C("cxy") * C("_c") - C("cyz") * C("cxz"))
                   + C("cxz") * (C("cxy") * C("cyz") - C("_b") * C("cxz")))
    df = df.withColumn("_r", F.when(C("_p") > 0, determinant / (2 * C("_p") * C("_p") * C("_p"))).otherwise(0.0))
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), C("_r")))) / 3)
    df = df.withColumns({"_high": C("_q") + 2 * C("_p") * F.cos(C("_phi")),
                         "_low": C("_q") + 2 * C("_p") * F.cos(C("_phi") + third)})
    df = df.withColumns({"l1": zero_small(C("_low")), "l2": zero_small(3 * C("_q") - C("_low") - C("_high")),
                         "l3": zero_small(C("_high"))})
    return df.drop("_a", "_b", "_c", "_r", "_phi", "_q", "_high", "_low")


def _with_axis(df: DataFrame, value: str, out: str) -> DataFrame:
    """Unit eigenvector of ``value``: the longest cross product of two rows of ``C - value*I``."""
    a, b, c = (C(n) - C(value) for n in ("cxx", "cyy", "czz"))
    rows = [[a, C("cxy"), C("cxz")], [C("cxy"), b, C("cyz")], [C("cxz"), C("cyz"), c]]
    candidate = lambda v: F.struct(dot(v, v).alias("size"), *(e.alias(n) for e, n in zip(v, "xyz")))
    df = df.withColumn("_best", F.greatest(*(
        candidate(cross(rows[i], rows[j])) for i, j in ((0, 1), (0, 2), (1, 2)))))
    # Two (nearly) equal eigenvalues leave the direction undefined: NULL.
    df = df.withColumn("_len", F.when(F.sqrt(C("_best.size")) > 1e-6 * 6 * C("_p") * C("_p"), F.sqrt(C("_best.size"))))
    df = df.withColumns({f"_{n}": C(f"_best.{n}") / C("_len") for n in "xyz"})
    df = df.withColumn("_sign", canonical_sign(C("_x"), C("_y"), C("_z")))
    return (df.withColumn(out, F.when(C("_len").isNotNull(),
                                      F.array(*(C("_sign") * C(f"_{n}") for n in "xyz"))))
            .drop("_best", "_len", "_x", "_y", "_z", "_sign"))


def canonical_sign(x: Column, y: Column, z: Column, tolerance: float = 1e-9) -> Column:
    """+1 or -1 such that the first non-zero of (z, y, x) becomes positive."""
    sign = lambda e: F.when(e < 0, -1.0).otherwise(1.0)
    return F.when(F.abs(z) > tolerance, sign(z)).when(F.abs(y) > tolerance, sign(y)).otherwise(sign(x))


def with_eigen(df: DataFrame) -> DataFrame:
    """Add eigenvalues ``l1 <= l2 <= l3``, ``plate`` (axis of l1) and ``stick`` (axis of l3) of ``cxx .. czz``."""
    df = with_eigenvalues(df)
    df = _with_axis(df, "l1", "plate")
    df = _with_axis(df, "l3", "stick")
    return df.drop("_p")


def eigenvalues(df: DataFrame) -> DataFrame:
    return with_eigenvalues(df).drop("_p")


def with_solution3(df: DataFrame, matrix: list[Column], rhs: list[Column], out: list[str]) -> DataFrame:
    """Solve a symmetric 3x3 system by Cramer's rule; a singular system gives NULLs.

    ``matrix`` holds the six distinct entries row by row: (m00, m01, m02, m11, m12, m22).
    """
    names = [f"_m{i}" for i in range(6)] + [f"_u{i}" for i in range(3)]
    df = df.withColumns(dict(zip(names, [*matrix, *rhs])))
    a, b, c, d, e, f = (C(n) for n in names[:6])
    u, v, w = (C(n) for n in names[6:])
    df = df.withColumns({"_k0": d * f - e * e, "_k1": c * e - b * f, "_k2": b * e - c * d,
                         "_k3": a * f - c * c, "_k4": b * c - a * e, "_k5": a * d - b * b})
    df = df.withColumn("_det", a * C("_k0") + b * C("_k1") + c * C("_k2"))
    size = a * d * f
    df = df.withColumn("_det", F.when(F.abs(C("_det")) > 1e-12 * F.abs(size), C("_det")))
    k = [C(f"_k{i}") for i in range(6)]
    df = df.withColumns({out[0]: (k[0] * u + k[1] * v + k[2] * w) / C("_det"),
                         out[1]: (k[1] * u + k[3] * v + k[4] * w) / C("_det"),
                         out[2]: (k[2] * u + k[4] * v + k[5] * w) / C("_det")})
    return df.drop(*names, *(f"_k{i}" for i in range(6)), "_det")


def is_pos_semidef(l1: Column) -> Column:
    """All eigenvalues non-negative, given the smallest one."""
    return l1 >= 0
