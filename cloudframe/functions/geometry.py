"""Coordinates, angles and rotations as Column expressions; rotation matrices as nine plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.functions.linalg import cross, dot, norm

C = F.col
Matrix = list[list[float]]


def cart2sph(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Azimuth in [0, 360), elevation (degrees) and range."""
    az = F.degrees(F.atan2(y, x))
    return {"az": F.when(az < 0, az + 360.0).otherwise(az), "el": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))),
            "range": F.sqrt(x * x + y * y + z * z)}


def sph2cart(az: Column, el: Column, distance: Column) -> dict[str, Column]:
    a, e = F.radians(az), F.radians(el)
    return {"x": distance * F.cos(e) * F.cos(a), "y": distance * F.cos(e) * F.sin(a), "z": distance * F.sin(e)}


def azimuth(dx: Column, dy: Column) -> Column:
    """Bearing in radians, clockwise from +y, in [0, 2 pi)."""
    angle = F.atan2(dx, dy)
    return F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle)


def deg2dms(degrees: Column) -> Column:
    """Struct (deg, min, sec); the sign sits on the degrees, or on the first non-zero part below one degree."""
    size = F.abs(degrees)
    whole = F.floor(size)
    minutes = F.floor((size - whole) * 60)
    seconds = ((size - whole) * 60 - minutes) * 60
    sign = F.when(degrees < 0, -1).otherwise(1)
    return F.struct(F.when(whole > 0, sign * whole).otherwise(whole).cast("bigint").alias("deg"),
                    F.when((whole == 0) & (minutes > 0), sign * minutes).otherwise(minutes).cast("bigint").alias("min"),
                    F.when((whole == 0) & (minutes == 0), sign * seconds).otherwise(seconds).alias("sec"))


def unit(vector: list[Column]) -> list[Column]:
    """Unit vector; NULL for the zero vector."""
    length = norm(vector)
    return [F.when(length > 0, e / length) for e in vector]


def skew(v: list[Column]) -> Column:
    """Cross-product matrix as an array of rows."""
    zero = F.lit(0.0)
    return F.array(F.array(zero, -v[2], v[1]), F.array(v[2], zero, -v[0]), F.array(-v[1], v[0], zero))


def point_line_distance(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Distance of a 2-D point to the line through a and b (to the point a when they coincide)."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = F.sqrt(dx * dx + dy * dy)
    off = F.sqrt((p[0] - a[0]) * (p[0] - a[0]) + (p[1] - a[1]) * (p[1] - a[1]))
    return F.when(length > 0, F.abs(dx * (a[1] - p[1]) - (a[0] - p[0]) * dy) / length).otherwise(off)


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Area in the XY plane."""
    return F.abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def edge_length(a: list[Column], b: list[Column]) -> Column:
    return norm([p - q for p, q in zip(a, b)])


# --- rotation matrices on the driver ----------------------------------------------------------------------------------

def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def rotation_euler(omega: float, phi: float, kappa: float) -> Matrix:
    """``Rx(omega) Ry(phi) Rz(kappa)``, angles in degrees."""
    (so, co), (sp, cp), (sk, ck) = ((math.sin(math.radians(a)), math.cos(math.radians(a))) for a in (omega, phi, kappa))
    about_x = [[1, 0, 0], [0, co, -so], [0, so, co]]
    about_y = [[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]]
    about_z = [[ck, -sk, 0], [sk, ck, 0], [0, 0, 1]]
    return multiply(multiply(about_x, about_y), about_z)


def rotation_axis_angle(axis: tuple[float, float, float], degrees: float, right_handed: bool = True) -> Matrix:
    """Rotation about a unit axis; ``right_handed=False`` gives the transposed convention."""
    theta = math.radians(degrees if right_handed else -degrees)
    k = [[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]]
    k2 = multiply(k, k)
    return [[(i == j) + math.sin(theta) * k[i][j] + (1 - math.cos(theta)) * k2[i][j] for j in range(3)] for i in range(3)]


def rotation_quaternion(w: float, x: float, y: float, z: float) -> Matrix:
    """Rotation of a unit quaternion: ``v -> q v q*``."""
    rotated = []
    for axis in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
        u = (x, y, z)
        uv = sum(a * b for a, b in zip(u, axis))
        uu = sum(a * a for a in u)
        c = (u[1] * axis[2] - u[2] * axis[1], u[2] * axis[0] - u[0] * axis[2], u[0] * axis[1] - u[1] * axis[0])
        rotated.append([2 * uv * u[i] + (w * w - uu) * axis[i] + 2 * w * c[i] for i in range(3)])
    return [[rotated[j][i] for j in range(3)] for i in range(3)]


def rotation_two_vectors(source: tuple[float, float, float], target: tuple[float, float, float]) -> Matrix:
    """Smallest rotation that turns ``source`` to ``target``; opposite vectors turn by 180 degrees."""
    a, b = ([e / math.sqrt(sum(v * v for v in vector)) for e in vector] for vector in (source, target))
    axis = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    size = math.sqrt(sum(e * e for e in axis))
    cosine = sum(p * q for p, q in zip(a, b))
    if size < 1e-15:
        if cosine > 0:
            return [[float(i == j) for j in range(3)] for i in range(3)]
        other = (1.0, 0.0, 0.0) if abs(a[0]) < 0.9 else (0.0, 1.0, 0.0)
        axis = (a[1] * other[2] - a[2] * other[1], a[2] * other[0] - a[0] * other[2], a[0] * other[1] - a[1] * other[0])
        size = math.sqrt(sum(e * e for e in axis))
        return rotation_axis_angle(tuple(e / size for e in axis), 180.0)
    return rotation_axis_angle(tuple(e / size for e in axis), math.degrees(math.atan2(size, cosine)))


def transform(df: DataFrame, matrix: Matrix, translation: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``p -> R p + t`` on the columns x, y, z."""
    p = [C(a) for a in "xyz"]
    return df.withColumns({a: dot([F.lit(float(e)) for e in row], p) + F.lit(float(t))
                           for a, row, t in zip("xyz", matrix, translation)})


def transform_by_poses(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Move each cloud by its own pose: ``poses(cloud_id, m ARRAY<DOUBLE>(16))``, row by row.

    Poses are one row per scan; Spark broadcasts them while they are small and shuffles otherwise.
    """
    p = [C(a) for a in "xyz"]
    moved = points.join(poses, "cloud_id")
    return moved.withColumns({a: dot([C("m")[4 * i + j] for j in range(3)], p) + C("m")[4 * i + 3]
                              for i, a in enumerate("xyz")}).drop("m")


def euler_from_matrix(m: Column, width: int = 3) -> dict[str, Column]:
    """Angles in degrees of ``Rx(omega) Ry(phi) Rz(kappa)`` from an array of rows (``width`` entries per row)."""
    e = lambda i, j: m[i * width + j]
    return {"omega": F.degrees(F.atan(F.try_divide(-e(1, 2), e(2, 2)))), "phi": F.degrees(F.asin(e(0, 2))),
            "kappa": F.degrees(F.atan2(-e(0, 1), e(0, 0)))}


def rotation_from_eigenvectors(axes: list[Column]) -> Column:
    """Matrix whose columns are the given axis arrays, as an array of rows."""
    return F.array(*(F.array(*(axis[i] for axis in axes)) for i in range(3)))


def rotate_to_z(normal: list[Column], v: list[Column]) -> list[Column]:
    """Coordinates of ``v`` after the smallest rotation that turns the unit vector ``normal`` to +z.

    The closed form of that rotation divides by ``1 + nz``; a normal pointing straight down turns about x instead.
    """
    nx, ny, nz = normal
    down = nz < -1 + 1e-12
    h = F.when(down, 0.0).otherwise(1 / (1 + F.when(down, 0.0).otherwise(nz)))
    along = nx * v[0] + ny * v[1]
    return [F.when(down, v[0]).otherwise(v[0] - nx * (h * along + v[2])),
            F.when(down, -v[1]).otherwise(v[1] - ny * (h * along + v[2])),
            F.when(down, -v[2]).otherwise(along + nz * v[2])]
