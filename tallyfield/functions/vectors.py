"""3-vectors, 3x3 and 4x4 matrices as array columns, unrolled so that codegen covers them.

Matrices are row-major arrays of 9 or 16 doubles. The frame is the camera frame of the
records: x right, y down, z forward, metres; up is -y.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce, wraps
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def array(*parts: Column) -> Column:
    """An array column that remembers its parts.

    Functions that read single elements then build on the parts; nesting whole arrays would
    multiply the size of the expression at every step.
    """
    out = F.array(*parts)
    out._tallyfield_parts = list(parts)
    return out


def by_parts(fn):
    """Hands remembered parts to ``fn`` in place of the array column."""

    @wraps(fn)
    def run(*args, **named):
        return fn(*[parts_of(a) for a in args], **named)

    return run


def parts_of(value):
    """The remembered parts of an array column, or the value itself."""
    if isinstance(value, Column):
        return value.__dict__.get("_tallyfield_parts", value)
    return value


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row however often it is read."""
    return F.transform(F.array(value), use)[0]


def vec(*parts: Column | float) -> Column:
    """An array column from its parts."""
    return array(*[(p if isinstance(p, Column) else F.lit(p)).cast("double") for p in parts])


def total(parts: Sequence[Column]) -> Column:
    """Sum of columns, left to right."""
    return reduce(add, parts)


@by_parts
def dot(a: Column, b: Column, n: int = 3) -> Column:
    """Inner product of two n-vectors."""
    return total([a[i] * b[i] for i in range(n)])


@by_parts
def sub(a: Column, b: Column, n: int = 3) -> Column:
    """Difference of two n-vectors."""
    return array(*[a[i] - b[i] for i in range(n)])


@by_parts
def plus(a: Column, b: Column, n: int = 3) -> Column:
    """Sum of two n-vectors."""
    return array(*[a[i] + b[i] for i in range(n)])


@by_parts
def scaled(a: Column, s: Column | float, n: int = 3) -> Column:
    """A vector times a number."""
    return array(*[a[i] * s for i in range(n)])


@by_parts
def cross(a: Column, b: Column) -> Column:
    """Cross product."""
    return array(
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


@by_parts
def norm(a: Column, n: int = 3) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a, n))


@by_parts
def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points."""
    return norm(sub(a, b))


@by_parts
def transpose(m: Column) -> Column:
    """Transpose of a 3x3 matrix."""
    return array(*[m[3 * j + i] for i in range(3) for j in range(3)])


@by_parts
def mat_mul(a: Column, b: Column, n: int = 3) -> Column:
    """Product of two n x n matrices."""
    return array(
        *[
            total([a[n * i + k] * b[n * k + j] for k in range(n)])
            for i in range(n)
            for j in range(n)
        ]
    )


@by_parts
def mat_vec(m: Column, v: Column) -> Column:
    """3x3 matrix times vector."""
    return array(*[total([m[3 * i + k] * v[k] for k in range(3)]) for i in range(3)])


@by_parts
def det(m: Column) -> Column:
    """Determinant of a 3x3 matrix."""
    return (
        m[0] * (m[4] * m[8] - m[5] * m[7])
        - m[1] * (m[3] * m[8] - m[5] * m[6])
        + m[2] * (m[3] * m[7] - m[4] * m[6])
    )


# --- rigid transforms ---------------------------------------------------------


@by_parts
def se3(r: Column, t: Column) -> Column:
    """4x4 transform from a rotation and a translation."""
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [x for i in range(3) for x in (r[3 * i], r[3 * i + 1], r[3 * i + 2], t[i])]
    # one flat array: the optimizer then reads single elements without building it
    return array(*rows, zero, zero, zero, one)


@by_parts
def rotation_of(m: Column) -> Column:
    """Rotation part of a 4x4 transform."""
    return array(*[m[4 * i + j] for i in range(3) for j in range(3)])


@by_parts
def translation_of(m: Column) -> Column:
    """Translation part of a 4x4 transform."""
    return array(m[3], m[7], m[11])


@by_parts
def se3_inv(m: Column) -> Column:
    """Inverse of a rigid transform."""
    rt = transpose(rotation_of(m))
    return se3(rt, scaled(mat_vec(rt, translation_of(m)), F.lit(-1.0)))


@by_parts
def se3_mul(a: Column, b: Column) -> Column:
    """Composition of two 4x4 transforms."""
    return mat_mul(a, b, 4)


@by_parts
def se3_apply(m: Column, p: Column) -> Column:
    """A point moved by a rigid transform."""
    return array(
        *[
            total([m[4 * i + k] * p[k] for k in range(3)]) + m[4 * i + 3]
            for i in range(3)
        ]
    )


def check_rigid(m: Column, tol: float = 1e-5) -> Column:
    """True for a 4x4 transform whose rotation is orthonormal, proper, with last row 0 0 0 1."""
    r = rotation_of(m)
    rrt = mat_mul(r, transpose(r))
    eye = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    near = [F.abs(rrt[i] - eye[i]) <= tol for i in range(9)]
    last = [F.abs(m[12 + i] - v) <= tol for i, v in enumerate((0.0, 0.0, 0.0, 1.0))]
    ok = reduce(lambda a, b: a & b, [*near, *last, det(r) >= 0])
    return F.coalesce((F.size(m) == 16) & ok, F.lit(False))


# --- rotations ----------------------------------------------------------------


@by_parts
def quat_to_matrix(q: Column, scalar_last: bool = False) -> Column:
    """Rotation matrix of a quaternion (w, x, y, z), normalised first."""
    w, x, y, z = (q[3], q[0], q[1], q[2]) if scalar_last else (q[0], q[1], q[2], q[3])
    n = F.sqrt(w * w + x * x + y * y + z * z)
    n = F.when(n > 0, n)
    w, x, y, z = w / n, x / n, y / n, z / n
    return array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


@by_parts
def rotvec_to_matrix(v: Column) -> Column:
    """Rotation matrix of an axis-angle vector."""
    t = norm(v)
    small = t < 1e-8
    a = F.when(small, F.lit(1.0)).otherwise(F.sin(t) / F.when(small, 1.0).otherwise(t))
    b = F.when(small, F.lit(0.5)).otherwise(
        (1 - F.cos(t)) / F.when(small, 1.0).otherwise(t * t)
    )
    x, y, z = v[0], v[1], v[2]
    return array(
        1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y,
        b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x,
        b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y),
    )


def _clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


@by_parts
def rotation_angle(r: Column) -> Column:
    """Angle of a rotation matrix, 0 to pi."""
    return F.acos(_clamp((r[0] + r[4] + r[8] - 1) / 2))


@by_parts
def geodesic(a: Column, b: Column) -> Column:
    """Angle between two rotations."""
    # trace of a^T b needs no product
    trace = total([a[i] * b[i] for i in range(9)])
    return F.acos(_clamp((trace - 1) / 2))


@by_parts
def matrix_to_rotvec(r: Column) -> Column:
    """Axis-angle vector of a rotation matrix.

    Near half a turn the axis comes from the diagonal, where the difference terms vanish.
    """
    t = rotation_angle(r)
    away = vec(r[7] - r[5], r[2] - r[6], r[3] - r[1])
    length = norm(away)
    usual = scaled(away, t / F.when(length < 1e-12, 1.0).otherwise(length))
    d = [F.sqrt(F.greatest((r[4 * i] + 1) / 2, F.lit(0.0))) for i in range(3)]
    first = d[0] >= F.greatest(d[1], d[2])
    second = d[1] >= d[2]
    on_x = array(d[0], (r[1] + r[3]) / (4 * d[0]), (r[2] + r[6]) / (4 * d[0]))
    on_y = array((r[1] + r[3]) / (4 * d[1]), d[1], (r[5] + r[7]) / (4 * d[1]))
    on_z = array((r[2] + r[6]) / (4 * d[2]), (r[5] + r[7]) / (4 * d[2]), d[2])
    axis = F.when(first, on_x).when(second, on_y).otherwise(on_z)
    half = scaled(axis, t / norm(axis))
    return (
        F.when(t < 1e-10, vec(0.0, 0.0, 0.0)).when(t > 3.14159, half).otherwise(usual)
    )


def yaw_matrix(angle: Column) -> Column:
    """Rotation about the up axis (-y) of the camera frame."""
    c, s = F.cos(angle), F.sin(angle)
    o, z = F.lit(1.0), F.lit(0.0)
    return array(c, z, -s, z, o, z, s, z, c)


def euler_xyz_to_matrix(x: Column, y: Column, z: Column) -> Column:
    """Rotation about x, then y, then z (fixed axes), angles in radians."""
    one, nil = F.lit(1.0), F.lit(0.0)
    rx = array(one, nil, nil, nil, F.cos(x), -F.sin(x), nil, F.sin(x), F.cos(x))
    ry = array(F.cos(y), nil, F.sin(y), nil, one, nil, -F.sin(y), nil, F.cos(y))
    rz = array(F.cos(z), -F.sin(z), nil, F.sin(z), F.cos(z), nil, nil, nil, one)
    return mat_mul(rz, mat_mul(ry, rx))


@by_parts
def heading_yaw(v: Column, up: int = 1) -> Column:
    """Yaw of a heading vector in the plane orthogonal to axis ``up``."""
    a, b = [i for i in range(3) if i != up]
    return F.atan2(v[b], v[a])


@by_parts
def matrix_yaw(r: Column, up: int = 1) -> Column:
    """Yaw of a rotation: the direction its first in-plane axis is turned to."""
    a, b = [i for i in range(3) if i != up]
    return F.atan2(r[3 * b + a], r[3 * a + a])


@by_parts
def remap_axes(p: Column, axes: Sequence[tuple[int, int]]) -> Column:
    """A point in another axis convention: one (source index, sign) per target axis."""
    return array(*[p[i] * float(sign) for i, sign in axes])


@by_parts
def remap_pose_axes(m: Column, axes: Sequence[tuple[int, int]]) -> Column:
    """A pose whose sensor is described in another axis convention; its place stays the same."""
    rows = [[*[m[4 * i + j] * float(sign) for j, sign in axes], m[4 * i + 3]] for i in range(3)]
    return array(*[x for row in rows for x in row], *[m[12 + k] for k in range(4)])


# fixed values: axis conventions as (source index, sign) per target axis
CAMERA_FROM_FORWARD_LEFT_UP = ((1, -1), (2, -1), (0, 1))  # x fwd, y left, z up -> camera
FORWARD_LEFT_UP_FROM_CAMERA = ((2, 1), (0, -1), (1, -1))  # camera -> x fwd, y left, z up
