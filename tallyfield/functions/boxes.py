"""Boxes (cx, cy, cz, dx, dy, dz, yaw) as array columns; yaw turns the x-z plane, up is -y.

Functions with ``up`` take boxes of another up axis too: yaw then turns the plane of the other two
axes, from the first towards the second.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions.vectors import (
    let,
    mat_vec,
    rotation_of,
    se3_apply,
    total,
    vec,
)

UP = 1  # index of the up axis
EDGE = 1e-9  # metres below which an edge lies on another


def _order(up: int) -> list[int]:
    first, second = (i for i in range(3) if i != up)
    return [first, up, second]


def y_up(v: Column, up: int = UP) -> Column:
    """A box whose up axis is ``up``, with its axes in the order of the functions here."""
    if up == UP:
        return v
    return F.array(*[v[i] for i in _order(up)], *[v[3 + i] for i in _order(up)], v[6])


def _point_y_up(p: Column, up: int) -> Column:
    return p if up == UP else F.array(*[p[i] for i in _order(up)])


def finite_box(box: Column) -> Column:
    """Whether a box has all of its numbers, none of them NaN or infinite."""
    return F.coalesce(
        (F.size(box) == 7) & F.forall(box, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))),
        F.lit(False),
    )


def bev_corners(box: Column, up: int = UP) -> Column:
    """The four ground-plane corners of a box, counter-clockwise, in its two ground axes."""
    box = y_up(box, up)
    c, s = F.cos(box[6]), F.sin(box[6])
    ha, hb = box[3] / 2.0, box[5] / 2.0
    out = []
    for sa, sb in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        a, b = ha * sa, hb * sb
        out.append(F.array(box[0] + c * a - s * b, box[2] + s * a + c * b))
    return F.array(*out)


def box_corners(box: Column, up: int = UP) -> Column:
    """The eight corners of a box."""
    first, second = (i for i in range(3) if i != up)
    c, s = F.cos(box[6]), F.sin(box[6])
    out = []
    for signs in product((-0.5, 0.5), repeat=3):
        a, b = box[3 + first] * signs[first], box[3 + second] * signs[second]
        at = {
            first: box[first] + c * a - s * b,
            second: box[second] + s * a + c * b,
            up: box[up] + box[3 + up] * signs[up],
        }
        out.append(F.array(*[at[i] for i in range(3)]))
    return F.array(*out)


def box_reach(box: Column) -> tuple[Column, Column]:
    """Half extents of the axis-aligned ground rectangle around a yawed box."""
    c, s = F.abs(F.cos(box[6])), F.abs(F.sin(box[6]))
    return (c * box[3] + s * box[5]) / 2.0, (s * box[3] + c * box[5]) / 2.0


def inside_box(p: Column, box: Column, margin: float = 0.0, up: int = UP) -> Column:
    """Whether a point lies in the box grown by ``margin`` (borders included)."""
    p, box = _point_y_up(p, up), y_up(box, up)
    c, s = F.cos(box[6]), F.sin(box[6])
    x, z = p[0] - box[0], p[2] - box[2]
    return (
        (F.abs(c * x + s * z) <= box[3] / 2.0 + margin)
        & (F.abs(c * z - s * x) <= box[5] / 2.0 + margin)
        & (F.abs(p[1] - box[1]) <= box[4] / 2.0 + margin)
    )


def box_to_frame(centre: Column, size_wlh: Column, heading: Column, m: Column) -> Column:
    """A box given by centre, (width, length, height) and heading about z, in another frame.

    ``m`` is the 4x4 transform into the camera frame; the extents become (l, h, w).
    """
    c = se3_apply(m, centre)
    nose = mat_vec(rotation_of(m), F.array(F.cos(heading), F.sin(heading), F.lit(0.0)))
    yaw = F.atan2(nose[2], nose[0])
    return F.array(c[0], c[1], c[2], size_wlh[1], size_wlh[2], size_wlh[0], yaw)


def _overlap(a: Column, b: Column, i: int) -> Column:
    hi = F.least(a[i] + a[3 + i] / 2.0, b[i] + b[3 + i] / 2.0)
    lo = F.greatest(a[i] - a[3 + i] / 2.0, b[i] - b[3 + i] / 2.0)
    return F.greatest(hi - lo, F.lit(0.0))


def iou3d_aligned(a: Column, b: Column) -> Column:
    """3D overlap ratio of two boxes that both have yaw 0: no Python involved."""
    inter = reduce(mul, [_overlap(a, b, i) for i in range(3)])
    vol_a, vol_b = reduce(mul, [a[3 + i] for i in range(3)]), reduce(mul, [b[3 + i] for i in range(3)])
    union = vol_a + vol_b - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def _inside(p: list[Column], q: list[Column], half: list[Column], owned: bool) -> Column:
    """Part of the edge p + t q, t in [0, 1], that lies in the rectangle |x| <= half around the origin.

    An edge along a side of the rectangle is inside if both run the same way round, and only for
    ``owned`` edges, so a side that two rectangles share counts once.
    """
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for i, way in ((0, 1.0), (1, -1.0)):
        along = F.abs(q[i]) <= EDGE
        strict = F.abs(p[i]) < half[i] - EDGE
        side = (F.abs(F.abs(p[i]) - half[i]) <= EDGE) & (p[i] * q[1 - i] * way > 0)
        kept = (strict | side) if owned else strict
        step = F.when(along, 1.0).otherwise(q[i])
        first, last = (-half[i] - p[i]) / step, (half[i] - p[i]) / step
        low.append(F.when(along, F.when(kept, 0.0).otherwise(2.0)).otherwise(F.least(first, last)))
        high.append(F.when(along, F.when(kept, 1.0).otherwise(-1.0)).otherwise(F.greatest(first, last)))
    return F.greatest(F.least(*high) - F.greatest(*low), F.lit(0.0))


def ground_overlap(a: Column, b: Column) -> Column:
    """Area shared by two turned rectangles on the ground, as the integral along the shared boundary.

    The boundary is made of the parts of each rectangle's edges inside the other. Seen from one
    rectangle's axes, the other's edges are cut by two strips, so no polygon is ever built.
    """
    cb, sb, turn = F.cos(b[6]), F.sin(b[6]), a[6] - b[6]
    dx, dz = a[0] - b[0], a[2] - b[2]
    frame = F.array(
        cb * dx + sb * dz, cb * dz - sb * dx, F.cos(turn), F.sin(turn), a[3] / 2.0, a[5] / 2.0, b[3] / 2.0, b[5] / 2.0
    )

    def area(f: Column) -> Column:
        c, s = f[2], f[3]
        ends = ((-1.0, -1.0, 1.0, 0.0), (1.0, -1.0, 0.0, 1.0), (1.0, 1.0, -1.0, 0.0), (-1.0, 1.0, 0.0, -1.0))
        sums = []

        def inside_b(e: Column) -> Column:
            return _inside([e[0], e[1]], [e[2], e[3]], [f[6], f[7]], True) * (e[0] * e[3] - e[1] * e[2])

        def inside_a(e: Column) -> Column:
            return _inside([e[0], e[1]], [e[2], e[3]], [f[4], f[5]], False) * (2.0 * f[6] * f[7])

        for u, v, du, dv in ends:
            # an edge of a as b sees it, and how much area it sweeps around the middle of b
            p = [f[0] + c * f[4] * u - s * f[5] * v, f[1] + s * f[4] * u + c * f[5] * v]
            q = [c * f[4] * (2 * du) - s * f[5] * (2 * dv), s * f[4] * (2 * du) + c * f[5] * (2 * dv)]
            sums.append(let(F.array(*p, *q), inside_b))
            # an edge of b as a sees it; each sweeps a quarter of b
            x, y = f[6] * u - f[0], f[7] * v - f[1]
            p = [c * x + s * y, c * y - s * x]
            q = [c * f[6] * (2 * du) + s * f[7] * (2 * dv), c * f[7] * (2 * dv) - s * f[6] * (2 * du)]
            sums.append(let(F.array(*p, *q), inside_a))
        return F.greatest(total(sums) / 2.0, F.lit(0.0))

    return let(frame, area)


def iou3d(a: Column | str, b: Column | str) -> Column:
    """Exact 3D overlap ratio of yawed boxes; null if one of them is."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    inter = ground_overlap(a, b) * _overlap(a, b, UP)
    vol_a, vol_b = (reduce(mul, [x[3 + i] for i in range(3)]) for x in (a, b))

    def ratio(i: Column) -> Column:
        union = vol_a + vol_b - i
        return F.when(union > 0, i / union).otherwise(0.0)

    return F.when(a.isNotNull() & b.isNotNull(), let(inter, ratio))


def box_terms(gt: Column, pred: Column) -> Column:
    """Centre L1, size L1 and heading term (1 - cos) of a predicted box, as a struct."""
    centre = reduce(lambda p, q: p + q, [F.abs(pred[i] - gt[i]) for i in range(3)])
    size = reduce(lambda p, q: p + q, [F.abs(pred[i] - gt[i]) for i in range(3, 6)])
    return F.struct(
        centre.alias("centre"), size.alias("size"), (1.0 - F.cos(pred[6] - gt[6])).alias("yaw")
    )


def select_box(mesh: Column, padded: Column, convention: Column) -> Column:
    """The box a record is scored on: the padded one for keypoint records that have it."""
    return F.when((convention == "waymo15") & padded.isNotNull(), padded).otherwise(mesh)


def scale_sizes(box: Column, key: Column, by_prefix: dict[str, tuple[float, float, float]]) -> Column:
    """Box sizes scaled per dataset: the first prefix of ``key`` that matches wins."""
    out = box
    for prefix, f in reversed(list(by_prefix.items())):
        grown = F.array(
            box[0], box[1], box[2], box[3] * f[0], box[4] * f[1], box[5] * f[2], box[6]
        )
        out = F.when(key.startswith(prefix), grown).otherwise(out)
    return out


PADDED_LABEL_SCALE = (1.39, 1.05, 1.45)  # fixed value: label size over mesh size (x, up, z)


def point_box(x: Column, y: Column, z: Column) -> Column:
    """Aggregate: the axis-aligned box of a cloud."""
    lo, hi = [F.min(c) for c in (x, y, z)], [F.max(c) for c in (x, y, z)]
    mid = [(a + b) / 2.0 for a, b in zip(lo, hi)]
    return vec(*mid, *[b - a for a, b in zip(lo, hi)], 0.0)
