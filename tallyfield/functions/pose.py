"""Joint arrays: errors, centring, alignment, convention maps.

A joint set is an array of (x, y, z) arrays in metres; validity is a boolean array of the
same length. Errors are in millimetres and NULL where no joint is valid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tallyfield.functions.vectors import distance, let

MM = 1000.0

# fixed values: joint conventions by id, and index maps to the 17 COCO joints (-1: none)
JOINT_CONVENTIONS = ("smpl24", "waymo15")
WAYMO15_TO_COCO17 = (0, 5, 7, 9, 11, 13, 15, 6, 8, 10, 12, 14, 16, -1, -1)
KEYPOINTS14_TO_COCO17 = (-1, 5, 7, 9, 11, 13, 15, 6, 8, 10, 12, 14, 16, -1)
KEYPOINT_HIPS = (4, 10)  # left and right hip among the 15 keypoints
COCO_HIPS = (11, 12)


def mean_of(values: Column) -> Column:
    """Mean of an array of doubles, NULL entries skipped, NULL when nothing is left."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(
        values,
        start,
        lambda a, x: F.when(x.isNull(), a).otherwise(
            F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))
        ),
        lambda a: F.when(a["n"] > 0, a["s"] / a["n"]),
    )


def masked(values: Column, valid: Column) -> Column:
    """Array entries whose flag is not set become NULL."""
    return F.zip_with(values, valid, lambda x, v: F.when(v, x))


def mpjpe(gt: Column, pred: Column, valid: Column) -> Column:
    """Mean distance over the valid joints."""
    errs = F.zip_with(gt, pred, lambda g, p: distance(p, g))
    return mean_of(masked(errs, valid)) * MM


def mean_joint(joints: Column, valid: Column) -> Column:
    """Mean point of the valid joints (NULL parts when none is valid)."""

    def mean(kept: Column) -> Column:
        zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        total = F.aggregate(kept, zero, lambda s, p: F.array(*[s[i] + p[i] for i in range(3)]))
        n = F.size(kept)
        return F.array(*[F.when(n > 0, total[i] / n) for i in range(3)])

    return let(F.filter(masked(joints, valid), lambda p: p.isNotNull()), mean)


def centre_joints(joints: Column, valid: Column) -> Column:
    """Joints relative to the mean of the valid ones; unchanged when none is valid."""
    moved = let(
        mean_joint(joints, valid),
        lambda c: F.transform(joints, lambda p: F.array(*[p[i] - c[i] for i in range(3)])),
    )
    return F.when(F.exists(valid, lambda v: v), moved).otherwise(joints)


def shift_joints(joints: Column, by: Column) -> Column:
    """All joints moved by one vector."""
    return F.transform(joints, lambda p: F.array(*[p[i] + by[i] for i in range(3)]))


def root_relative(joints: Column, root: Column) -> Column:
    """Joints or vertices relative to a root point."""
    return F.transform(joints, lambda p: F.array(*[p[i] - root[i] for i in range(3)]))


def pve(gt: Column, pred: Column, gt_root: Column, pred_root: Column) -> Column:
    """Root-relative per-vertex error."""
    a, b = root_relative(gt, gt_root), root_relative(pred, pred_root)
    return mean_of(F.zip_with(a, b, lambda g, p: distance(p, g))) * MM


@pandas_udf(DoubleType())
def _aligned_error(gt: pd.Series, pred: pd.Series, valid: pd.Series) -> pd.Series:
    """:func:`pa_mpjpe` of flat coordinates; one stacked SVD per Arrow batch and joint count."""
    out = np.full(len(gt), np.nan)
    some = (gt.notna() & pred.notna() & valid.notna()).to_numpy()
    counts = np.array([len(v) if ok else 0 for v, ok in zip(valid, some)])
    for n in np.unique(counts[counts > 0]):
        at = np.flatnonzero(counts == n)

        def stack(s, at=at):
            return np.concatenate(s.to_numpy()[at]).astype(float).reshape(len(at), -1, 3)

        g, p = stack(gt), stack(pred)
        w = (np.concatenate(valid.to_numpy()[at]).reshape(len(at), -1) == True).astype(float)[..., None]  # noqa: E712
        has = w.sum(1)[:, 0] > 0
        m = np.maximum(w.sum(1), 1.0)[:, None]
        g = np.where(w > 0, g, 0.0)
        p = np.where(w > 0, p, 0.0)
        g0, p0 = (g - (g * w).sum(1, keepdims=True) / m) * w, (
            p - (p * w).sum(1, keepdims=True) / m
        ) * w
        u, s, vt = np.linalg.svd(np.swapaxes(p0, 1, 2) @ g0)
        flip = np.ones_like(s)
        flip[:, 2] = np.sign(np.linalg.det(u @ vt))
        rot = (u * flip[:, None]) @ vt
        spread = (p0**2).sum((1, 2))
        scale = (s * flip).sum(1) / np.where(spread > 0, spread, 1.0)
        err = np.linalg.norm(scale[:, None, None] * (p0 @ rot) - g0, axis=-1) * w[..., 0]
        out[at] = np.where(has, err.sum(1) / m[:, 0, 0] * MM, np.nan)
    return pd.Series(out).where(~np.isnan(out))


def pa_mpjpe(gt: Column | str, pred: Column | str, valid: Column | str) -> Column:
    """MPJPE after the best similarity transform of the prediction onto the truth.

    Records without a valid joint give NULL. Joints travel as one flat array per record.
    """
    gt, pred, valid = (F.col(c) if isinstance(c, str) else c for c in (gt, pred, valid))
    none = F.array(*[F.lit(float("nan"))] * 3)
    flat = [F.flatten(F.transform(c, lambda x: F.coalesce(x, none))) for c in (gt, pred)]
    return _aligned_error(*flat, valid)


def convention_id(col: Column, known: Sequence[str] = JOINT_CONVENTIONS) -> Column:
    """Index of the joint convention, 0 for an unknown one."""
    return F.greatest(
        F.coalesce(F.array_position(F.array(*[F.lit(k) for k in known]), col), F.lit(0)) - 1,
        F.lit(0),
    ).cast("int")


def map_joints(joints: Column, to: Sequence[int]) -> Column:
    """Joints picked by an index map; NULL where the map says -1."""
    return F.array(*[F.get(joints, F.lit(i)) if i >= 0 else F.lit(None) for i in to])


def comparable(
    gt: Column, valid: Column, joints: Column, coco: Column, convention: Column
) -> tuple[Column, Column, Column]:
    """(truth, prediction, validity) of the joints both sides have.

    Keypoint records are compared with COCO joints on the shared ones, all others on their
    first 24 joints.
    """
    shared = [(i, j) for i, j in enumerate(WAYMO15_TO_COCO17) if j >= 0]
    keypoints = convention == "waymo15"
    g = F.when(keypoints, F.array(*[gt[i] for i, _ in shared])).otherwise(F.slice(gt, 1, 24))
    p = F.when(keypoints, F.array(*[coco[j] for _, j in shared])).otherwise(
        F.slice(joints, 1, 24)
    )
    v = F.when(keypoints, F.array(*[valid[i] for i, _ in shared])).otherwise(
        F.slice(valid, 1, 24)
    )
    return g, p, v


def hip_centre(joints: Column, hips: tuple[int, int]) -> Column:
    """Mean of the two hip joints."""
    a, b = hips
    return F.array(*[(joints[a][i] + joints[b][i]) / 2.0 for i in range(3)])


def keypoint_placement(gt: Column, valid: Column, coco: Column) -> Column:
    """Placement error of a keypoint record: hip centres, NULL unless both hips are labelled."""
    a, b = KEYPOINT_HIPS
    d = distance(hip_centre(coco, COCO_HIPS), hip_centre(gt, KEYPOINT_HIPS))
    return F.when(valid[a] & valid[b], d)


def joint_valid(joints: Column, hidden: Column) -> Column:
    """Flags: not listed as hidden and any coordinate other than zero."""
    return F.transform(
        joints,
        lambda p, i: ~F.array_contains(hidden, i) & F.exists(p, lambda x: x != 0),
    )


def keypoint_box(kp: Column, crop: float = 256.0, margin: float = 1.2, floor: float = 64.0) -> Column:
    """Square (cx, cy, side) around the keypoints with confidence; the crop if fewer than two."""
    kept = F.filter(kp, lambda k: k[2] > 0)
    xs, ys = F.transform(kept, lambda k: k[0]), F.transform(kept, lambda k: k[1])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    side = F.greatest(F.lit(floor), F.greatest(x1 - x0, y1 - y0) * margin)
    whole = F.array(F.lit(crop / 2), F.lit(crop / 2), F.lit(crop))
    return F.when(F.size(kept) < 2, whole).otherwise(
        F.array((x0 + x1) / 2.0, (y0 + y1) / 2.0, side)
    )


def reshape_keypoints(flat: Column, joints: int = 17) -> Column:
    """Flat keypoints as ``joints`` rows of their first three values.

    NULL when the length does not divide or a joint has fewer than three values.
    """
    width = (F.size(flat) / joints).cast("int")
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(joints - 1)), lambda j: F.slice(flat, j * width + 1, 3)
    )
    return F.when((F.size(flat) % joints == 0) & (width >= 3), rows)


def pad_array(col: Column, n: int) -> Column:
    """An array of doubles padded with zeros to length ``n``."""
    return F.concat(col, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(col), F.lit(0))))


def mirror_back(vertices: Column, partner: Column) -> Column:
    """Vertices of a mirrored prediction: x flipped, then relabelled by ``partner`` indices."""
    flipped = F.transform(vertices, lambda v: F.array(-v[0], v[1], v[2]))
    return F.transform(partner, lambda j: F.get(flipped, j.cast("int")))


def mirror_orient(rotvec: Column) -> Column:
    """Axis-angle orientation of a reflected body."""
    return F.array(rotvec[0], -rotvec[1], -rotvec[2])
