"""Matching records with other label sets, cameras, masks and tracks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.functions import vectors as V
from tallyfield.operators.ordered import MAX_GROUP_ROWS
from tallyfield.operators.sequences import on_grid
from tallyfield.operators.spatial import nearest
from tallyfield.operators.quantiles import no_nan
from tallyfield.session import checkpoint

MAX_FRAME_PAIRS = 100_000  # score rows of one frame a single task may sort


def match_nearest(
    a: DataFrame,
    b: DataFrame,
    *,
    on: Sequence[str],
    coords: Sequence[str],
    ids: tuple[str, str],
    max_distance: float,
    one_to_one: bool = False,
) -> DataFrame:
    """Nearest row of ``b`` for each row of ``a`` in the same frame, within a distance.

    Several rows of ``a`` may take the same row of ``b``; ``one_to_one`` leaves it to the
    nearest of them. Without ``on`` all of ``b`` is searched.
    """
    found = nearest(
        a,
        b,
        by=on,
        coords=coords,
        query_id=ids[0],
        point_id=ids[1],
        max_distance=max_distance,
    ).drop("rank")
    if one_to_one:
        best = F.min(F.struct("distance", ids[0])).alias("_b")
        found = (
            found.groupBy(*on, ids[1])
            .agg(best)
            .select(*on, F.col(f"_b.{ids[0]}").alias(ids[0]), ids[1], "_b.distance")
        )
    return found


def overlap_scores(
    points2d: DataFrame,
    masks: DataFrame,
    *,
    frame: str = "frame",
    label: str = "label",
    mask: str = "mask",
    every: int = 4,
) -> DataFrame:
    """Share of a label's projected points (every 4th, finite ones) that fall in each mask."""
    px = points2d.where(F.col("idx") % every == 0).where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & ~F.isnan("u") & ~F.isnan("v")
    )
    px = (
        px.select(
            frame, label, F.rint("u").cast("long").alias("u"), F.rint("v").cast("long").alias("v")
        )
        .groupBy(frame, label, "u", "v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    total = px.groupBy(frame, label).agg(F.sum("_n").alias("_all"))
    hits = (
        px.join(masks.select(frame, mask, "u", "v").distinct(), [frame, "u", "v"])
        .groupBy(frame, label, mask)
        .agg(F.sum("_n").alias("_hit"))
    )
    return hits.join(total, [frame, label]).select(
        frame, label, mask, (F.col("_hit") / F.col("_all")).alias("score")
    )


def _greedy_frame(by: list[str], label: str, mask: str):
    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", label, mask], ascending=[False, True, True])
        labels, masks, keep = set(), set(), []
        for a, b in zip(pdf[label], pdf[mask]):
            free = a not in labels and b not in masks
            keep.append(free)
            if free:
                labels.add(a)
                masks.add(b)
        return pdf[keep]

    return assign


def greedy_match(
    scores: DataFrame,
    by: Sequence[str],
    label: str,
    mask: str,
    min_score: float = 0.15,
    frame_limit: int = MAX_FRAME_PAIRS,
) -> DataFrame:
    """One-to-one assignment by descending score; equal scores by label, then mask.

    Pairs without a label, a mask or a score (null or NaN) are never assigned.

    Frames of a bounded size are worked through one per task. Larger ones go in rounds: a
    pair that is the best one left for both its label and its mask is what the greedy order
    would take, so all such pairs are taken at once and their rows removed. Each round takes
    at least the best pair of every frame, so the loop ends, and its result is the same.
    """
    by = list(by)
    # read for the frame sizes and again for the work
    usable = (no_nan(F.col("score")) >= min_score) & F.col(label).isNotNull() & F.col(mask).isNotNull()
    rows = checkpoint(scores.where(usable).select(*by, label, mask, "score"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > frame_limit).select(*by)
    schema = StructType([rows.schema[c] for c in [*by, label, mask, "score"]])
    if not hot.limit(1).collect():
        return rows.groupBy(*by).applyInPandas(_greedy_frame(by, label, mask), schema)
    small = rows.join(hot, by, "left_anti")
    out = small.groupBy(*by).applyInPandas(_greedy_frame(by, label, mask), schema)
    left = checkpoint(rows.join(hot, by, "left_semi"))
    while True:
        rank = F.struct((-F.col("score")).alias("s"), F.col(label).alias("l"), F.col(mask).alias("m"))
        per_label = left.groupBy(*by, label).agg(F.min(rank).alias("_bl"))
        per_mask = left.groupBy(*by, mask).agg(F.min(rank).alias("_bm"))
        marked = left.join(per_label, [*by, label]).join(per_mask, [*by, mask])
        taken = checkpoint(
            marked.where((rank == F.col("_bl")) & (rank == F.col("_bm"))).select(
                *by, label, mask, "score"
            )
        )
        if not taken.limit(1).collect():
            raise RuntimeError("a round took no pair")
        out = out.unionByName(taken)
        left = checkpoint(
            left.join(taken.select(*by, label), [*by, label], "left_anti").join(
                taken.select(*by, mask), [*by, mask], "left_anti"
            )
        )
        if not left.limit(1).collect():
            return out


def best_camera(corners: Column, cameras: Column, z_min: float = 0.1) -> Column:
    """The camera that holds all corners with the tallest box, as struct (channel, height).

    ``cameras`` is the array of one frame's cameras (channel, pose from world, fx, fy, cx, cy,
    width, height), a handful per rig. Of equally tall ones the first wins; NULL if none.
    """

    def seen(cam: Column, corners: Column) -> Column:
        def pixel(q: Column) -> Column:
            z = F.when(q[2] > z_min, q[2])  # NULL behind the camera: the corner is not seen
            return F.array(
                F.try_divide(cam["fx"] * q[0], z) + cam["cx"],
                F.try_divide(cam["fy"] * q[1], z) + cam["cy"],
                q[2],
            )

        uvz = F.transform(corners, lambda p: V.se3_apply(cam["pose"], p))

        def height(px: Column) -> Column:
            ok = F.forall(
                px,
                lambda q: (q[2] > z_min)
                & (q[0] >= 0)
                & (q[0] < cam["width"])
                & (q[1] >= 0)
                & (q[1] < cam["height"]),
            )
            return F.when(F.coalesce(ok, F.lit(False)), V.let(F.transform(px, lambda q: q[1]), lambda vs: F.array_max(vs) - F.array_min(vs)))

        return V.let(F.transform(uvz, pixel), height)

    heights = V.let(
        corners,
        lambda at: F.transform(cameras, lambda c: F.struct(c["channel"].alias("channel"), seen(c, at).alias("height"))),
    )
    nothing = F.struct(F.lit(None).cast("string").alias("channel"), F.lit(0.0).alias("height"))
    best = F.aggregate(
        heights,
        nothing,
        lambda acc, h: F.when(F.coalesce(h["height"], F.lit(0.0)) > acc["height"], h).otherwise(acc),
    )
    return V.let(best, lambda b: F.when(b["channel"].isNotNull(), b))


def frame_candidates(
    objects: DataFrame, cameras: DataFrame, rig: str, accept, min_height: float
) -> DataFrame:
    """One row per object and camera that sees it whole and tall enough.

    The cameras of a rig travel as one array (their number is bounded by the rig), so an object
    emits only its accepted cameras. ``accept(object corners, camera)`` gives the box or NULL.
    """
    per_rig = cameras.groupBy(rig).agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in cameras.columns if c != rig]))).alias("_cams")
    )
    d = objects.join(per_rig, rig)
    seen = F.filter(
        F.transform(
            "_cams",
            lambda c: F.struct(c["channel"].alias("channel"), accept(F.col("corners"), c).alias("bbox")),
        ),
        lambda s: s["bbox"].isNotNull() & (s["bbox"][3] - s["bbox"][1] >= min_height),
    )
    return d.select(*objects.columns, F.explode(seen).alias("_s")).select(*objects.columns, "_s.*")


def points_in_mask(points: DataFrame, masks: DataFrame, on: Sequence[str]) -> DataFrame:
    """Points whose rounded pixel (``u``, ``v``) belongs to the mask of their record."""
    px = points.withColumn("_u", F.rint("u").cast("long")).withColumn("_v", F.rint("v").cast("long"))
    m = masks.select(*on, F.col("u").alias("_u"), F.col("v").alias("_v"))
    return px.join(m, [*on, "_u", "_v"], "left_semi").drop("_u", "_v")


def accepted_keys(labels: DataFrame, key: str = "key", flag: str = "has_smpl") -> DataFrame:
    """Distinct keys with an accepted label in any table."""
    return labels.where(F.col(flag)).select(key).distinct()


def pending(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Work items without an output yet."""
    return work.join(done.select(*on), list(on), "left_anti")


def side_by_side(metrics: DataFrame, key: str, methods: Sequence[str], values: Sequence[str]):
    """Metrics of all methods in one row per record: columns ``<method>_<value>``."""
    aggs = [
        F.max(F.when(F.col("method") == m, F.col(v))).alias(f"{m}_{v}")
        for m in methods
        for v in values
    ]
    return metrics.groupBy(key).agg(*aggs)


def build_index(labels: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Index of the accepted records: centre in vehicle and world frame, and both transforms.

    ``labels`` has ``centre`` (vehicle frame), ``to_world`` and ``to_camera`` (4x4).
    """
    kept = labels.join(keys.select(key), key, "left_semi")
    centre, world = F.col("centre"), F.col("to_world")
    return kept.select(
        key,
        centre.alias("vehicle"),
        V.se3_apply(world, centre).alias("world"),
        F.col("to_camera").alias("vehicle_to_camera"),
        V.se3_mul(F.col("to_camera"), V.se3_inv(world)).alias("world_to_camera"),
    )


# fixed value: track axes to vehicle axes, as source index per target axis (x, y, z <- z, x, y)
TRACK_AXES = ((2, 1), (0, 1), (1, 1))
EGO_CHECK_FRAMES = 12
EGO_TOLERANCE_M = 0.05  # fixed value: a track may miss the scene poses by less than this


def ego_residual(
    tracks: DataFrame,
    poses: DataFrame,
    *,
    track: str = "track",
    scene: str = "scene",
    frame: str = "frame",
    checks: int = EGO_CHECK_FRAMES,
) -> DataFrame:
    """Largest disagreement of a track's own motion with the scene poses, per track.

    ``tracks`` has the ego position ``ego`` per frame in track axes, ``poses`` the 4x4 ``pose``.
    Checked on evenly spaced frames, in the frame of the track's first one.
    """
    ends = tracks.groupBy(track, scene).agg(F.min(frame).alias("_f0"))
    first = ends.join(
        poses.select(scene, F.col(frame).alias("_f0"), F.col("pose").alias("_first")), [scene, "_f0"]
    ).select(track, scene, V.se3_inv(F.col("_first")).alias("_inv"))
    from tallyfield.operators.ordered import Ordered, group_total, row_number

    placed = Ordered(tracks, [track, scene], [frame]).add(_rn=row_number(), _n=group_total()).result()
    picked = placed.where(on_grid(F.col("_rn") - 1, F.col("_n"), checks, "ends_cut"))
    d = picked.join(poses.select(scene, frame, "pose"), [scene, frame]).join(first, [track, scene])
    wanted = V.se3_apply(F.col("_inv"), V.translation_of(F.col("pose")))
    theirs = V.remap_axes(F.col("ego"), TRACK_AXES)
    off = F.greatest(*[F.abs(theirs[i] - wanted[i]) for i in range(3)])
    return d.groupBy(track, scene).agg(F.max(off).alias("residual"))


def consistent_tracks(residuals: DataFrame, tolerance: float = EGO_TOLERANCE_M) -> DataFrame:
    """Tracks whose own motion agrees with the scene poses."""
    return residuals.where(F.col("residual") < tolerance)
