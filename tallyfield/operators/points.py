"""Point-cloud operators on tables with one row per return."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.ordered import MAX_GROUP_ROWS, with_group

MAX_POINTS = 2048


def cap_points(points: DataFrame, n: int = MAX_POINTS, cloud: str = "cloud", order: str = "idx"):
    """At most the first ``n`` points of every cloud (each task drops the rest early)."""
    w = Window.partitionBy(cloud).orderBy(order)
    ranked = points.withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


MAX_CLOUD_ROWS = 200_000  # points of one cloud a single task may hold


def mask_bbox(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Corner box of mask pixels (largest pixel included as it is)."""
    return pixels.groupBy(*by).agg(
        F.min("u").alias("x0"), F.min("v").alias("y0"), F.max("u").alias("x1"), F.max("v").alias("y1")
    )


def union_masks(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """One mask per person from its parts: every pixel once."""
    return pixels.select(*by, "u", "v").distinct()


def reproject_depth(
    pixels: DataFrame,
    frame: str,
    d: float,
    cx: float,
    cy: float,
    width: int,
    height: int,
    sky: float = 1e4,
) -> DataFrame:
    """Depth pixels as a camera moved back by ``d`` sees them.

    Of the pixels that fall on one target the nearest wins. Returns the moved pixels with
    ``u2``, ``v2``, ``z2`` and ``visible`` (within 1e-6 of the winner).
    """
    z2 = F.col("z") + d
    shrink = F.col("z") / z2
    moved = pixels.where(F.col("z") < sky).select(
        "*",
        z2.alias("z2"),
        F.rint(F.lit(cx) + (F.col("u") - cx) * shrink).cast("long").alias("u2"),
        F.rint(F.lit(cy) + (F.col("v") - cy) * shrink).cast("long").alias("v2"),
    )
    inside = moved.where(
        (F.col("u2") >= 0) & (F.col("u2") < width) & (F.col("v2") >= 0) & (F.col("v2") < height)
    )
    seen = with_group(inside, [frame, "u2", "v2"], F.min("z2").alias("_front"))
    near = 1e-6 + 1e-5 * F.abs("_front")
    return seen.withColumn("visible", F.abs(F.col("z2") - F.col("_front")) <= near).drop("_front")


def voxelize(
    points: DataFrame,
    cloud: str,
    order: str,
    x_range: tuple[float, float],
    y_range: tuple[float, float],
    z_range: tuple[float, float],
    size: float = 0.4,
    max_points: int = 32,
) -> DataFrame:
    """Points by pillar: cells ``ix``, ``iy`` and the place ``slot`` inside the pillar.

    Points outside the x/y range are dropped, z is clamped, a pillar keeps its first points in
    input order.
    """
    x, y = F.col("x"), F.col("y")
    inside = (x >= x_range[0]) & (x < x_range[1]) & (y >= y_range[0]) & (y < y_range[1])

    def cell(c: Column, r: tuple[float, float]) -> Column:
        n = int(round((r[1] - r[0]) / size))
        at = F.floor((c - r[0]) / size).cast("long")
        return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))

    z = F.least(F.greatest(F.col("z"), F.lit(z_range[0])), F.lit(z_range[1] - 1e-3))
    d = points.where(inside).withColumns({"ix": cell(x, x_range), "iy": cell(y, y_range), "z": z})
    w = Window.partitionBy(cloud, "iy", "ix").orderBy(order)
    d = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_points)
    return d.withColumn("slot", (F.col("_rn") - 1).cast("long")).drop("_rn")


def pillar_counts(voxels: DataFrame, cloud: str) -> DataFrame:
    """Points per pillar after the cap."""
    return voxels.groupBy(cloud, "iy", "ix").agg(F.count(F.lit(1)).alias("n"))


def cell_window(pillars: DataFrame, iy0: Column, ix0: Column, n: int) -> DataFrame:
    """Pillars inside an ``n`` by ``n`` window, with their place ``ly``, ``lx`` in it."""
    d = pillars.withColumn("ly", F.col("iy") - iy0).withColumn("lx", F.col("ix") - ix0)
    return d.where((F.col("ly") >= 0) & (F.col("ly") < n) & (F.col("lx") >= 0) & (F.col("lx") < n))


def clamped_roi(centre: Column, roi: int, size: int) -> Column:
    """The ``roi`` cell indices around a centre, clamped into a map of ``size`` cells."""
    offs = F.sequence(F.lit(-(roi // 2)), F.lit(roi - 1 - roi // 2))
    return F.transform(offs, lambda o: F.least(F.greatest(centre + o, F.lit(0)), F.lit(size - 1)))


def _fps_cloud(cloud: str, idx: str, m: int):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        p = pdf[["x", "y", "z"]].to_numpy()
        dist = np.full(len(p), np.inf)
        at, out = 0, []
        for rank in range(min(m, len(p))):
            out.append((rank, at))
            dist = np.minimum(dist, ((p - p[at]) ** 2).sum(1))
            at = int(dist.argmax())
        ranks, rows = zip(*out)
        return pdf.iloc[list(rows)][[cloud, idx]].assign(rank=list(ranks))

    return pick


def farthest_points(
    points: DataFrame, cloud: str, idx: str, m: int, cloud_limit: int = MAX_CLOUD_ROWS
) -> DataFrame:
    """``m`` far-apart points per cloud, starting with the first; ties go to the smaller index.

    Clouds of a bounded size are worked on whole, one per task. Larger ones take one shuffle
    per picked point: distances are updated in place and the farthest point is an aggregate.
    """
    flat = points.select(cloud, idx, "x", "y", "z")
    kind = dict(flat.dtypes)
    schema = f"{cloud} {kind[cloud]}, {idx} {kind[idx]}, rank long"
    sizes = flat.groupBy(cloud).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > cloud_limit).select(cloud)
    if not hot.limit(1).collect():
        return flat.groupBy(cloud).applyInPandas(_fps_cloud(cloud, idx, m), schema)
    small = flat.join(hot, cloud, "left_anti")
    out = small.groupBy(cloud).applyInPandas(_fps_cloud(cloud, idx, m), schema)
    from tallyfield.session import checkpoint

    left = flat.join(hot, cloud, "left_semi").withColumn("_d", F.lit(float("inf")))
    for rank in range(m):
        far = F.struct((-F.col("_d")).alias("d"), F.col(idx).alias("i"))
        best = left.groupBy(cloud).agg(F.min_by(F.struct(idx, "x", "y", "z"), far).alias("_b"))
        best = checkpoint(best)
        out = out.unionByName(
            best.select(cloud, F.col(f"_b.{idx}").alias(idx), F.lit(rank).cast("long").alias("rank"))
        )
        step = sum(
            [(F.col(c) - F.col(f"_b.{c}")) ** 2 for c in "yz"], (F.col("x") - F.col("_b.x")) ** 2
        )
        left = left.join(best, cloud).withColumn("_d", F.least("_d", step)).drop("_b")
        left = checkpoint(left)
    return out
