"""Scoring: predictions against truth, metric summaries, precision, error by distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.boxes import UP, box_reach, finite_box, iou3d, y_up
from tallyfield.operators.ordered import (
    MAX_GROUP_ROWS,
    Ordered,
    group_total,
    max_from_here,
    row_number,
    running_sum,
)
from tallyfield.operators.quantiles import join_groups, no_nan
from tallyfield.operators.spatial import cell_width, cover, cover_level, on_levels

IOU_THRESHOLDS = (0.25, 0.5, 0.7)
DISTANCE_BINS_M = (0.0, 10.0, 20.0, 30.0, float("inf"))


def attach_predictions(
    gt: DataFrame, pred: DataFrame, on: str = "key", position: str = "pos"
) -> DataFrame:
    """Truth with its prediction; of several predictions for one key the last one wins.

    ``missing`` marks truth without a prediction.
    """
    values = [c for c in pred.columns if c not in (on, position)]
    last = pred.groupBy(on).agg(F.max_by(F.struct(*values), F.col(position)).alias("_p"))
    return gt.join(last, on, "left").select(
        *gt.columns,
        *[F.col(f"_p.{v}").alias(v) for v in values],
        F.col("_p").isNull().alias("missing"),
    )


def missing_keys(gt: DataFrame, pred: DataFrame, on: str = "key") -> DataFrame:
    """Truth keys nobody predicted."""
    return gt.select(on).join(pred.select(on), on, "left_anti")


def summarize(df: DataFrame, by: Sequence[str], metrics: Sequence[str], iou: str | None = None):
    """Row count and NaN-skipping means per group; the overlap mean is a plain one."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(no_nan(F.col(m))).alias(m) for m in metrics]
    if iou:
        aggs.append(F.avg(iou).alias("mean_iou"))
    return df.groupBy(*by).agg(*aggs)


def bin_labels(bins: Sequence[float] = DISTANCE_BINS_M) -> list[tuple[str, float, float]]:
    """(label, from, to) of half-open distance bins; the open one is ``>x m``."""
    out = []
    for lo, hi in zip(bins[:-1], bins[1:]):
        label = f">{lo:g}m" if hi == float("inf") else f"{lo:g}-{hi:g}m"
        out.append((label, lo, hi))
    return out


def error_by_distance(
    df: DataFrame,
    by: Sequence[str],
    error: Column,
    depth: Column,
    bins: Sequence[float] = DISTANCE_BINS_M,
) -> DataFrame:
    """Mean error per group and distance bin; empty bins appear with NULL."""
    parts = bin_labels(bins)

    def hits(lo: float, hi: float) -> Column:
        inside = (depth >= lo) & ~F.isnan(depth)
        return inside if hi == float("inf") else inside & (depth < hi)

    cells = [F.avg(F.when(hits(lo, hi), error)) for _, lo, hi in parts]
    counts = [F.count(F.when(hits(lo, hi), error)) for _, lo, hi in parts]
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("bin"), v.alias("error"), n.alias("n"))
            for (label, _, _), v, n in zip(parts, cells, counts)
        ]
    )
    wide = df.groupBy(*by).agg(rows.alias("_bins"))
    return wide.select(*by, F.explode("_bins").alias("_b")).select(*by, "_b.*")


def average_precision(
    df: DataFrame,
    by: Sequence[str],
    iou: str,
    score: str,
    key: str,
    thresholds: Sequence[float] = IOU_THRESHOLDS,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """All-point average precision per group: one column ``ap_<threshold>`` each, and ``map``.

    Rows are ranked once by score (equal scores by key) for all thresholds. A missing overlap is
    a miss and a missing score ranks last; NaN is missing.
    """
    names = {t: f"ap_{int(round(t * 100))}" for t in thresholds}
    overlap = F.coalesce(no_nan(F.col(iou).cast("double")), F.lit(0.0))
    flags = df.select(
        *by,
        key,
        no_nan(F.col(score).cast("double")).alias(score),
        *[(overlap >= t).cast("int").alias(n) for t, n in names.items()],
    )
    ranked = Ordered(flags, by, [F.col(score).desc_nulls_last(), F.col(key)], limit)
    ranked.add(
        _rn=row_number(),
        _n=group_total(),
        **{f"_cum_{n}": running_sum(F.col(n)) for n in names.values()},
    )
    ranked.add(
        **{
            f"_env_{n}": max_from_here(F.col(f"_cum_{n}") / F.col("_rn")) for n in names.values()
        }
    )
    aps = [
        (F.sum(F.col(n) * F.col(f"_env_{n}")) / F.max("_n")).alias(n) for n in names.values()
    ]
    out = ranked.result().groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aps)
    mean = sum([F.col(n) for n in names.values()][1:], F.col(next(iter(names.values()))))
    return out.withColumn("map", mean / len(names))


def metric_summary(
    df: DataFrame,
    by: Sequence[str],
    metrics: Sequence[str],
    *,
    iou: str,
    score: str,
    key: str,
    error: str,
    depth: str,
    thresholds: Sequence[float] = IOU_THRESHOLDS,
    bins: Sequence[float] = DISTANCE_BINS_M,
) -> DataFrame:
    """All numbers of a method and split in one row per group.

    Columns: by, n, the means of ``metrics``, ``mean_iou``, one ``ap_<threshold>`` each, ``map``
    and ``by_distance``, an array of (bin, error, n) in the order of the bins. Rows without a
    prediction have NULL metrics, a missing overlap (a miss) and count in n.
    """
    means = summarize(df, by, metrics, iou)
    ap = average_precision(df, by, iou, score, key, thresholds).drop("n")
    order = F.create_map(*[x for i, (label, _, _) in enumerate(bin_labels(bins)) for x in (F.lit(label), F.lit(i))])
    far = error_by_distance(df, by, no_nan(F.col(error)), F.col(depth), bins)
    rows = F.array_sort(F.collect_list(F.struct(order[F.col("bin")].alias("at"), "bin", "error", "n")))
    parts = far.groupBy(*by).agg(rows.alias("_b"))
    cells = F.transform("_b", lambda x: F.struct(x["bin"].alias("bin"), x["error"].alias("error"), x["n"].alias("n")))
    return join_groups([means, ap, parts.select(*by, cells.alias("by_distance"))], by)


def pairwise_iou(
    a: DataFrame,
    b: DataFrame,
    on: str,
    ids: tuple[str, str],
    cell_m: float = 2.0,
    aligned: bool = False,
    once: bool = False,
    up: int = UP,
) -> DataFrame:
    """Overlap ratio of all box pairs of a frame that overlap at all (the rest is 0).

    Boxes meet on a ground grid whose cells grow with the boxes: only pairs that touch a common
    cell of the larger box's level are compared, and a pair is kept in the one cell that holds the
    lower corner of its common rectangle, so nothing has to be removed afterwards. Both tables
    carry ``box`` (7 numbers); ``aligned`` says that all yaws are 0, then no Python is involved.
    ``once`` joins a table with itself: each pair once, the smaller id first. ``up`` is the index
    of the up axis. Boxes with a missing, NaN or infinite number overlap nothing.
    """

    def flat(df: DataFrame, key: str, tag: str) -> DataFrame:
        df = df.where(finite_box(F.col("box"))).withColumn("box", y_up(F.col("box"), up))
        rx, rz = box_reach(F.col("box"))
        box = F.col("box")
        out = df.select(
            on,
            F.col(key).alias(f"_id_{tag}"),
            *([] if aligned else [box.alias(f"_box_{tag}")]),
            (box[0] - rx).alias(f"_x0_{tag}"),
            (box[0] + rx).alias(f"_x1_{tag}"),
            (box[1] - box[4] / 2.0).alias(f"_y0_{tag}"),
            (box[1] + box[4] / 2.0).alias(f"_y1_{tag}"),
            (box[2] - rz).alias(f"_z0_{tag}"),
            (box[2] + rz).alias(f"_z1_{tag}"),
            (box[3] * box[4] * box[5]).alias(f"_vol_{tag}"),
        )
        return out.withColumn(f"_own_{tag}", cover_level(*ground(tag), cell_m))

    def ground(tag: str) -> tuple[list[Column], list[Column]]:
        return [F.col(f"_{c}0_{tag}") for c in "xz"], [F.col(f"_{c}1_{tag}") for c in "xz"]

    left, right = flat(a, ids[0], "a"), flat(b, ids[1], "b")
    # a few numbers: the levels that occur
    levels = (
        left.select(F.col("_own_a").alias("g")).union(right.select("_own_b"))
        .agg(F.sort_array(F.collect_set("g")))
    )

    def gridded(df: DataFrame, tag: str) -> DataFrame:
        return cover(on_levels(df, levels.scalar(), F.col(f"_own_{tag}")), *ground(tag), cell_m)

    # a merge join spreads the pairs over tasks by cell, and skewed cells are split at run time;
    # a broadcast would leave them to the few tasks that read the boxes
    both = gridded(left, "a").join(gridded(right, "b").hint("merge"), [on, "_g", "_g0", "_g1"])
    both = both.where(F.col("_g") == F.greatest("_own_a", "_own_b"))
    if once:
        both = both.where(F.col("_id_a") < F.col("_id_b"))
    lo = {c: F.greatest(f"_{c}0_a", f"_{c}0_b") for c in "xyz"}
    hi = {c: F.least(f"_{c}1_a", f"_{c}1_b") for c in "xyz"}
    touch = (lo["x"] < hi["x"]) & (lo["y"] < hi["y"]) & (lo["z"] < hi["z"])
    width = cell_width(cell_m)
    owner = (F.floor(lo["x"] / width) == F.col("_g0")) & (F.floor(lo["z"] / width) == F.col("_g1"))
    inter = (hi["x"] - lo["x"]) * (hi["y"] - lo["y"]) * (hi["z"] - lo["z"])
    union = F.col("_vol_a") + F.col("_vol_b") - inter
    ratio = F.when(union > 0, inter / union) if aligned else iou3d("_box_a", "_box_b")
    names = ids if ids[0] != ids[1] else (f"{ids[0]}_a", f"{ids[1]}_b")
    return (
        both.where(touch & owner)
        .select(on, F.col("_id_a").alias(names[0]), F.col("_id_b").alias(names[1]), ratio.alias("iou"))
        .where(F.col("iou") > 0)
    )


def centroid(df: DataFrame, by: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Mean of the valid points of a cloud; NULL when it has none."""
    ok = F.lit(True) if valid is None else valid
    return df.groupBy(*by).agg(
        *[F.avg(F.when(ok, F.col(c))).alias(c) for c in ("x", "y", "z")],
        F.max(ok).alias("any_valid"),
    )


def aabb(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Axis-aligned box of every cloud."""
    lo = {c: F.min(c) for c in ("x", "y", "z")}
    hi = {c: F.max(c) for c in ("x", "y", "z")}
    return df.groupBy(*by).agg(
        *[((lo[c] + hi[c]) / 2.0).alias(f"c{c}") for c in lo],
        *[(hi[c] - lo[c]).alias(f"d{c}") for c in lo],
    )


def oriented_box(df: DataFrame, by: Sequence[str], yaw: Column) -> DataFrame:
    """Tight box of every cloud for the heading its points carry."""
    c, s = F.cos(yaw), F.sin(yaw)
    turned = df.select(
        *by,
        "y",
        yaw.alias("_yaw"),
        (c * F.col("x") + s * F.col("z")).alias("_a"),
        (c * F.col("z") - s * F.col("x")).alias("_b"),
    )
    got = turned.groupBy(*by).agg(
        F.max("_yaw").alias("yaw"),
        *[F.min(v).alias(f"{v}0") for v in ("_a", "y", "_b")],
        *[F.max(v).alias(f"{v}1") for v in ("_a", "y", "_b")],
    )
    ma, mb = (F.col("_a0") + F.col("_a1")) / 2.0, (F.col("_b0") + F.col("_b1")) / 2.0
    c, s = F.cos("yaw"), F.sin("yaw")
    return got.select(
        *by,
        (c * ma - s * mb).alias("cx"),
        ((F.col("y0") + F.col("y1")) / 2.0).alias("cy"),
        (s * ma + c * mb).alias("cz"),
        (F.col("_a1") - F.col("_a0")).alias("dx"),
        (F.col("y1") - F.col("y0")).alias("dy"),
        (F.col("_b1") - F.col("_b0")).alias("dz"),
        "yaw",
    )


def bbox2d(df: DataFrame, by: Sequence[str], width: int, height: int) -> DataFrame:
    """Corner box of the finite pixels of each group, clipped to the image.

    Groups without finite pixels or with an empty box get NULL corners.
    """
    good = ~F.isnan("u") & ~F.isnan("v") & (F.abs("u") < float("inf")) & (F.abs("v") < float("inf"))

    def clip(col: Column, top: int) -> Column:
        return F.least(F.greatest(col, F.lit(0.0)), F.lit(float(top - 1)))

    got = df.groupBy(*by).agg(
        clip(F.min(F.when(good, F.col("u"))), width).alias("_x0"),
        clip(F.min(F.when(good, F.col("v"))), height).alias("_y0"),
        clip(F.max(F.when(good, F.col("u"))), width).alias("_x1"),
        clip(F.max(F.when(good, F.col("v"))), height).alias("_y1"),
        F.count(F.when(good, F.lit(1))).alias("_n"),
    )
    ok = (F.col("_n") > 0) & (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0"))
    return got.select(*by, *[F.when(ok, F.col(f"_{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])
