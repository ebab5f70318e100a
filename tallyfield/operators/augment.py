"""Point-cloud augmentation as table operators: one row per return, one draw set per cloud.

Group bounds come from aggregates joined back, never from an unbounded window, so a cloud that
holds a large part of the table costs one small row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import vectors as V
from tallyfield.functions.rand import Draw, between, hashed, normal
from tallyfield.operators.ordered import (
    MAX_GROUP_ROWS,
    Ordered,
    group_total,
    row_number,
    with_group,
)
from tallyfield.session import checkpoint

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class OcclusionConfig:
    """Chances and ranges of the random occlusions (fixed defaults)."""

    p_halfspace: float = 0.3
    p_box: float = 0.3
    p_height_cut: float = 0.3
    height_cut_frac: tuple[float, float] = (0.2, 0.6)
    box_frac: tuple[float, float] = (0.2, 0.5)
    p_subsample: float = 0.5
    subsample_keep: tuple[float, float] = (0.2, 0.8)
    min_points: int = 16


@dataclass(frozen=True)
class PointAugmentConfig:
    """Chances and ranges of the whole augmentation (fixed defaults)."""

    occlusion: OcclusionConfig = field(default_factory=OcclusionConfig)
    jitter_std_m: tuple[float, float] = (0.0, 0.03)
    p_outliers: float = 0.3
    outlier_fraction: tuple[float, float] = (0.02, 0.1)
    outlier_spread_m: float = 0.3
    p_channel_dropout: float = 0.2
    channel_dropout: tuple[float, float] = (0.1, 0.5)


def _extent(df: DataFrame, cloud: str, axes: Sequence[str] = AXES) -> DataFrame:
    return with_group(
        df,
        [cloud],
        *[F.min(a).alias(f"_lo_{a}") for a in axes],
        *[F.max(a).alias(f"_hi_{a}") for a in axes],
    )


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def height_cut(df: DataFrame, cloud: str, frac: Column | float, from_bottom: bool = True) -> DataFrame:
    """Without a fraction of the body height at the bottom or top (up is -y)."""
    d = _extent(df, cloud, ["y"])
    f = frac if isinstance(frac, Column) else F.lit(float(frac))
    cut = f * (F.col("_hi_y") - F.col("_lo_y"))
    keep = F.col("y") <= F.col("_hi_y") - cut if from_bottom else F.col("y") >= F.col("_lo_y") + cut
    return _clean(d.where(keep))


def axis_cut(df: DataFrame, cloud: str, axis: str, frac: float, from_min: bool = True) -> DataFrame:
    """Without a fraction of the extent along an axis, from its low or high end."""
    d = _extent(df, cloud, [axis])
    lo, hi, v = F.col(f"_lo_{axis}"), F.col(f"_hi_{axis}"), F.col(axis)
    keep = v >= lo + (hi - lo) * frac if from_min else v <= hi - (hi - lo) * frac
    return _clean(d.where(keep))


def halfspace_cut(df: DataFrame, anchor: Column, normal_: Column, positive: Column | bool = True):
    """Only the points on one side of a plane (points on the plane stay)."""
    p = F.array(*AXES)
    side = V.dot(V.sub(p, anchor), normal_)
    pos = positive if isinstance(positive, Column) else F.lit(positive)
    return df.where(F.when(pos, side >= 0).otherwise(side <= 0))


def box_cut(df: DataFrame, centre: Column, size: Column) -> DataFrame:
    """Without the points inside an axis-aligned box (border included)."""
    inside = F.lit(True)
    for i, a in enumerate(AXES):
        inside = inside & (F.abs(F.col(a) - centre[i]) <= size[i] / 2.0)
    return df.where(~inside)


def subsample(
    df: DataFrame, cloud: str, idx: str, frac: Column | float, draw: Draw | None = None, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """A random share of each cloud: max(1, round(n * frac)) points."""
    draw = draw or hashed()
    d = df.withColumn("_u", draw("subsample", F.col(idx), F.col(cloud)))
    d = Ordered(d, [cloud], ["_u", idx], limit).add(_rn=row_number(), _n=group_total()).result()
    f = frac if isinstance(frac, Column) else F.lit(float(frac))
    k = F.greatest(F.lit(1), F.rint(F.col("_n") * f))
    return _clean(d.where(F.col("_rn") <= k))


def sample_points(
    df: DataFrame, cloud: str, idx: str, n: int, draw: Draw | None = None
) -> DataFrame:
    """Exactly ``n`` rows per cloud: a random subset, or all points and random repeats.

    Repeats are drawn with replacement and carry ``point_valid`` false; a cloud without points gives
    no rows. ``slot`` numbers the rows 0 .. n - 1.
    """
    draw = draw or hashed()
    w = Window.partitionBy(cloud).orderBy("_u", idx)
    d = df.withColumn("_u", draw("sample", F.col(idx), F.col(cloud))).withColumn("_rn", F.row_number().over(w))
    kept = checkpoint(d.where(F.col("_rn") <= n).drop("_u"))  # the subset, and what repeats are drawn from
    first = kept.withColumn("slot", (F.col("_rn") - 1).cast("long")).withColumn("point_valid", F.lit(True))
    sizes = kept.groupBy(cloud).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") < n)
    slot = F.explode(F.sequence(F.col("_m"), F.lit(n - 1).cast("long"))).alias("slot")
    asked = sizes.select(F.col(cloud).alias("_of"), "_m", slot)
    pick = F.floor(draw("repeat", F.col("slot"), F.col("_of")) * F.col("_m")) + 1
    # Spark takes the exploded rows for as few as the clouds, and would send them all through the driver
    asked = asked.select("_of", "slot", pick.cast("int").alias("_pick")).hint("merge")
    again = kept.join(asked, kept[cloud].eqNullSafe(asked["_of"]) & (kept["_rn"] == asked["_pick"]))
    again = again.drop("_of", "_pick").withColumn("point_valid", F.lit(False))
    return _clean(first.unionByName(again))


def jitter(
    df: DataFrame, idx: str, std: Column | float, draw: Draw | None = None, cloud: str | None = None
) -> DataFrame:
    """Gaussian noise on every coordinate; name ``cloud`` where ``idx`` restarts in each cloud."""
    draw = draw or hashed()
    keys = [F.col(c) for c in (idx, cloud) if c is not None]
    s = std if isinstance(std, Column) else F.lit(float(std))
    return df.withColumns({a: F.col(a) + normal(draw, f"jitter.{a}", *keys) * s for a in AXES})


def range_jitter(
    df: DataFrame,
    idx: str,
    origin: Sequence[float],
    std: float,
    draw: Draw | None = None,
    cloud: str | None = None,
) -> DataFrame:
    """Gaussian noise along the ray from the sensor; ``cloud`` as in :func:`jitter`."""
    draw = draw or hashed()
    keys = [F.col(c) for c in (idx, cloud) if c is not None]
    off = [F.col(a) - o for a, o in zip(AXES, origin)]
    r = F.greatest(F.sqrt(V.total([o * o for o in off])), F.lit(1e-6))
    noise = normal(draw, "range", *keys) * std
    return df.withColumns({a: F.col(a) + o / r * noise for a, o in zip(AXES, off)})


def add_outliers(
    df: DataFrame,
    cloud: str,
    frac: Column | float,
    spread: float,
    draw: Draw | None = None,
    when: Column | None = None,
) -> DataFrame:
    """Spurious returns: round(n * frac) more points, uniform in the cloud's widened box.

    Adds ``outlier``; columns an outlier cannot have are NULL.
    """
    draw = draw or hashed()
    f = frac if isinstance(frac, Column) else F.lit(float(frac))
    box = df.groupBy(cloud).agg(
        F.count(F.lit(1)).alias("_n"),
        *[(F.min(a) - spread).alias(f"_lo_{a}") for a in AXES],
        *[(F.max(a) + spread).alias(f"_hi_{a}") for a in AXES],
    )
    many = F.rint(F.col("_n") * f).cast("long")
    if when is not None:
        many = F.when(when, many).otherwise(0)
    new = box.withColumn("_k", many).where(F.col("_k") > 0)
    new = new.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    k = (F.col("_i"), F.col(cloud))
    extra = new.select(
        cloud,
        *[
            between(draw, f"outlier.{a}", F.col(f"_lo_{a}"), F.col(f"_hi_{a}"), *k).alias(a)
            for a in AXES
        ],
        F.lit(True).alias("outlier"),
    )
    return df.withColumn("outlier", F.lit(False)).unionByName(extra, allowMissingColumns=True)


def _unless_too_few(df: DataFrame, cloud: str, keep: Column, min_points: int) -> DataFrame:
    """Drops the points ``keep`` refuses, unless a cloud would be left with too few."""
    d = df.withColumn("_keep", F.coalesce(keep, F.lit(True)))
    d = with_group(d, [cloud], F.count(F.when(F.col("_keep"), 1)).alias("_left"))
    return d.where(F.col("_keep") | (F.col("_left") < min_points)).drop("_keep", "_left")


def occlude(
    df: DataFrame,
    cloud: str,
    idx: str,
    cfg: OcclusionConfig | None = None,
    draw: Draw | None = None,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Half-space, box, height cut and subsampling, each with its own chance per cloud.

    A step that would leave fewer than ``min_points`` points of a cloud is undone for it; a
    cloud with fewer to begin with is left alone.
    """
    cfg, draw = cfg or OcclusionConfig(), draw or hashed()
    c, few = F.col(cloud), cfg.min_points
    cols = df.columns

    def spans(kept: Column, tag: str, axes: Sequence[str]) -> list[Column]:
        low = [F.min(F.when(kept, F.col(a))).alias(f"_lo{tag}_{a}") for a in axes]
        return low + [F.max(F.when(kept, F.col(a))).alias(f"_hi{tag}_{a}") for a in axes]

    pickable = F.struct(draw("anchor", F.col(idx), F.col(cloud)).alias("u"), F.col(idx).alias("i"))
    d = with_group(
        df,
        [cloud],
        F.count(F.lit(1)).alias("_n0"),
        F.min_by(F.array(*AXES), pickable).alias("_anchor"),
        *spans(F.lit(True), "0", AXES),
        cut=True,
    )
    big = F.col("_n0") >= few

    # half space through a random point of the cloud, mostly vertical planes
    n = [normal(draw, f"plane{i}", c) * (0.3 if i == 1 else 1.0) for i in range(3)]
    side = V.dot(V.sub(F.array(*AXES), F.col("_anchor")), V.array(*n))
    on_side = F.when(draw("side", c) < 0.5, side >= 0).otherwise(side <= 0)
    d = d.withColumn("_k1", ~(big & (draw("halfspace", c) < cfg.p_halfspace)) | on_side)
    d = with_group(
        d, [cloud], F.count(F.when(F.col("_k1"), 1)).alias("_n1"), *spans(F.col("_k1"), "1", AXES), cut=True
    )
    ok1 = F.col("_n1") >= few
    d = d.withColumn("_e1", F.col("_k1") | ~ok1)

    # random box: sides as a share of the extent of what is left
    inside = F.lit(True)
    for a in AXES:
        lo = F.when(ok1, F.col(f"_lo1_{a}")).otherwise(F.col(f"_lo0_{a}"))
        hi = F.when(ok1, F.col(f"_hi1_{a}")).otherwise(F.col(f"_hi0_{a}"))
        size = (hi - lo) * between(draw, f"box.{a}", *cfg.box_frac, c)
        centre = between(draw, f"centre.{a}", lo, hi, c)
        inside = inside & (F.abs(F.col(a) - centre) <= size / 2.0)
    use = big & (draw("box", c) < cfg.p_box)
    d = d.withColumn("_k2", F.col("_e1") & ~(use & inside))
    d = with_group(
        d, [cloud], F.count(F.when(F.col("_k2"), 1)).alias("_n2"), *spans(F.col("_k2"), "2", ["y"]), cut=True
    )
    ok2 = F.col("_n2") >= few
    d = d.withColumn("_e2", F.when(ok2, F.col("_k2")).otherwise(F.col("_e1")))

    # lower part hidden in most cases
    def edge(name: str) -> Column:
        before = F.when(ok1, F.col(f"_{name}1_y")).otherwise(F.col(f"_{name}0_y"))
        return F.when(ok2, F.col(f"_{name}2_y")).otherwise(before)

    cut = between(draw, "cut", *cfg.height_cut_frac, c) * (edge("hi") - edge("lo"))
    shown = F.when(draw("bottom", c) < 0.7, F.col("y") <= edge("hi") - cut).otherwise(
        F.col("y") >= edge("lo") + cut
    )
    use = big & (draw("height", c) < cfg.p_height_cut)
    d = d.withColumn("_k3", F.col("_e2") & (~use | shown))
    d = with_group(d, [cloud], F.count(F.when(F.col("_k3"), 1)).alias("_n3"), cut=True)
    kept = F.when(F.col("_n3") >= few, F.col("_k3")).otherwise(F.col("_e2"))
    d = d.where(kept).select(*cols, "_n0")

    d = d.withColumn("_u", draw("subsample", F.col(idx), F.col(cloud)))
    d = Ordered(d, [cloud], ["_u", idx], limit).add(_rn=row_number(), _n=group_total()).result()
    k = F.greatest(F.lit(1), F.rint(F.col("_n") * between(draw, "share", *cfg.subsample_keep, c)))
    use = big & (draw("thin", c) < cfg.p_subsample) & (k >= few)
    return d.where(~use | (F.col("_rn") <= k)).select(*cols)


def drop_channels(
    df: DataFrame,
    cloud: str,
    channel: str,
    n_channels: int,
    frac: Column | float,
    min_points: int = 16,
    draw: Draw | None = None,
    when: Column | None = None,
) -> DataFrame:
    """Without a random share of the channels, unless too few points of the cloud would remain.

    Channels are ranked per cloud inside one array, so no point is shuffled for the choice.
    """
    draw = draw or hashed()
    f = frac if isinstance(frac, Column) else F.lit(float(frac))
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(draw(f"channel{i}", F.col(cloud)).alias("u"), F.lit(i).alias("c"))
                for i in range(n_channels)
            ]
        )
    )
    clouds = df.groupBy(cloud).agg(F.count(F.lit(1)).alias("_n"))
    k = F.rint(F.lit(float(n_channels)) * f).cast("int")
    gone = F.transform(F.slice(ranked, 1, F.greatest(k, F.lit(0))), lambda s: s["c"])
    if when is not None:
        gone = F.when(when, gone).otherwise(F.array().cast("array<int>"))
    lost = clouds.select(cloud, gone.alias("_gone"))
    d = df.join(lost, cloud)
    keep = ~F.array_contains("_gone", F.col(channel).cast("int"))
    return _unless_too_few(d, cloud, keep, min_points).drop("_gone")


def cover(
    df: DataFrame,
    channels: int,
    az_min: float,
    az_max: float,
    left: float = 0.0,
    right: float = 0.0,
    top: float = 0.0,
    bottom: float = 0.0,
    azimuth: str = "azimuth",
    channel: str = "channel",
) -> DataFrame:
    """Without the returns a cover in front of the sensor hides (shares of window and channels)."""
    span = az_max - az_min
    az, ch = F.col(azimuth), F.col(channel)
    return df.where(
        (az >= az_min + left * span)
        & (az <= az_max - right * span)
        & (ch >= top * channels)
        & (ch < channels - bottom * channels)
    )


def perturb_pose(pose: Column, draw: Draw, rot_std_deg: float, trans_std_m: float, *keys: Column):
    """A sensor pose with calibration noise: small random turn, then a random shift."""
    angles = [F.radians(normal(draw, f"rot{i}", *keys) * rot_std_deg) for i in range(3)]
    r = V.mat_mul(V.euler_xyz_to_matrix(*angles), V.rotation_of(pose))
    shift = [normal(draw, f"shift{i}", *keys) * trans_std_m for i in range(3)]
    t = V.array(*[V.parts_of(V.translation_of(pose))[i] + shift[i] for i in range(3)])
    return V.se3(r, t)


def augment_points(
    df: DataFrame,
    cloud: str,
    idx: str,
    channel: str | None,
    n_channels: int,
    cfg: PointAugmentConfig | None = None,
    draw: Draw | None = None,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Occlusion, channel loss, jitter and outliers, in this order."""
    cfg, draw = cfg or PointAugmentConfig(), draw or hashed()
    c = F.col(cloud)
    # read several times below: by the channel counts, the outlier boxes and the result
    d = checkpoint(occlude(df, cloud, idx, cfg.occlusion, draw, limit))
    if channel is not None:
        d = drop_channels(
            d,
            cloud,
            channel,
            n_channels,
            between(draw, "channel_share", *cfg.channel_dropout, c),
            cfg.occlusion.min_points,
            draw,
            draw("channel_loss", c) < cfg.p_channel_dropout,
        )
    d = jitter(d, idx, between(draw, "jitter_std", *cfg.jitter_std_m, c), draw, cloud)
    return add_outliers(
        d,
        cloud,
        between(draw, "outlier_share", *cfg.outlier_fraction, c),
        cfg.outlier_spread_m,
        draw,
        draw("outliers", c) < cfg.p_outliers,
    )
