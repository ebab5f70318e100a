"""Label sets: relabelling, fallbacks, gates, confidences, quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.pose import shift_joints
from tallyfield.operators.ordered import MAX_GROUP_ROWS
from tallyfield.operators.quantiles import join_groups, no_nan, quantiles, quantiles_of


def place_at_centroid(pred: DataFrame, centroids: DataFrame, on: str, joints: str) -> DataFrame:
    """Predictions moved so that their root joint sits on the centroid of the returns.

    A record without returns keeps its own placement.
    """
    c = centroids.select(on, F.array("x", "y", "z").alias("_c"))
    root = F.col(joints)[0]
    step = F.array(*[F.col("_c")[i] - root[i] for i in range(3)])
    moved = F.when(F.col("_c")[0].isNotNull(), shift_joints(F.col(joints), step)).otherwise(
        F.col(joints)
    )
    return pred.join(c, on, "left").withColumn(joints, moved).drop("_c")


def relabel(
    records: DataFrame, labels: DataFrame, columns: Sequence[str], on: str = "key", flag: str = "has_smpl"
) -> DataFrame:
    """Records with their label columns replaced by another set; unknown keys are cleared."""
    new = labels.select(on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    kept = [c for c in records.columns if c not in (*columns, flag)]
    return records.join(new, on, "left").select(
        *kept,
        *[F.col(f"_l_{c}").alias(c) for c in columns],
        F.col("_hit").isNotNull().alias(flag),
    )


def init_with_fallback(
    records: DataFrame, first: DataFrame, second: DataFrame, centroids: DataFrame, on: str = "key"
) -> DataFrame:
    """Initial pose from the first set, else the second, else none.

    The second set has no usable position: there the centroid of the returns stands in, and
    the box centre where there are none. Adds ``pose``, ``transl`` and ``init``.
    """
    a = first.select(on, F.col("pose").alias("_pa"), F.col("transl").alias("_ta"))
    b = second.select(on, F.col("pose").alias("_pb"))
    c = centroids.select(on, F.col("centroid").alias("_c"))
    d = records.join(a, on, "left").join(b, on, "left").join(c, on, "left")
    has_a, has_b = F.col("_pa").isNotNull(), F.col("_pb").isNotNull()
    place = F.coalesce(F.col("_c"), F.col("box_centre"))
    return d.select(
        *records.columns,
        F.coalesce("_pa", "_pb").alias("pose"),
        F.when(has_a, F.col("_ta")).when(has_b, place).alias("transl"),
        F.when(has_a, "first").when(has_b, "second").otherwise("none").alias("init"),
    )


def fill_derived(df: DataFrame, derived: DataFrame, on: str = "key") -> DataFrame:
    """Columns of ``derived`` put in where a record lacks them."""
    cols = [c for c in derived.columns if c != on]
    extra = derived.select(on, *[F.col(c).alias(f"_d_{c}") for c in cols])
    filled = [
        F.coalesce(F.col(c), F.col(f"_d_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns
    ]
    added = [F.col(f"_d_{c}").alias(c) for c in cols if c not in df.columns]
    return df.join(extra, on, "left").select(*filled, *added)


# fixed values: gates and confidence widths of fitted labels (metres, prior energy)
MAX_KEYPOINT_M, MAX_CHAMFER_M, MAX_PRIOR = 0.08, 0.06, 6.0
KEYPOINT_SIGMA_M, CHAMFER_SIGMA_M = 0.05, 0.04


def label_confidence(
    df: DataFrame,
    keypoint: str = "kp_error_m",
    chamfer: str = "chamfer_m",
    prior: str = "prior_energy",
    sigmas: tuple[float, float] = (KEYPOINT_SIGMA_M, CHAMFER_SIGMA_M),
) -> DataFrame:
    """Adds ``accepted`` (all three gates, inclusive) and ``confidence`` (0 when rejected).

    A missing or NaN residual is rejected: no evidence is not good evidence.
    """
    kp, ch, en = (no_nan(F.col(c)) for c in (keypoint, chamfer, prior))
    ok = (kp <= MAX_KEYPOINT_M) & (ch <= MAX_CHAMFER_M) & (en <= MAX_PRIOR)
    ok = F.coalesce(ok, F.lit(False))
    a, b = kp / sigmas[0], F.least(ch, F.lit(1.0)) / sigmas[1]
    conf = F.exp(-(a * a)) * F.exp(-(b * b))
    return df.withColumn("accepted", ok).withColumn(
        "confidence", F.when(ok, conf).otherwise(F.lit(0.0))
    )


def acceptance_summary(df: DataFrame, by: Sequence[str] = (), limit: int = MAX_GROUP_ROWS):
    """Acceptance rate, residual statistics and overlapping reject counts of fitted labels."""
    kp, ch, en = (no_nan(F.col(c)) for c in ("kp_error_m", "chamfer_m", "prior_energy"))
    yes = F.col("accepted")
    main = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(yes, 1)).alias("accepted"),
        F.avg(yes.cast("double")).alias("acceptance_rate"),
        (F.avg(kp) * 1000).alias("keypoint_error_mm"),
        (F.avg(F.when(yes, kp)) * 1000).alias("keypoint_error_accepted_mm"),
        F.avg(en).alias("prior_energy_mean"),
        F.avg(F.when(yes, F.col("confidence"))).alias("confidence_mean_accepted"),
        F.count(F.when(kp > MAX_KEYPOINT_M, 1)).alias("rejected_by_keypoints"),
        F.count(F.when(ch > MAX_CHAMFER_M, 1)).alias("rejected_by_chamfer"),
        F.count(F.when(en > MAX_PRIOR, 1)).alias("rejected_by_prior"),
    )
    finite = F.when(ch < float("inf"), ch * 1000)
    med = quantiles(df, by, finite, {"chamfer_median_mm": 0.5}, limit=limit)
    return join_groups([main, med], by)


def band_report(
    df: DataFrame,
    value: Column,
    depth: Column,
    bands: Sequence[float] = (0.0, 10.0, 20.0, 40.0),
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Median, 90th percentile and mean per distance band and over all (``all``).

    Values beyond the last band count only in the total.
    """
    band = F.lit(None).cast("string")
    for lo, hi in zip(bands[:-1], bands[1:]):
        band = F.when((depth >= lo) & (depth < hi), f"{lo:g}-{hi:g}m").otherwise(band)
    names = F.filter(F.array(F.lit("all"), band), lambda b: b.isNotNull())
    d = df.select(F.explode(names).alias("band"), no_nan(value.cast("double")).alias("_v"))
    d = d.where(F.col("_v").isNotNull())
    mean = d.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    q = quantiles(d, ["band"], F.col("_v"), {"median": 0.5, "p90": 0.9}, limit=limit)
    return join_groups([mean, q], ["band"])


def label_set_report(df: DataFrame, by: Sequence[str], values: Sequence[str], limit: int = MAX_GROUP_ROWS):
    """Median of several error columns per label set, each over its own known values."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return join_groups([counts, quantiles_of(df, by, [(F.col(v), {v: 0.5}) for v in values], limit)], by)


def mean_vector(df: DataFrame, by: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """Element-wise mean of an array column per group."""
    flat = df.select(*by, F.posexplode(col).alias("_i", "_v"))
    means = flat.groupBy(*by, "_i").agg(F.avg("_v").alias("_m"))
    # one entry per array position, so the list is as long as one vector
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l"))
    return packed.select(*by, F.transform("_l", lambda s: s["_m"]).alias(name or col))


def weighted_mean(df: DataFrame, by: Sequence[str], x: Column, w: Column, name: str) -> DataFrame:
    """Weighted mean whose denominator is at least 1."""
    return df.groupBy(*by).agg((F.sum(x * w) / F.greatest(F.sum(w), F.lit(1.0))).alias(name))


def scan_stats(df: DataFrame, by: Sequence[str], count: str, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """Records with and without a scan, and median and 10th percentile of its returns."""
    main = df.groupBy(*by).agg(
        F.count(count).alias("simulated"), F.count(F.when(F.col(count).isNull(), 1)).alias("missing")
    )
    q = quantiles(df, by, F.col(count), {"median": 0.5, "p10": 0.1}, limit=limit)
    return join_groups([main, q], by)


def work_groups(
    df: DataFrame,
    by: Sequence[str],
    item: str,
    chunk: int = 4096,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Sorted items of each parent as lists of at most ``chunk``, numbered by ``part``.

    A parent with more items gives several work rows, so no list grows without bound.
    """
    from tallyfield.operators.ordered import Ordered, row_number

    d = Ordered(df.select(*by, item), by, [item], limit).add(_rn=row_number()).result()
    part = F.floor((F.col("_rn") - 1) / chunk).alias("part")
    return d.groupBy(*by, part).agg(F.array_sort(F.collect_list(item)).alias("items"))


def label_counts(df: DataFrame, by: str, flag: str = "has_smpl") -> DataFrame:
    """Labelled and total records per shard and, as the NULL shard, over all."""
    return df.rollup(by).agg(
        F.count(F.when(F.col(flag), 1)).alias("labelled"), F.count(F.lit(1)).alias("total")
    )


def lift_along_up(df: DataFrame, gt: str, pred: str, valid: str, up: str) -> Column:
    """Shift along the up vector that removes the mean keypoint residual in that direction."""
    gaps = F.zip_with(
        F.zip_with(gt, pred, lambda g, p: F.array(*[g[i] - p[i] for i in range(3)])),
        F.col(valid),
        lambda d, v: F.when(v, sum([d[i] * F.col(up)[i] for i in (1, 2)], d[0] * F.col(up)[0])),
    )
    kept = F.filter(gaps, lambda x: x.isNotNull())
    n = F.size(kept)
    lift = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    return F.array(*[F.col(up)[i] * lift for i in range(3)])


def ground_check(
    points: DataFrame, boxes: DataFrame, on: str, tolerance: float = 0.05
) -> DataFrame:
    """How far the lowest point of a body sinks below or hovers above its ground level.

    Ground is the lower face of the box (y points down); hovering less than the tolerance is 0.
    """
    low = points.groupBy(on).agg(F.max("y").alias("low"), F.min("y").alias("high"))
    d = boxes.select(on, (F.col("box")[1] + F.col("box")[4] / 2.0).alias("ground")).join(low, on)
    return d.select(
        on,
        "low",
        "high",
        F.greatest(F.col("low") - F.col("ground"), F.lit(0.0)).alias("sink"),
        F.greatest(F.col("ground") - F.col("low") - tolerance, F.lit(0.0)).alias("hover"),
    )


def check_sample(
    df: DataFrame, by: Sequence[str], order: Sequence[str], error: str, flag: str = "has_smpl", n: int = 8
) -> DataFrame:
    """Mean and largest keypoint error of the first ``n`` labelled records of each shard."""
    from tallyfield.operators.sequences import head

    first = head(df.where(F.col(flag)), n, by, order)
    return first.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error")
    )


def point_to_mesh(
    points: DataFrame, verts: DataFrame, on: str, ids: tuple[str, str], limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Distance of every return to the nearest vertex of its record, as the median per record."""
    from tallyfield.operators.spatial import nearest

    near = nearest(
        points, verts, by=[on], coords=["x", "y", "z"], query_id=ids[0], point_id=ids[1]
    )
    return quantiles(near, [on], F.col("distance"), {"median_m": 0.5}, limit=limit)
