"""Fixed-ratio mixtures of sources, schedules, scan choice, modality dropout, track packing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.rand import Draw, between, hashed, normal, pick
from tallyfield.operators.ordered import MAX_GROUP_ROWS, Ordered, largest_group, row_number
from tallyfield.session import checkpoint


def batch_counts(weights: Sequence[float], batch: int, world: int = 1) -> list[int]:
    """Items of each source per batch and rank: rounded down, the rest to the heaviest one."""
    if not weights or sum(weights) <= 0:
        raise ValueError("weights must be non-empty and positive")
    total = sum(weights)
    w = [x / total for x in weights]
    per_rank = batch // world
    counts = [int(x * per_rank // 1) for x in w]
    counts[w.index(max(w))] += per_rank - sum(counts)
    return counts


def batch_count_table(sources: DataFrame, batch: int, world: int = 1) -> DataFrame:
    """The same for a table (source, weight): adds ``count``; equal weights by source name."""
    total = sources.agg(F.sum("weight").alias("_t"))
    per_rank = batch // world
    d = sources.withColumn("_n", F.floor(F.col("weight") / total.scalar() * per_rank))
    used = d.agg(F.sum("_n").alias("_sum")).scalar()
    first = F.min(F.struct((-F.col("weight")).alias("w"), F.col("source").alias("s")))
    top = d.agg(first.alias("_top")).select("_top.s").scalar()
    extra = F.when(F.col("source") == top, per_rank - used).otherwise(0)
    return d.select("source", "weight", (F.col("_n") + extra).cast("long").alias("count"))


def row_index(
    df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Adds ``row``: the 0-based place of a record in its source."""
    d = Ordered(df, by, order, limit).add(_rn=row_number()).result()
    return d.withColumn("row", F.col("_rn") - 1).drop("_rn")


def mixture(
    records: DataFrame,
    counts: dict[str, int],
    batches: int,
    *,
    source: str = "source",
    order: Sequence[str] = ("key",),
    draw: Draw | None = None,
    limit: int = MAX_GROUP_ROWS,
    rank: int = 0,
) -> DataFrame:
    """Records of ``batches`` batches, drawn with replacement, ``counts`` of each source in each.

    Empty sources are skipped. One row per slot: ``batch``, ``slot`` in its source, ``place``, the
    shuffled 0-based position in the batch, then the record. Each ``rank`` of several workers has
    draws of its own; ``counts`` are those of one rank (see ``batch_counts``). Slots are spread over
    tasks by batch and meet their record by (source, row), which is uniform, so no record key is hot.
    """
    draw = draw or hashed()
    indexed = row_index(records, [source], order, limit)
    name = F.col(source).cast("string")
    sizes = (
        records.where(name.isin([s for s, c in counts.items() if c > 0]))
        .groupBy(name.alias("s"))
        .count()
        .collect()  # one row per listed source
    )
    plan = F.array(
        *[
            F.struct(
                F.lit(r["s"]).alias("source"),
                F.lit(r["count"]).alias("_size"),
                F.lit(int(counts[r["s"]])).alias("_count"),
            )
            for r in sorted(sizes, key=lambda r: r["s"])
        ]
    )
    slots = (
        records.sparkSession.range(batches)
        .select(F.col("id").alias("batch"), F.explode(plan).alias("p"))
        .select(
            "batch",
            "p.source",
            "p._size",
            F.explode(F.sequence(F.lit(0), F.col("p._count") - 1)).alias("slot"),
        )
    )
    key = F.col("batch") * 100003 + F.col("slot")
    keys = [key, F.col("source"), F.col("batch"), F.col("slot"), F.lit(rank)]
    # a batch is as small as its counts say
    shuffled = Window.partitionBy("batch").orderBy(draw("mixture.place", *keys), "source", "slot")
    drawn = slots.select(
        "*",
        F.floor(draw("mixture", *keys) * F.col("_size")).alias("row"),
        (F.row_number().over(shuffled) - 1).cast("long").alias("place"),
    )
    named = indexed.withColumn("_s", F.col(source).cast("string"))
    out = drawn.drop("_size").withColumnRenamed("source", "_s").join(named, ["_s", "row"])
    return out.drop("_s", "row")


def pool_shares(df: DataFrame) -> DataFrame:
    """Per source its share in the mixture and its share by size (source, weight, records)."""
    def total(col: str) -> Column:
        return df.agg(F.sum(col)).scalar()

    return df.select(
        "source",
        (F.col("weight") / total("weight")).alias("mixture_share"),
        (F.col("records") / total("records")).alias("size_share"),
    )


def schedule(records: Column, batch: int, epochs: Column | float) -> Column:
    """Struct of steps per epoch and steps in all."""
    per = F.ceil(records / F.lit(float(batch)))
    e = epochs if isinstance(epochs, Column) else F.lit(float(epochs))
    return F.struct(per.cast("long").alias("steps_per_epoch"), F.ceil(e * per).cast("long").alias("max_steps"))


def pick_variant(
    scans: DataFrame, key: str, variant: str, draw: Draw | None = None, order: str = "variant"
) -> DataFrame:
    """One scan per record: the named variant, a random ``main_`` one, or the first as fallback."""
    draw = draw or hashed()
    name = F.col("variant")
    if variant == "random_main":
        rank = F.struct(
            (~name.startswith("main_")).alias("a"),
            F.when(name.startswith("main_"), draw("variant", F.col(key), name)).alias("b"),
            F.col(order).alias("c"),
        )
    else:
        rank = F.struct((name != variant).alias("a"), F.col(order).alias("c"))
    cols = [c for c in scans.columns if c != key]
    return scans.groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("_s")).select(key, "_s.*")


def choose_copy(df: DataFrame, key: str, p: float, draw: Draw | None = None) -> DataFrame:
    """Adds ``use_copy``: the augmented copy is used with probability ``p``."""
    draw = draw or hashed()
    return df.withColumn("use_copy", draw("copy", F.col(key)) < p)


def drop_modalities(
    df: DataFrame,
    key: str,
    p_image: float,
    p_points: float,
    draw: Draw | None = None,
) -> DataFrame:
    """Random loss of image or points, never of both; an absent modality is never dropped.

    Changes ``has_image`` and ``has_points``.
    """
    draw = draw or hashed()
    k = F.col(key)
    both = F.col("has_image") & F.col("has_points")
    img = (draw("image", k) < p_image) & both
    pts = (draw("points", k) < p_points) & both
    keep_image = draw("keep", k) < 0.5
    drop_img = img & ~(pts & keep_image)
    drop_pts = pts & ~(img & ~keep_image)
    return df.withColumns(
        {"has_image": F.col("has_image") & ~drop_img, "has_points": F.col("has_points") & ~drop_pts}
    )


def force_modality(df: DataFrame, modality: str) -> DataFrame:
    """Only ``image`` or only ``points``; ``both`` changes nothing.

    A record that lacks the wanted modality keeps what it has.
    """
    if modality not in ("both", "image", "points"):
        raise ValueError(f"unknown modality {modality!r}")
    if modality == "both":
        return df
    both = F.col("has_image") & F.col("has_points")
    gone = "has_points" if modality == "image" else "has_image"
    return df.withColumn(gone, F.col(gone) & ~both)


def jitter_bbox(bbox: Column, draw: Draw, scale_std: float, shift_std: float, *keys: Column) -> Column:
    """A box as a detector might give it: log-normal scale, centre moved relative to its size."""
    cx, cy = (bbox[0] + bbox[2]) / 2.0, (bbox[1] + bbox[3]) / 2.0
    w, h = bbox[2] - bbox[0], bbox[3] - bbox[1]
    s = F.exp(normal(draw, "scale", *keys) * scale_std) / 2.0
    x = cx + normal(draw, "dx", *keys) * shift_std * w
    y = cy + normal(draw, "dy", *keys) * shift_std * h
    return F.array(x - w * s, y - h * s, x + w * s, y + h * s)


KMH = 1.0 / 3.6
SPEED_STEP_KMH = 10.0  # fixed value: speeds are set in multiples of it


def sample_speed(
    draw: Draw, mean_kmh: float, std_kmh: float, *keys: Column, max_kmh: float = 130.0
) -> Column:
    """Speed in m/s: normal, clipped to [0, max]; settings must be multiples of 10 km/h."""
    for v in (mean_kmh, std_kmh):
        if v < 0 or abs(v / SPEED_STEP_KMH - round(v / SPEED_STEP_KMH)) > 1e-9:
            raise ValueError(f"speed settings are multiples of {SPEED_STEP_KMH:g} km/h")
    if std_kmh == 0:
        return F.lit(mean_kmh * KMH)
    v = normal(draw, "speed", *keys) * std_kmh + mean_kmh
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(max_kmh)) * KMH


# fixed variants of a frame's scan plan: name -> (fixed sensor or NULL for random, ball radius m or
# NULL for that of the main scans)
SCAN_VARIANTS = (
    ("ball025", None, 0.25),
    ("target_waymo", "waymo64", None),
    ("check", "OS1-64-1024", 0.0),
)


def scan_plan(
    frames: DataFrame,
    key: str,
    channels: Sequence[int] = (32, 64, 128, 256),
    steps: Sequence[int] = (512, 1024, 2048),
    family: str = "OS1",
    n_main: int = 2,
    radius_m: float = 1.0,
    tilt_deg: float = 5.0,
    draw: Draw | None = None,
) -> DataFrame:
    """One row per frame and scan variant: sensor and its place on a ball around the camera."""
    draw = draw or hashed()
    variants = [(f"main_{i}", None, radius_m) for i in range(n_main)] + list(SCAN_VARIANTS)
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("variant"),
                F.lit(s).cast("string").alias("fixed"),
                F.lit(float(radius_m if r is None else r)).alias("ball"),
            )
            for n, s, r in variants
        ]
    )
    d = frames.select(key, F.explode(rows).alias("v")).select(key, "v.*")
    k = (F.col(key), F.col("variant"))
    c = pick(draw, "channels", F.array(*[F.lit(int(x)) for x in channels]), *k)
    s = pick(draw, "steps", F.array(*[F.lit(int(x)) for x in steps]), *k)
    random = F.concat_ws("-", F.lit(family), c.cast("string"), s.cast("string"))
    n = [normal(draw, f"dir{i}", *k) for i in range(3)]
    d = d.withColumns({f"_n{i}": n[i] for i in range(3)})
    length = F.sqrt(sum([F.col(f"_n{i}") * F.col(f"_n{i}") for i in (1, 2)], F.col("_n0") * F.col("_n0")))
    r = draw("radius", *k) * F.col("ball")
    place = [r * F.col(f"_n{i}") / F.greatest(length, F.lit(1e-12)) for i in range(3)]
    tilt = [
        F.when(F.col("ball") > 0, between(draw, f"tilt{i}", -tilt_deg, tilt_deg, *k)).otherwise(0.0)
        for i in range(3)
    ]
    return d.select(
        key,
        "variant",
        F.coalesce(F.col("fixed"), random).alias("sensor"),
        F.array(*place).alias("position"),
        F.array(*tilt).alias("tilt_deg"),
    )


# --- packing ------------------------------------------------------------------


def _walk(lengths: np.ndarray, size: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy packing of one stretch from many fill states at once.

    Returns the fill state after the stretch and the number of batches closed on the way.
    """
    closed = np.zeros_like(state)
    for n in lengths:
        full = (state > 0) & (state + n > size)
        closed += full
        state = np.minimum(np.where(full, n, state + n), size)
    return state, closed


def pack_tracks(
    df: DataFrame, by: str, size: int, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Adds ``batch``: whole tracks in name order packed to about ``size`` rows each.

    A track starts a new batch when it does not fit the open one; a longer track fills a batch
    of its own. Only the table of track lengths is packed. If it is too long for one task it is
    cut into sorted ranges: each range is walked from every possible fill of the open batch
    (there are ``size`` + 1), the ranges are chained by those small tables, and every range is
    then packed from its true start.
    """
    lengths = df.groupBy(by).agg(F.count(F.lit(1)).alias("_len"))
    kind = dict(df.dtypes)[by]
    if largest_group(lengths, []) <= limit:
        parts = lengths.withColumn("_part", F.lit(0))
        starts = {0: (0, 0)}
    else:
        ranged = lengths.repartitionByRange(F.col(by))
        parts = checkpoint(ranged.withColumn("_part", F.spark_partition_id()))

        def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
            n = pdf.sort_values(by)["_len"].to_numpy()
            state, closed = _walk(n, size, np.arange(size + 1))
            return pd.DataFrame(
                {"_part": [int(pdf["_part"].iloc[0])], "_to": [state.tolist()], "_closed": [closed.tolist()]}
            )

        table = parts.groupBy("_part").applyInPandas(
            outcomes, "_part int, _to array<long>, _closed array<long>"
        )
        starts, fill, done = {}, 0, 0
        for row in sorted(table.collect(), key=lambda r: r["_part"]):  # one row per range
            starts[row["_part"]] = (fill, done)
            fill, done = row["_to"][fill], done + row["_closed"][fill]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        fill, batch = starts[int(pdf["_part"].iloc[0])]
        out = []
        for n in pdf["_len"]:
            if fill and fill + n > size:
                batch, fill = batch + 1, 0
            fill = min(fill + int(n), size)
            out.append(batch)
        return pdf[[by]].assign(batch=out)

    batches = parts.groupBy("_part").applyInPandas(assign, f"{by} {kind}, batch long")
    return df.join(batches, by)
