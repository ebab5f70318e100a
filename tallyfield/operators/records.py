"""Record keys, filters, gates and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.boxes import UP, box_reach, finite_box, inside_box, y_up
from tallyfield.operators.ordered import MAX_GROUP_ROWS, Ordered, row_number, with_group
from tallyfield.operators.quantiles import no_nan
from tallyfield.operators.spatial import cell_width, cover, cover_level, on_levels

MIN_BOX_H, MIN_BOX_W, MIN_POINTS = 90, 35, 30
CYCLES = ("vehicle.bicycle", "vehicle.motorcycle")


# --- keys ---------------------------------------------------------------------


def with_key(df: DataFrame, cols: Sequence[str], name: str = "key") -> DataFrame:
    """The record key: its parts joined by ``/`` (4 parts, 5 for generated records)."""
    return df.withColumn(name, F.concat_ws("/", *[F.col(c).cast("string") for c in cols]))


def parse_image_id(col: Column) -> Column:
    """(frame, camera, object) of ``frame_camera_object``; the object may hold ``_``."""
    parts = F.split(col, "_", 3)
    return F.struct(
        F.get(parts, 0).alias("frame"), F.get(parts, 1).alias("camera"), F.get(parts, 2).alias("object")
    )


def with_track(df: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``track`` (segment and object of the key) and ``time_s`` (leading microseconds).

    The object id alone repeats between segments, so the track keeps the segment.
    """
    parts = F.split(key, "/")
    micros = F.regexp_extract(F.get(parts, 2), r"^(\d+)", 1)
    return df.withColumn(
        "track", F.concat_ws("/", F.get(parts, 0), F.get(parts, 1), F.get(parts, 3))
    ).withColumn("time_s", micros.try_cast("bigint") / F.lit(1e6))


# --- filters ------------------------------------------------------------------


def filter_box(df: DataFrame, h: int = MIN_BOX_H, w: int = MIN_BOX_W) -> DataFrame:
    """Records whose person box is at least ``h`` by ``w`` pixels."""
    return df.where((F.col("box_h") >= h) & (F.col("box_w") >= w))


def filter_points(
    df: DataFrame, scans: DataFrame, n: int = MIN_POINTS, variant: str = "check", on: str = "key"
) -> DataFrame:
    """Records with at least ``n`` returns on one scan variant."""
    enough = scans.where((F.col("variant") == variant) & (F.col("count") >= n)).select(on)
    return df.join(enough, on, "left_semi")


def gate_status(
    box_h: Column,
    box_w: Column,
    points: Column,
    h: int = MIN_BOX_H,
    w: int = MIN_BOX_W,
    n: int = MIN_POINTS,
) -> Column:
    """Why a sample is refused, tested in this order, or ``accepted``; missing or NaN is refused."""
    fits = (no_nan(box_h) >= h) & (no_nan(box_w) >= w)
    return (
        F.when(~F.coalesce(fits, F.lit(False)), "rejected_box")
        .when(F.coalesce(no_nan(points), F.lit(0)) < n, "rejected_points")
        .otherwise("accepted")
    )


def gate_records(df: DataFrame, **limits: int) -> DataFrame:
    """Adds ``status``; every sample keeps its row."""
    status = gate_status(F.col("box_h"), F.col("box_w"), F.col("points"), **limits)
    return df.withColumn("status", status)


def merge_stats(df: DataFrame, group: str, counters: Sequence[str]) -> DataFrame:
    """Counters of all workers summed per group and, as the NULL group, over all."""
    return df.rollup(group).agg(*[F.sum(c).cast("long").alias(c) for c in counters])


def masked_or_all(
    points: DataFrame, masked: Column, by: Sequence[str], min_points: int = MIN_POINTS
) -> DataFrame:
    """The masked points of a cloud when enough survive, otherwise all of them."""
    flagged = points.withColumn("_in", masked)
    counted = with_group(flagged, by, F.count(F.when(F.col("_in"), 1)).alias("_n"))
    return counted.where((F.col("_n") < min_points) | F.col("_in")).drop("_in", "_n")


def of_category(col: Column, prefixes: Sequence[str]) -> Column:
    """Whether a category starts with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | col.startswith(p)
    return out


def keep_annotation(
    category: Column,
    returns: Column,
    attributes: Column,
    rider_attributes: Column,
    min_points: int = 50,
    cycles: Sequence[str] = CYCLES,
) -> Column:
    """Enough returns, and for a cycle an attribute that says somebody rides it."""
    ridden = F.coalesce(F.arrays_overlap(attributes, rider_attributes), F.lit(False))
    return (returns >= min_points) & (~of_category(category, cycles) | ridden)


def stride_by_number(df: DataFrame, n: int, frame: str = "frame") -> DataFrame:
    """Frames whose number divides by ``n``."""
    return df.where(F.col(frame) % n == 0)


def stride_by_position(
    df: DataFrame,
    n: int,
    by: Sequence[str],
    order: Sequence[str],
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Every ``n``-th row of each group in order, starting with the first."""
    rows = Ordered(df, by, order, limit).add(_rn=row_number()).result()
    return rows.where((F.col("_rn") - 1) % n == 0).drop("_rn")


def complete_frames(files: DataFrame, by: Sequence[str], kind: str = "kind") -> DataFrame:
    """Per frame whether both the image and the depth file exist."""
    return files.groupBy(*by).agg(
        (
            F.bool_or(F.col(kind) == "png") & F.bool_or(F.col(kind) == "depth")
        ).alias("complete")
    )


def all_valid(df: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """Frames in which the flag of every actor is set."""
    return df.groupBy(*by).agg(F.bool_and(flag).alias("_ok")).where("_ok").drop("_ok")


def in_split(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is on the list."""
    return df.join(ids.select(on), on, "left_semi")


def all_inside(corners_uvz: Column, width: Column, height: Column, z_min: float = 0.1) -> Column:
    """Whether all corners (u, v, depth) lie in the image and in front of the camera."""
    return F.forall(
        corners_uvz,
        lambda c: (c[2] > z_min) & (c[0] >= 0) & (c[0] < width) & (c[1] >= 0) & (c[1] < height),
    )


def points_in_box(
    points: DataFrame, boxes: DataFrame, on: str, box_id: str, margin: float = 0.0, cell_m: float = 2.0,
    up: int = UP,
) -> DataFrame:
    """(point, box) rows for points inside a box of the same frame, borders included.

    Points and boxes meet on a ground grid whose cells grow with the boxes, so a point is compared
    with the boxes around it and not with every box of its frame. ``up`` is the index of the up
    axis. Boxes with a missing, NaN or infinite number hold nothing.
    """
    whole = boxes.where(finite_box(F.col("box"))).select(on, box_id, y_up(F.col("box"), up).alias("box"))
    rx, rz = box_reach(F.col("box"))
    b = F.col("box")
    lo = [b[0] - rx - margin, b[2] - rz - margin]
    hi = [b[0] + rx + margin, b[2] + rz + margin]
    own = whole.withColumn("_g", cover_level(lo, hi, cell_m))
    grown = cover(own, lo, hi, cell_m)
    levels = own.agg(F.sort_array(F.collect_set("_g")))  # a few numbers: the levels that occur
    width = cell_width(cell_m)
    axes = ["xyz"[i] for i in range(3) if i != up]
    cells = on_levels(points, levels.scalar())
    for i, c in enumerate(axes):
        cells = cells.withColumn(f"_g{i}", F.floor(F.col(c) / width).cast("long"))
    hit = inside_box(F.array(axes[0], "xyz"[up], axes[1]), F.col("box"), margin)  # both in the y-up order
    return cells.join(grown, [on, "_g", "_g0", "_g1"]).where(hit).drop("_g", "_g0", "_g1", "box")


def count_in_boxes(
    points: DataFrame, boxes: DataFrame, on: str, box_id: str, margin: float = 0.0, cell_m: float = 2.0, up: int = UP,
) -> DataFrame:
    """(box, n): points inside each box of the same frame that holds any, borders included.

    As :func:`points_in_box`, but no pair is made of copies: points of one place and equal boxes of a
    frame meet once, with their numbers. The work grows with the different places and boxes.
    """
    places = points.groupBy(on, *"xyz").agg(F.count(F.lit(1)).alias("_n"))
    kinds = boxes.select(on, F.col("box").alias("_kind"), "box").distinct()
    hit = points_in_box(places, kinds, on, "_kind", margin, cell_m, up)
    held = hit.groupBy(on, "_kind").agg(F.sum("_n").alias("n"))
    return boxes.select(on, box_id, F.col("box").alias("_kind")).join(held, [on, "_kind"]).groupBy(box_id).agg(F.sum("n").alias("n"))


def within_radius(df: DataFrame, centre: Column, r: float = 1.5) -> DataFrame:
    """Points at most ``r`` metres from the centre."""
    p = F.array("x", "y", "z")
    d = sum([(p[i] - centre[i]) * (p[i] - centre[i]) for i in (1, 2)], (p[0] - centre[0]) ** 2)
    return df.where(F.sqrt(d) <= r)


# fixed values: label tag by the name of the label folder ("" = keypoints only)
LABEL_FOLDERS = {
    "v1_pseudo3": "v3",
    "v1_pseudo2": "v2",
    "v1_pseudo": "v1",
    "v1_lidarhmr": "lhmr",
    "v1_pedgen": "pedgen",
    "v1_simlidar": "v2",
    "v1": "",
}


def label_source(df: DataFrame, by: Sequence[str], folder: Column) -> DataFrame:
    """The label tags a run was fed with, distinct, sorted and joined by ``+``; unknown is ``?``."""
    name = F.element_at(F.split(folder, "/"), -1)
    pairs = [F.lit(x) for item in LABEL_FOLDERS.items() for x in item]
    tag = F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit("?"))
    distinct = df.select(*by, tag.alias("_t")).distinct()
    return distinct.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_set("_t")), "+").alias("labels")
    )


class MissingSidecar(ValueError):
    """A data file has no side file."""


def without_sidecar(df: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """How many items lack their side file, and the first of them."""
    lost = df.select(on).distinct().join(side.select(on), on, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("missing"), F.min(on).alias("example"))


def require_sidecar(df: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """``df`` itself; raises with count and example when a side file is missing."""
    row = without_sidecar(df, side, on).first()
    if row["missing"]:
        raise MissingSidecar(f"{row['missing']} without side file, e.g. {row['example']}")
    return df


def key_differences(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Keys (with multiplicity) that only one of two tables has."""
    only_a = a.select(on).exceptAll(b.select(on)).withColumn("side", F.lit("left"))
    only_b = b.select(on).exceptAll(a.select(on)).withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def assert_same_keys(a: DataFrame, b: DataFrame, on: str) -> None:
    """Raises when the key multisets differ (order is never part of a table)."""
    row = key_differences(a, b, on).limit(1).collect()
    if row:
        raise ValueError(f"key {row[0][on]!r} is only on the {row[0]['side']} side")


def has_label(bbox: Column, points: Column) -> Column:
    """A usable label: a box of four numbers and at least one return."""
    return F.coalesce((F.size(bbox) == 4) & (F.size(points) > 0), F.lit(False))


def first_per_frame(df: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """The first person of every frame."""
    others = [c for c in df.columns if c not in (*by, position)]
    best = F.min_by(F.struct(position, *others), F.col(position)).alias("_b")
    return df.groupBy(*by).agg(best).select(*by, "_b.*")


# --- putting tables together --------------------------------------------------


def concat_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """All sources under each other with their name and rank; absent columns are NULL."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        part = df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def union_keys(*tables: DataFrame, on: str = "key") -> DataFrame:
    """Distinct keys of several tables."""
    out = tables[0].select(on)
    for t in tables[1:]:
        out = out.union(t.select(on))
    return out.distinct()


def update_columns(df: DataFrame, updates: DataFrame, on: str = "key") -> DataFrame:
    """Columns replaced (types kept) or added from ``updates``, one row per record.

    A record without an update keeps its values. Several updates for one key are refused.
    """
    twice = updates.groupBy(on).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one update for {twice[0][on]!r}")
    fresh = [c for c in updates.columns if c != on]
    new = updates.select(on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in fresh])
    joined = df.join(new, on, "left")
    types = dict(df.dtypes)
    out = [
        F.when(F.col("_hit"), F.col(f"_n_{c}").cast(types[c])).otherwise(F.col(c)).alias(c)
        if c in fresh
        else F.col(c)
        for c in df.columns
    ]
    added = [F.col(f"_n_{c}").alias(c) for c in fresh if c not in df.columns]
    return joined.select(*out, *added)
