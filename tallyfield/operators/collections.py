"""Statistics of whole collections: cameras, files, placements, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import parse_kv
from tallyfield.operators.ordered import MAX_GROUP_ROWS
from tallyfield.operators.quantiles import join_groups, quantiles, quantiles_of
from tallyfield.operators.sequences import fill_group, speed


def spread_of(name: str) -> dict[str, float]:
    """Names of median, 10th and 90th percentile."""
    return {f"{name}_median": 0.5, f"{name}_p10": 0.1, f"{name}_p90": 0.9}


def camera_stats(
    df: DataFrame,
    group: str,
    file: str = "file",
    order: str = "name",
    fps: float = 30.0,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per group: frames, camera height (m) and pitch with spread, median FOV and speed.

    Positions are in centimetres; speed is the step between rows of one file times ``fps``.
    """
    metres = df.withColumns({c: F.col(c) / 100.0 for c in ("x", "y", "z")})
    moved = speed(metres, [group, file], [order], ["x", "y", "z"], fps, limit)
    by = [group]
    parts = [
        moved.groupBy(group).agg(F.count(F.lit(1)).alias("frames")),
        quantiles_of(
            moved,
            by,
            [
                (F.col("z"), spread_of("height")),
                (F.col("pitch"), spread_of("pitch")),
                (F.col("hfov"), {"hfov_median": 0.5}),
                (F.col("speed"), {"speed_median": 0.5}),
            ],
            limit,
        ),
    ]
    return join_groups(parts, by)


def inventory(files: DataFrame, group: str, kinds: Sequence[str]) -> DataFrame:
    """Per group: sequences, frames and bytes of each kind of file, and whether it is there.

    Works on file metadata (sequence, kind, length); no content is read.
    """
    aggs = [F.countDistinct("sequence").alias("sequences")]
    for k in kinds:
        hit = F.col("kind") == k
        aggs += [
            F.count(F.when(hit, 1)).alias(f"{k}_files"),
            F.coalesce(F.sum(F.when(hit, F.col("length"))), F.lit(0)).alias(f"{k}_bytes"),
            F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"has_{k}"),
        ]
    return files.groupBy(group).agg(*aggs)


def placement_stats(
    df: DataFrame, group: str, order: Sequence[str], limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per collection: sequences with bodies, bodies, median per sequence, distinct assets.

    Rows of type ``Group`` open a sequence (its name is the first part of the comment), rows of
    type ``Body`` belong to the sequence above. A missing clothing or hair counts as a kind of
    its own, a missing shoe does not.
    """
    is_group = F.col("type") == "Group"
    named = fill_group(df, [group], order, is_group, F.split("comment", ";")[0], limit)
    body = named.where(F.col("type") == "Body").withColumn("_kv", parse_kv(F.col("comment")))

    def asset(name: str) -> Column:
        return F.try_element_at(F.col("_kv"), F.lit(name))

    body = body.withColumn("group_name", F.coalesce("group_name", F.lit("")))
    main = body.groupBy(group).agg(
        F.countDistinct("group_name").alias("sequences"),
        F.count(F.lit(1)).alias("bodies"),
        F.countDistinct("body").alias("subjects"),
        F.countDistinct(F.coalesce(asset("texture_clothing"), F.lit(""))).alias("clothing"),
        F.countDistinct(F.coalesce(asset("hair"), F.lit(""))).alias("hair"),
        F.countDistinct(F.when(asset("shoe") != "", asset("shoe"))).alias("shoes"),
    )
    per = body.groupBy(group, "group_name").agg(F.count(F.lit(1)).alias("_n"))
    med = quantiles(per, [group], F.col("_n"), {"bodies_per_sequence": 0.5}, limit=limit)
    return join_groups([main, med], [group])


def label_stats(
    df: DataFrame,
    by: Sequence[str],
    depth: Column,
    side: Column,
    beta0: Column,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows, depth with spread, median box side, population deviation of the first shape."""
    d = df.select(*by, depth.alias("_d"), side.alias("_s"), beta0.alias("_b"))
    parts = [
        d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.stddev_pop("_b").alias("beta0_std")),
        quantiles_of(d, by, [(F.col("_d"), spread_of("depth")), (F.col("_s"), {"side_median": 0.5})], limit),
    ]
    return join_groups(parts, by)


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[str], where: Column | None = None):
    """The first row of each key that meets the condition."""
    d = df if where is None else df.where(where)
    rest = [c for c in d.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return d.groupBy(*by).agg(best).select(*by, "_b.*")
