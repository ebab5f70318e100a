"""Picking rows of ordered groups: heads, even spreads, series thinning, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.ordered import (
    MAX_GROUP_ROWS,
    Ordered,
    carried,
    group_total,
    previous,
    row_number,
    running_sum,
)


def head(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows of each group (each task drops the rest before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def on_grid(i: Column, rows: Column, n: int, how: str) -> Column:
    """Whether 0-based position ``i`` of ``rows`` belongs to an evenly spaced set of ``n``.

    ``floor``: (j * rows) // n; ``ends``: both ends included, rounded half to even; ``ends_cut``:
    both ends, cut to whole numbers; ``series``: n - 1 even positions plus the last row.
    """
    if how in ("ends", "ends_cut"):
        if n == 1:
            return i == 0
        gap = (rows - 1) / F.lit(float(n - 1))
        place = (lambda j: F.rint(j * gap)) if how == "ends" else (lambda j: F.floor(j * gap))
        last = n - 1
    elif how == "floor":
        gap = rows / F.lit(float(n))
        place = lambda j: F.floor(j * rows / F.lit(n))
        last = n - 1
    else:
        gap = rows / F.lit(float(n))
        place = lambda j: F.floor(j * gap)
        last = n - 2
    near = F.floor(i / F.greatest(gap, F.lit(1e-12)))
    tries = F.sequence(near - 1, near + 2)
    hit = F.exists(tries, lambda j: (j >= 0) & (j <= last) & (place(j) == i))
    if how == "series":
        hit = hit | (i == rows - 1)
    return (rows <= n) | hit


def pick_even(
    df: DataFrame,
    n: int,
    by: Sequence[str],
    order: Sequence[Column | str],
    how: str = "floor",
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """About ``n`` evenly spaced rows of each group, all rows of shorter ones (see on_grid)."""
    d = Ordered(df, by, order, limit).add(_rn=row_number(), _rows=group_total()).result()
    keep = on_grid(F.col("_rn") - 1, F.col("_rows"), n, how)
    return d.where(keep).drop("_rn", "_rows")


def smooth_pairs(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    key: str,
    gap: float,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Neighbouring rows of one track less than ``gap`` apart, as (track, before, after, dt)."""
    d = Ordered(df.select(*by, time, key), by, [time, key], limit).add(
        _t=previous(F.col(time)), before=previous(F.col(key))
    )
    step = F.col(time) - F.col("_t")
    return (
        d.result()
        .where(F.abs(step) < gap)
        .select(*by, "before", F.col(key).alias("after"), step.alias("dt"))
    )


def track_order(df: DataFrame, by: Sequence[str], time: str, key: str, limit: int = MAX_GROUP_ROWS):
    """Adds ``pos``, the 0-based place of a row in its track."""
    d = Ordered(df, by, [time, key], limit).add(_rn=row_number()).result()
    return d.withColumn("pos", F.col("_rn") - 1).drop("_rn")


def track_sessions(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    key: str,
    gap: float,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds ``session``: a track is split where the gap to the row before is at least ``gap``."""
    d = Ordered(df, by, [time, key], limit).add(_t=previous(F.col(time)))
    fresh = F.coalesce((F.col(time) - F.col("_t") >= gap).cast("int"), F.lit(0))
    return d.add(session=running_sum(fresh)).result().drop("_t")


def speed(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    position: Sequence[str],
    fps: float = 30.0,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds ``speed``: distance to the row before in the same file, times the frame rate."""
    d = Ordered(df, by, order, limit).add(**{f"_p{i}": previous(F.col(c)) for i, c in enumerate(position)})
    square = [(F.col(c) - F.col(f"_p{i}")) ** 2 for i, c in enumerate(position)]
    out = d.result().withColumn("speed", F.sqrt(sum(square[1:], square[0])) * fps)
    return out.drop(*[f"_p{i}" for i in range(len(position))])


def fill_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    is_group: Column,
    name: Column,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds ``group_name``: the name set by the latest group row above."""
    return (
        Ordered(df, by, order, limit).add(group_name=carried(F.when(is_group, name))).result()
    )
