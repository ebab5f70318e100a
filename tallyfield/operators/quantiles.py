"""Exact percentiles that hold for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ordered import (
    MAX_GROUP_ROWS,
    Ordered,
    group_total,
    largest_group,
    running_sum,
)


def no_nan(col: Column) -> Column:
    """NaN as NULL, so that built-in aggregates skip it."""
    return F.when(~F.isnan(col), col)


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    col: Column,
    wanted: dict[str, float],
    lower: bool = False,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """One row per group with the named quantiles of ``col``; NULL and NaN are skipped.

    Linear between neighbours; ``lower`` takes the lower neighbour instead. Equal values
    are counted before the shuffle, so copies cost nothing.
    """
    by = list(by)
    values = (
        df.select(*by, no_nan(col.cast("double")).alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    if not lower and largest_group(values, by) <= limit:
        return values.groupBy(*by).agg(
            *[F.percentile("_v", F.lit(q), F.col("_n")).alias(n) for n, q in wanted.items()]
        )
    ranked = (
        Ordered(values, by, ["_v"], limit)
        .add(_upto=running_sum(F.col("_n")), _all=group_total(F.col("_n")))
        .result()
    )
    v, upto, rows = F.col("_v"), F.col("_upto"), F.col("_all")
    out = []
    for name, q in wanted.items():
        place = (rows - 1) * F.lit(q)
        low = F.min(F.when(upto > F.floor(place), v))
        high = F.min(F.when(upto > F.ceil(place), v))
        share = F.max(place - F.floor(place))
        # equal neighbours need no step between them; infinite ones have none
        value = low if lower else F.when(low == high, low).otherwise(low + (high - low) * share)
        out.append(value.alias(name))
    return ranked.groupBy(*by).agg(*out)


def quantiles_of(
    df: DataFrame,
    by: Sequence[str],
    wanted: Sequence[tuple[Column, dict[str, float]]],
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Named quantiles of several columns, each over its own known values, in one pass.

    Groups without any known value have no row; a column without one is NULL.
    """
    by = list(by)
    cells = [
        F.struct(F.lit(i).alias("_i"), no_nan(col.cast("double")).alias("_x")) for i, (col, _) in enumerate(wanted)
    ]
    # the computed array is exploded as it is, so the rows below are read once
    long = df.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c._i", "_c._x")
    levels = sorted({q for _, names in wanted for q in names.values()})
    each = quantiles(long, [*by, "_i"], F.col("_x"), {f"_q{k}": q for k, q in enumerate(levels)}, limit=limit)
    return each.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_i") == i, F.col(f"_q{levels.index(q)}"))).alias(name)
            for i, (_, names) in enumerate(wanted)
            for name, q in names.items()
        ]
    )


def join_groups(tables: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Side-by-side join of per-group tables on null-safe keys."""
    out = tables[0]
    for i, t in enumerate(tables[1:]):
        if not by:  # one row on each side
            out = out.select("*", *[t.select(c).scalar().alias(c) for c in t.columns])
            continue
        right = t.select(
            *[F.col(b).alias(f"_r{i}_{b}") for b in by], *[c for c in t.columns if c not in by]
        )
        on = [F.col(b).eqNullSafe(F.col(f"_r{i}_{b}")) for b in by]
        out = out.join(right, on, "left").drop(*[f"_r{i}_{b}" for b in by])
    return out
