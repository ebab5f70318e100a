"""Running values over a sorted group that may hold a third of all rows.

A plain window sorts one group in one task. That is fine while every group is known to be
small, so the group sizes are counted first (one column-pruned, map-side combined job).
Beyond the bound the rows are range-partitioned on (group, order), each range is worked on
its own, and one carry row per (group, range) joins the ranges back together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import checkpoint

MAX_GROUP_ROWS = 1_000_000  # rows one task may sort


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest group (0 for an empty table)."""
    if not by:
        return df.count()
    top = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return int(top or 0)


@dataclass(frozen=True)
class Running:
    """One value to add: ``kind`` applied to ``col`` in group order."""

    kind: str
    col: Column | None = None


def row_number() -> Running:
    """1-based position in the group."""
    return Running("row_number")


def running_sum(col: Column) -> Running:
    """Sum of this and all earlier rows."""
    return Running("sum", col)


def running_xor(col: Column) -> Running:
    """Exclusive or of this and all earlier rows."""
    return Running("xor", col)


def running_min(col: Column) -> Running:
    """Minimum of this and all earlier rows."""
    return Running("min", col)


def min_before(col: Column) -> Running:
    """Minimum of all earlier rows, without this one."""
    return Running("min_before", col)


def running_max(col: Column) -> Running:
    """Maximum of this and all earlier rows."""
    return Running("max", col)


def max_from_here(col: Column) -> Running:
    """Maximum of this and all later rows."""
    return Running("max_after", col)


def previous(col: Column) -> Running:
    """Value of the row before."""
    return Running("lag", col)


def carried(col: Column) -> Running:
    """Latest non-null value up to this row."""
    return Running("ffill", col)


def group_total(col: Column | None = None) -> Running:
    """Sum of ``col`` over the group; the row count without ``col``."""
    return Running("total", col)


def _free(name: str, taken: Sequence[str]) -> str:
    """``name`` with as many underscores in front as make it the start of no column in ``taken``."""
    while any(c.lower().startswith(name) for c in taken):
        name = f"_{name}"
    return name


class Ordered:
    """A table with sorted groups to which running values can be added step by step."""

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[str],
        order: Sequence[Column | str],
        limit: int = MAX_GROUP_ROWS,
    ) -> None:
        self.by = list(by)
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.split = largest_group(df, self.by) > limit
        if self.split:
            ranged = df.repartitionByRange(*[F.col(b) for b in self.by], *self.order)
            # the table may have any columns, also one of this name
            self.part = _free("_part", df.columns)
            df = checkpoint(ranged.withColumn(self.part, F.spark_partition_id()))
        self.df = df

    def _keys(self) -> list:
        return ([*self.by, self.part] if self.split else self.by) or [F.lit(0)]

    def _window(self):
        return Window.partitionBy(*self._keys()).orderBy(*self.order)

    def _local(self, op: Running) -> Column:
        w = self._window()
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if op.kind == "row_number":
            return F.row_number().over(w).cast("long")
        if op.kind == "sum":
            return F.sum(op.col).over(upto)
        if op.kind == "xor":
            return F.bit_xor(op.col).over(upto)
        if op.kind == "min":
            return F.min(op.col).over(upto)
        if op.kind == "max":
            return F.max(op.col).over(upto)
        if op.kind == "min_before":
            return F.min(op.col).over(w.rowsBetween(Window.unboundedPreceding, -1))
        if op.kind == "max_after":
            # a running maximum in reverse order: frames that end at the last row are
            # evaluated anew for every row
            back = Window.partitionBy(*self._keys()).orderBy(F.col(self._back).desc())
            return F.max(op.col).over(back.rowsBetween(Window.unboundedPreceding, 0))
        if op.kind == "lag":
            return F.lag(op.col).over(w)
        if op.kind == "ffill":
            return F.last(op.col, ignorenulls=True).over(upto)
        if op.kind == "total":
            every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            value = F.lit(1) if op.col is None else op.col
            return F.sum(value).over(every)
        raise ValueError(f"unknown running value {op.kind!r}")

    def _partial(self, op: Running) -> Column:
        """What one range contributes to the ranges after (or before) it."""
        if op.kind == "row_number":
            return F.count(F.lit(1))
        if op.kind in ("sum", "total"):
            return F.sum(F.lit(1) if op.col is None else op.col)
        if op.kind == "xor":
            return F.bit_xor(op.col)
        if op.kind in ("min", "min_before"):
            return F.min(op.col)
        if op.kind in ("max", "max_after"):
            return F.max(op.col)
        if op.kind == "lag":
            return F.max_by(F.struct(op.col.alias("v")), F.col(self._pos))
        return F.max_by(op.col, F.when(op.col.isNotNull(), F.col(self._pos)))

    def _carry(self, op: Running, part: str) -> Column:
        w = Window.partitionBy(*[F.col(f"{self._key}{b}") for b in self.by] or [F.lit(0)]).orderBy(f"{self._key}{self.part}")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        if op.kind in ("row_number", "sum"):
            return F.sum(part).over(before)
        if op.kind == "xor":
            return F.bit_xor(part).over(before)
        if op.kind in ("min", "min_before"):
            return F.min(part).over(before)
        if op.kind == "max":
            return F.max(part).over(before)
        if op.kind == "max_after":
            return F.max(part).over(w.rowsBetween(1, Window.unboundedFollowing))
        if op.kind == "lag":
            return F.lag(part).over(w)
        if op.kind == "ffill":
            return F.last(part, ignorenulls=True).over(before)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.sum(part).over(every)

    def _merge(self, op: Running, own: Column, carry: Column) -> Column:
        if op.kind == "row_number":
            return own + F.coalesce(carry, F.lit(0))
        if op.kind == "sum":
            return F.when(own.isNull(), carry).otherwise(
                own + F.coalesce(carry, F.lit(0).cast("long"))
            )
        if op.kind == "xor":
            return own.bitwiseXOR(F.coalesce(carry, F.lit(0).cast("long")))
        if op.kind in ("min", "min_before"):
            return F.least(own, carry)
        if op.kind in ("max", "max_after"):
            return F.greatest(own, carry)
        if op.kind == "lag":
            return F.when(F.col(self._pos) == 1, carry["v"]).otherwise(own)
        if op.kind == "ffill":
            return F.coalesce(own, carry)
        return carry

    def add(self, **ops: Running) -> Ordered:
        """Add running values as columns; later calls may build on earlier columns."""
        if self.split and any(n.lower() == self.part for n in ops):
            renamed = _free("_part", [*self.df.columns, *ops])
            self.df, self.part = self.df.withColumnRenamed(self.part, renamed), renamed
        before = self.df.columns
        # names of its own, at which no column of the table starts
        self._back, self._pos, own, total, carried_in, self._key = (
            _free(n, [*before, *ops]) for n in ("_back", "_pos", "_own_", "_sum_", "_in_", "_k_")
        )
        if any(op.kind == "max_after" for op in ops.values()):
            self.df = self.df.withColumn(self._back, F.row_number().over(self._window()))
        if not self.split:
            added = [self._local(op).alias(n) for n, op in ops.items()]
            self.df = self.df.select("*", *added).drop(self._back)
            return self
        local = self.df.select(
            "*",
            F.row_number().over(self._window()).alias(self._pos),
            *[self._local(op).alias(f"{own}{n}") for n, op in ops.items()],
        )
        keys = [*self.by, self.part]
        parts = local.groupBy(*[F.col(k).alias(f"{self._key}{k}") for k in keys]).agg(
            *[self._partial(op).alias(f"{total}{n}") for n, op in ops.items()]
        )
        carry = parts.select(
            *[f"{self._key}{k}" for k in keys],
            *[self._carry(op, f"{total}{n}").alias(f"{carried_in}{n}") for n, op in ops.items()],
        )
        on = [F.col(k).eqNullSafe(F.col(f"{self._key}{k}")) for k in keys]
        joined = local.join(carry, on, "left")
        self.df = joined.select(
            *before,
            *[
                self._merge(op, F.col(f"{own}{n}"), F.col(f"{carried_in}{n}")).alias(n)
                for n, op in ops.items()
            ],
        )
        return self

    def result(self) -> DataFrame:
        """The table with all added columns."""
        return self.df.drop(self.part) if self.split else self.df


def with_group(df: DataFrame, by: Sequence[str], *aggs: Column, cut: bool = False) -> DataFrame:
    """Group aggregates joined back to every row.

    Aggregating first combines on the map side, so a hot group costs one small row per task;
    an unbounded window would sort the whole group in one task. In a chain of such steps each
    join would double the work before it: ``cut`` then writes the small aggregate table.
    """
    if not by:
        raise ValueError("with_group needs at least one key")
    totals = df.groupBy(*by).agg(*aggs)
    if cut:
        totals = checkpoint(totals)
    renamed = totals.select(
        *[F.col(b).alias(f"_g_{b}") for b in by], *[c for c in totals.columns if c not in by]
    )
    on = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by]
    return df.join(renamed, on, "left").drop(*[f"_g_{b}" for b in by])
