"""Nearest-neighbour and overlap joins on a grid, exact under any density.

Copies of one position are folded before anything is joined. Small groups are compared whole, block
by block. Positions of others are sorted into a pyramid of cells, written once for any number of
searches. A query starts at the root and walks down level by level, keeping only the cells that no
other cell rules out by its distance bounds. The last level is chosen from counted cell sizes so that a cell holds few
positions; the final join therefore meets a bounded number of rows per query, also inside
a cell that holds most of the table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import checkpoint, scratch_path

LEAF_ROWS = 64  # positions per last-level cell the pyramid aims for
MAX_DEPTH = 30  # cells down to a billionth of the extent; one far outlier costs depth, not an overfull cell
STEP = 2  # levels per descent
SMALL_GROUP = 4096  # positions of a group that is compared whole
BLOCK_QUERIES = 20_000  # of such a group in one task
BUNDLE_ROWS = 100_000  # queries and points that go to Python at once, one block at least
TASK_PAIRS = 1 << 18  # distances worked on at a time
BROADCAST_BITS = 12  # a level of at most 2^12 cells may be broadcast
COVER_STEP = 4  # a covering level has cells this many times as wide as the one below
COVER_CELLS = 4  # cells a box spans at most on its own level, along each axis


def _cells(coords: Sequence[str], origin: Sequence[Column], size: Column, depth: int) -> list:
    """Integer cell of each coordinate at ``depth`` halvings of ``size``."""
    width = size / F.lit(float(1 << depth))
    return [F.floor((F.col(c) - o) / width).cast("long") for c, o in zip(coords, origin)]


def _up(col: str, levels: int) -> Column:
    return F.shiftright(F.col(col), levels) if levels else F.col(col)


def _fullest(points: DataFrame, by: list[str], cells: list[str], first: int, last: int) -> dict[int, int]:
    """Positions in the fullest cell at each depth from ``first`` to ``last``, from one count.

    ``cells`` are given at ``MAX_DEPTH``; coarser cells are counted from those below them.
    """
    at = [_up(c, MAX_DEPTH - last).alias(c) for c in cells]
    finest = points.select(*by, *at).groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("_n"))
    drops = F.explode(F.sequence(F.lit(0), F.lit(last - first))).alias("_up")
    levels = finest.select(*by, *cells, "_n", drops)
    coarse = [F.expr(f"shiftright({c}, _up)").alias(c) for c in cells]
    top = (
        levels.select(*by, "_up", "_n", *coarse)
        .groupBy("_up", *by, *cells)
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_up")
        .agg(F.max("_n").alias("_n"))
        .collect()  # a row per depth
    )
    return {last - r["_up"]: r["_n"] for r in top}


def _depth_needed(points: DataFrame, by: list[str], cells: list[str], leaf: int, largest: int) -> int:
    """A depth whose fullest cell holds at most ``leaf`` positions.

    The largest group gives the depth an even spread would need; from there on four depths at a
    time are counted until one fits.
    """
    if largest <= leaf:
        return 0
    first = max(1, math.ceil(math.log(largest / leaf, 1 << len(cells))))
    while first < MAX_DEPTH:
        last = min(first + 3, MAX_DEPTH)
        fitting = [d for d, n in _fullest(points, by, cells, first, last).items() if n <= leaf]
        if fitting:
            return min(fitting)
        first = last + 1
    return MAX_DEPTH


def _first_k(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` smallest of each row, in order; of equal ones the first comes first."""
    if k == 1:
        return d.argmin(axis=1)[:, None]
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    # only what is not beyond the k-th value is sorted
    row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
    order = np.lexsort((col, d[row, col], row))
    first = np.searchsorted(row, np.arange(len(d)))
    return col[order][first[:, None] + np.arange(k)]


def _nearest_of(q: np.ndarray, p: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, point, distance, rank) of the nearest points of all queries, as arrays by slices of the queries."""
    step = max(1, TASK_PAIRS // max(1, len(p)))
    for at in range(0, len(q) if len(p) else 0, step):
        d = np.zeros((len(q[at : at + step]), len(p)))
        for i in range(q.shape[1]):
            gap = q[at : at + step, i, None] - p[None, :, i]
            gap *= gap
            d += gap
        np.sqrt(d, out=d)
        best = _first_k(d, k)
        near = np.take_along_axis(d, best, axis=1)
        ranks = np.tile(np.arange(1, best.shape[1] + 1), len(d))
        yield np.repeat(np.arange(at, at + len(d)), best.shape[1]), best.ravel(), near.ravel(), ranks


def _pairs_of_bundle(by: list[str], coords: list[str], k: int, limit: float | None):
    """Nearest points of blocks of queries among all points of their small groups, for many blocks at once."""
    part = ["_group", "_block"]

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        # the first of equal distances has the smaller id
        points = points.sort_values([*part, "_pid"], kind="stable")
        queries = queries.sort_values(part, kind="stable")
        q, p = (d[coords].to_numpy(np.float64) for d in (queries, points))
        found = []
        starts = points.groupby(part, sort=False).size()
        ends = starts.cumsum()
        spans = dict(zip(starts.index, zip(ends - starts, ends)))
        first = 0
        for at, n in queries.groupby(part, sort=False).size().items():
            low, high = spans.get(at, (0, 0))
            for i, j, d, rank in _nearest_of(q[first : first + n], p[low:high], k):
                keep = slice(None) if limit is None else d <= limit
                found.append((i[keep] + first, j[keep] + low, d[keep], rank[keep]))
            first += n
        i, j, d, rank = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        out = queries[[*by, "_qid"]].iloc[i].reset_index(drop=True)
        return out.assign(_pid=points["_pid"].to_numpy()[j], distance=d.astype(float), rank=rank.astype(np.int64))

    return run


class PointIndex:
    """Points sorted for nearest-neighbour searches, written once and searched many times.

    Copies of a position are folded to the ``k`` smallest ids, the most that a search can ask for.
    Groups of at most ``small`` positions are kept as they are: a search compares them whole. The
    others go into a pyramid of cells whose leaves hold about ``leaf`` positions. The leaves are a
    table bucketed by group and cell, so a search shuffles queries and never the points; the cells of
    all levels are counted from those of the lowest.

    ``by`` are the groups (none: all points are one), ``coords`` the coordinates; points with a
    missing one are left out.
    """

    def __init__(
        self, points: DataFrame, *, by: Sequence[str] = (), coords: Sequence[str], point_id: str, k: int = 1,
        leaf: int = LEAF_ROWS, small: int = SMALL_GROUP,
    ) -> None:
        self.by, self.coords, self.point_id, self.k = list(by), list(coords), point_id, k
        self.spark = points.sparkSession
        self.names = [f"_c{i}" for i in range(len(self.coords))]
        self.kind = dict(points.dtypes)[point_id]
        cast = [F.col(c).cast("double").alias(c) for c in self.coords]
        pts = points.where(_finite(self.coords)).select(*self.by, *cast, F.col(point_id).alias("_pid"))
        if k == 1:
            pts = pts.groupBy(*self.by, *self.coords).agg(F.min("_pid").alias("_pid"))
        else:
            w = Window.partitionBy(*self.by, *self.coords).orderBy("_pid")
            pts = pts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
        pts = checkpoint(pts)
        extent = [
            F.count(F.lit(1)).alias("_n"),
            *[F.min(c).alias(f"_o{i}") for i, c in enumerate(self.coords)],
            # a little wider than the extent, so that the far edge stays in the root cell
            (F.greatest(*[F.max(c) - F.min(c) for c in self.coords], F.lit(1e-9)) * 1.000001).alias("_size"),
        ]
        groups = pts.groupBy(*self.by).agg(*extent)
        if self.by:
            groups = checkpoint(groups)
            top = groups.agg(F.max("_n"), F.max(F.when(F.col("_n") <= small, F.col("_n")))).first()
            self.largest, some = int(top[0] or 0), bool(top[1])
            self.frame = None
        else:
            self.frame = groups.first()  # one row
            self.largest = int(self.frame["_n"])
            some = 0 < self.largest <= small
        self.small = None
        self.depth, self.levels, self.leaves = 0, None, None
        if some:
            self.small = pts
            self.small_groups = groups.where(F.col("_n") <= small)
            if self.largest > small:
                self.small = self._of(pts, self.small_groups)
        if self.largest > small:
            self._build(pts, groups.where(F.col("_n") > small), leaf)

    def _of(self, df: DataFrame, groups: DataFrame, *cols: str) -> DataFrame:
        """Rows of ``df`` in ``groups``, with columns of these."""
        if not self.by:
            return df.select("*", *[F.lit(float(self.frame[c])).alias(c) for c in cols])
        return df.join(groups.select(*self.by, *cols), self.by)

    def _build(self, pts: DataFrame, groups: DataFrame, leaf: int) -> None:
        origin = [f"_o{i}" for i in range(len(self.coords))]
        pts = self._of(pts, groups, *origin, "_size")
        fine = _cells(self.coords, [F.col(o) for o in origin], F.col("_size"), MAX_DEPTH)
        pts = pts.select(*self.by, *self.coords, "_pid", *[c.alias(n) for c, n in zip(fine, self.names)])
        if self.by:  # a join, read for the depth and for the leaves
            pts = checkpoint(pts)
        self.depth = _depth_needed(pts, self.by, self.names, leaf, self.largest)
        cell = [_up(n, MAX_DEPTH - self.depth).alias(n) for n in self.names]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [*self.by, *self.names]
        self.table = f"point_index_{uuid.uuid4().hex}"
        leaves = pts.select(*self.by, "_pid", *self.coords, *cell).repartition(buckets, *keys)
        path = scratch_path(self.spark, "points")
        leaves.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(self.table)
        self.leaves = self.spark.table(self.table)
        bounds = [
            *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(self.coords)],
            *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(self.coords)],
        ]
        low = self.leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *bounds)
        again = [
            F.sum("_n").alias("_n"),
            *[F.min(f"_lo{i}").alias(f"_lo{i}") for i in range(len(self.coords))],
            *[F.max(f"_hi{i}").alias(f"_hi{i}") for i in range(len(self.coords))],
        ]
        # cells of all levels from those of the lowest, in one pass
        depths = F.explode(F.array(*[F.lit(d) for d in sorted({0, *self._steps()})])).alias("_d")
        rest = [c for c in low.columns if c not in self.names]
        up = [F.expr(f"shiftright({n}, {self.depth} - _d)").alias(n) for n in self.names]
        cells = low.select("*", depths).select("_d", *rest, *up).groupBy("_d", *keys).agg(*again)
        path = scratch_path(self.spark, "cells")
        cells.write.partitionBy("_d").parquet(path)
        self.levels = path

    def _steps(self) -> list[int]:
        """Depths of the levels that a search descends to."""
        return [*range(self.depth % STEP or STEP, self.depth + 1, STEP)] if self.depth else []

    def _level(self, d: int) -> DataFrame:
        """Occupied cells at depth ``d`` with their tight bounds."""
        return self.spark.read.parquet(f"{self.levels}/_d={d}")

    def drop(self) -> None:
        """Forget the leaves' table; its files go with the shared folder."""
        if self.leaves is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def search(self, queries: DataFrame, query_id: str, k: int = 1, max_distance: float | None = None) -> DataFrame:
        """The ``k`` nearest points of every query inside its group.

        Returns ``by + query_id + point_id + distance + rank``; ties go to the smaller point id.
        ``max_distance`` is inclusive; without it every query of a non-empty group finds points.
        """
        if k > self.k:
            raise ValueError(f"the index keeps {self.k} ids of a position, asked for {k}")
        cast = [F.col(c).cast("double").alias(c) for c in self.coords]
        qs = queries.where(_finite(self.coords)).select(*self.by, *cast, F.col(query_id).alias("_qid"))
        parts = []
        if self.small is not None:
            parts.append(self._search_small(qs, k, max_distance))
        if self.leaves is not None:
            parts.append(self._search_pyramid(qs, k, max_distance))
        if not parts:
            kinds = {**dict(qs.dtypes), query_id: dict(queries.dtypes)[query_id], self.point_id: self.kind}
            cols = ", ".join(f"{c} {kinds[c]}" for c in [*self.by, query_id, self.point_id])
            return self.spark.createDataFrame([], f"{cols}, distance double, rank long")
        out = reduce(DataFrame.unionByName, parts)
        return out.select(*self.by, F.col("_qid").alias(query_id), F.col("_pid").alias(self.point_id), "distance", "rank")

    def _search_small(self, qs: DataFrame, k: int, limit: float | None) -> DataFrame:
        """Whole groups against blocks of their queries; a hot group has many blocks."""
        kinds = dict(qs.dtypes)
        count = F.count(F.lit(1)).alias("_rows")
        sizes = qs.groupBy(*self.by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("_blocks"), count)
        if self.by:
            # groups are numbered, so that many of them can go to Python at once
            sizes = checkpoint(sizes.join(self.small_groups.select(*self.by, "_n"), self.by).withColumn("_group", F.monotonically_increasing_id()))
            rows = sizes.agg(F.sum(F.col("_rows") + F.col("_n") * F.col("_blocks"))).first()[0] or 0
            sizes = sizes.drop("_rows", "_n")
            q = qs.join(sizes, self.by)
            p = self.small.join(sizes, self.by)
        else:
            n, rows = sizes.first()
            q, p = (d.withColumns({"_blocks": F.lit(n), "_group": F.lit(0).cast("long")}) for d in (qs, self.small))
            rows += n * self.largest
        q = q.withColumn("_block", F.pmod(F.xxhash64("_qid", *self.coords), F.greatest("_blocks", F.lit(1))).cast("int")).drop("_blocks")
        each = F.sequence(F.lit(0), F.greatest(F.col("_blocks") - 1, F.lit(0)))
        p = p.withColumn("_block", F.explode(each)).drop("_blocks")
        bundles = F.lit(max(1, math.ceil(rows / BUNDLE_ROWS)))
        q, p = (d.withColumn("_bundle", F.pmod(F.xxhash64("_group", "_block"), bundles)) for d in (q, p))
        p = p.drop(*self.by)
        out = ", ".join(f"{c} {kinds[c]}" for c in self.by) + (", " if self.by else "")
        out += f"_qid {kinds['_qid']}, _pid {self.kind}, distance double, rank long"
        return q.groupBy("_bundle").cogroup(p.groupBy("_bundle")).applyInPandas(_pairs_of_bundle(self.by, self.coords, k, limit), out)

    def _search_pyramid(self, qs: DataFrame, k: int, max_distance: float | None) -> DataFrame:
        """Down the levels, keeping the cells that no other cell rules out by its distance bounds."""
        by, coords, names = self.by, self.coords, self.names

        def bounds(df: DataFrame) -> DataFrame:
            near, far = [], []
            for i, c in enumerate(coords):
                q, lo, hi = F.col(c), F.col(f"_lo{i}"), F.col(f"_hi{i}")
                gap = F.greatest(lo - q, q - hi, F.lit(0.0))
                reach = F.greatest(F.abs(q - lo), F.abs(q - hi))
                near.append(gap * gap)
                far.append(reach * reach)
            return df.withColumn("_near", reduce(add, near)).withColumn("_far", reduce(add, far))

        slack = 1 + 1e-9

        def prune(df: DataFrame) -> DataFrame:
            df = bounds(df)
            if max_distance is not None:
                df = df.where(F.col("_near") <= F.lit(max_distance * max_distance * slack))
            w = Window.partitionBy(*by, "_qid", *coords)
            if k == 1:
                df = df.withColumn("_cut", F.min("_far").over(w))
            else:
                upto = w.orderBy("_far", *names).rowsBetween(Window.unboundedPreceding, 0)
                df = df.withColumn("_have", F.sum("_n").over(upto))
                df = df.withColumn("_cut", F.min(F.when(F.col("_have") >= k, F.col("_far"))).over(w))
            keep = F.col("_cut").isNull() | (F.col("_near") <= F.col("_cut") * slack + 1e-18)
            return df.where(keep).select(*by, "_qid", *coords, *names)

        top = self._level(0)
        if by:
            cand = qs.join(top.select(*by), by)
        else:
            cand = qs  # level 0 is one cell
        cand = cand.select(*by, "_qid", *coords, *[F.lit(0).cast("long").alias(n) for n in names])
        at = 0
        for below in self._steps():
            children = self._level(below).select("*", *[_up(n, below - at).alias(f"_up{n}") for n in names])
            if not by and len(coords) * below <= BROADCAST_BITS:
                children = F.broadcast(children)  # one group has at most 2^bits cells at this depth
            parents = cand.select(*by, "_qid", *coords, *[F.col(n).alias(f"_up{n}") for n in names])
            step = parents.join(children, [*by, *[f"_up{n}" for n in names]])
            cand = prune(step.drop(*[f"_up{n}" for n in names]))
            at = below
        last = self.leaves.select(*by, *names, "_pid", *[F.col(c).alias(f"_p_{c}") for c in coords])
        square = [(F.col(c) - F.col(f"_p_{c}")) * (F.col(c) - F.col(f"_p_{c}")) for c in coords]
        pairs = cand.join(last, [*by, *names]).select(
            *by, "_qid", *coords, "_pid", F.sqrt(reduce(add, square)).alias("distance")
        )
        if max_distance is not None:
            pairs = pairs.where(F.col("distance") <= F.lit(max_distance))
        if k == 1:
            best = pairs.groupBy(*by, "_qid", *coords).agg(F.min(F.struct("distance", "_pid")).alias("_b"))
            return best.select(*by, "_qid", "_b._pid", "_b.distance", F.lit(1).cast("long").alias("rank"))
        w = Window.partitionBy(*by, "_qid", *coords).orderBy("distance", "_pid")
        ranked = pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
        return ranked.select(*by, "_qid", "_pid", "distance", "rank")


def _finite(coords: Sequence[str]) -> Column:
    """All coordinates are known numbers."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in coords])


def nearest(
    queries: DataFrame,
    points: DataFrame,
    *,
    by: Sequence[str] = (),
    coords: Sequence[str],
    query_id: str,
    point_id: str,
    k: int = 1,
    max_distance: float | None = None,
    leaf: int = LEAF_ROWS,
    small: int = SMALL_GROUP,
) -> DataFrame:
    """The ``k`` nearest points of every query inside its ``by`` group: an index searched once.

    See :class:`PointIndex` and its ``search``.
    """
    index = PointIndex(points, by=by, coords=coords, point_id=point_id, k=k, leaf=leaf, small=small)
    return index.search(queries, query_id, k, max_distance)


def cover_level(lo: Sequence[Column], hi: Sequence[Column], size: float) -> Column:
    """Grid level of a box: the lowest one at which it is at most ``COVER_CELLS`` cells wide."""
    wide = reduce(F.greatest, [b - a for a, b in zip(lo, hi)]) / F.lit(size * COVER_CELLS)
    up = F.ceil(F.log(wide) / math.log(COVER_STEP))
    return F.when(wide <= 1, F.lit(0)).otherwise(up).cast("int")


def cell_width(size: float) -> Column:
    """Width of the cells of level ``_g``; powers of two times ``size``, so divisions agree."""
    return F.lit(size) * F.pow(F.lit(float(COVER_STEP)), F.col("_g"))


def on_levels(df: DataFrame, levels: Column, own: Column | None = None) -> DataFrame:
    """A row per level ``_g`` of the set ``levels``, from the row's own level up."""
    df = df.withColumn("_all", levels)
    at = F.col("_all") if own is None else F.filter("_all", lambda g: g >= own)
    return df.select("*", F.explode(at).alias("_g")).drop("_all")


def cover(df: DataFrame, lo: Sequence[Column], hi: Sequence[Column], size: float) -> DataFrame:
    """One row per cell of level ``_g`` that the box [lo, hi] touches, as columns ``_g0``, ``_g1`` …

    The level is no lower than the box's own (see ``cover_level``), so a box touches a bounded
    number of cells however large it is.
    """
    out = df
    for i, (a, b) in enumerate(zip(lo, hi)):
        first = F.floor(a / cell_width(size)).cast("long")
        final = F.floor(b / cell_width(size)).cast("long")
        out = out.withColumn(f"_g{i}", F.explode(F.sequence(first, final)))
    return out
