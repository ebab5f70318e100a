"""Audit of filters that overlap: what each removes, in every order they could be applied in.

Each document is reduced to a mask with a bit per filter it fails. Per part of the corpus the masks
are counted and the counts are put into a decision diagram: a level per filter, a branch for passing
and one for failing, counts at the ends, equal branches shared. A node's weight is the number of
documents that reach it, so the path on which every filter passes shows, step by step, what each
filter removes and what it leaves. Another order of the filters is another order of the levels, and
two neighbouring levels are swapped without touching the rest; a sequence of single swaps visits all
orders.

Texts are read once. What leaves a text is its mask and two hashes of 64 bits, and copies of a text
are combined before they are shuffled, so a text that a third of the rows share is a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.text import whole, words

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)
Weight = tuple[int, ...]


def add(a: Weight, b: Weight) -> Weight:
    """Sum of two weights, count by count."""
    return tuple(x + y for x, y in zip(a, b, strict=True))


class Diagram:
    """Counts of failure masks as a decision diagram with one level per filter.

    Every path passes every level, so a node's weight is the sum of its branches'. Nodes with equal
    branches are one. ``order`` has the filter (bit) of each level, from the top.
    """

    def __init__(self, n: int, counts: Mapping[int, Weight]) -> None:
        self.order = list(range(n))
        width = len(next(iter(counts.values())))
        self.passing: list[int] = []  # child of each node where the filter passes
        self.failing: list[int] = []
        self.weight: list[Weight] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        ends: dict[Weight, int] = {}

        def build(level: int, mask: int) -> int:
            if level == n:
                w = counts.get(mask, (0,) * width)
                if w not in ends:
                    ends[w] = self._new(-1, -1, w)
                return ends[w]
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, passing: int, failing: int, weight: Weight) -> int:
        self.passing.append(passing)
        self.failing.append(failing)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: int, passing: int, failing: int) -> int:
        known = self.levels[level]
        if (passing, failing) not in known:
            known[passing, failing] = self._new(passing, failing, add(self.weight[passing], self.weight[failing]))
        return known[passing, failing]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; only nodes of these two change."""
        upper = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            p, f = self.passing[node], self.failing[node]
            self.passing[node], self.failing[node] = (
                self._node(level + 1, self.passing[p], self.passing[f]),
                self._node(level + 1, self.failing[p], self.failing[f]),
            )
            self.levels[level][self.passing[node], self.failing[node]] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """(filter, weight removed, weight kept) along the path on which every filter passes."""
        node = self.root
        for bit in self.order:
            removed, node = self.failing[node], self.passing[node]
            yield bit, self.weight[removed], self.weight[node]

    def only(self, bit: int) -> Weight:
        """Weight of what fails this filter and no other."""
        node = self.root
        for at in self.order:
            node = self.failing[node] if at == bit else self.passing[node]
        return self.weight[node]


def single_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next one, n! - 1 in all, that lead through every order of n.

    One element is walked through the others from end to end; between two walks the others take
    one swap of their own.
    """
    if n < 2:
        return
    rest, down = single_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        inner = next(rest, None)
        if inner is None:
            return
        yield inner + 1 if down else inner
        down = not down


def _steps_of_part(names: Sequence[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        cols = ("mask", "docs", "good", "toxic")
        counts = {m: w for m, *w in zip(*(group[c].tolist() for c in cols), strict=True)}
        tree = Diagram(len(names), {m: tuple(w) for m, w in counts.items()})
        fails = [sum(w[0] for m, w in counts.items() if m >> b & 1) for b in range(len(names))]
        alone = [tree.only(b)[0] for b in range(len(names))]
        shapley = [0] * len(names)
        part, out = group["part"].iloc[0], []

        def note() -> None:
            order = "".join(names[b] for b in tree.order)
            for step, (b, gone, kept) in enumerate(tree.steps(), 1):
                shapley[b] += gone[0]
                out.append((part, order, step, kept[0], gone[0], fails[b] - gone[0], alone[b], gone[1], gone[2], b))

        note()
        for level in single_swaps(len(names)):
            tree.swap(level)
            note()
        frame = pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "bit"])
        frame["shapley"] = frame.pop("bit").map(dict(enumerate(shapley)))
        return frame

    return run


def audited(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per part, order of the filters, and step, from counts of failure masks.

    ``masks`` has (part, mask, docs, good, toxic), a row per part and mask or several. Bit i of a
    mask is set where filter ``names[i]`` fails. ``kept`` and ``removed`` count documents after and
    in the step, ``redundant`` those that fail its filter but were removed before, ``unique_fails``
    those that fail no other filter, ``good_lost`` and ``toxic_lost`` the labelled ones among the
    removed, and ``shapley`` what the filter removes summed over all orders. A part without
    documents has no rows. At most 7 filters: a part has n! * n rows.
    """
    if len(names) > 7:
        raise ValueError(f"{factorial(len(names))} orders of {len(names)} filters are too many")
    sums = [F.sum(c).cast("long").alias(c) for c in ("docs", "good", "toxic")]
    counted = masks.groupBy("part", "mask").agg(*sums)  # at most 2^n rows a part
    return counted.groupBy("part").applyInPandas(_steps_of_part(names), STEPS)


def failure_masks(
    docs: DataFrame, labels: DataFrame, filters: Sequence[Column], part: str = "lang", key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and by the filters that they fail.

    ``filters`` are conditions on a document, true where it fails, null taken as false; filter i is
    bit i. The last bit is set for a text that some row with a smaller key has too, anywhere in the
    table. Null texts are empty, and empty texts are equal. A null part is the empty string. Rows
    with a null key come after all others but before no other, so they never fail the last filter
    and carry no label. Rows that repeat are counted each; those that repeat a key do not make each
    other fail. Labels that repeat count once, with 1 if any of them is 1. Other columns are not
    looked at.
    """
    bit = len(filters)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters)), F.lit(0)).cast("int")
    rows = docs.select(
        F.col(key).cast("long").alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
        F.xxhash64(whole(text)).alias("h1"), F.xxhash64(F.lit(1), whole(text)).alias("h2"),
    )
    rows = rows.groupBy("k", "part", "mask", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t")
    )
    # rows without a key are dealt by their text; labels have 0 there
    told = told.withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("k").isNull(), F.col("h1")).otherwise(0)
    rows = rows.withColumn("id", F.coalesce("k", F.lit(0).cast("long"))).withColumn("spread", spread)
    rows = rows.join(told, ["id", "spread"], "left")
    rows = rows.withColumn("q", F.when(F.col("k").isNotNull(), F.coalesce("q", F.lit(0))).otherwise(0))
    rows = rows.withColumn("t", F.when(F.col("k").isNotNull(), F.coalesce("t", F.lit(0))).otherwise(0))
    # a text's rows of one part and label: their number, and the number at the smallest key
    sort = ["h1", "h2", "part", "mask", "q", "t"]
    kinds = rows.groupBy(*sort).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).alias("keyless"),
        F.min(F.when(F.col("k").isNotNull(), F.struct("k", "n"))).alias("low"),
    )
    first = kinds.groupBy("h1", "h2").agg(F.min("low.k").alias("first"))
    kinds = kinds.join(first, ["h1", "h2"])
    at_first = F.when(F.col("low.k") == F.col("first"), F.col("low.n")).otherwise(0)
    passing = F.col("keyless") + at_first
    both = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), passing.alias("docs")),
            F.struct(F.col("mask").bitwiseOR(1 << bit).alias("mask"), (F.col("n") - passing).alias("docs")),
        )
    )
    out = kinds.select("part", "q", "t", both.alias("m")).where("m.docs > 0")
    return out.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.docs").alias("docs"), F.sum(F.col("m.docs") * F.col("q")).alias("good"),
        F.sum(F.col("m.docs") * F.col("t")).alias("toxic"),
    )


# The signs that code and mark-up leave in prose.
SIGNS = "[#$%&*|]"


def text_filters(text: str = "text") -> list[Column]:
    """Few words, few different words, many capitals, signs: true where a text fails."""
    w, t = words(text), whole(text)
    n = F.size(w)
    return [
        n < 200,
        100 * F.size(F.array_distinct(w)) < 50 * n,
        100 * F.regexp_count(t, F.lit("[A-Z]")) > 3 * F.char_length(t),
        t.rlike(SIGNS),
    ]
