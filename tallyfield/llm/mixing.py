"""Mixing sources to target weights by entropy balancing.

Each token of the corpus gets a rate, how often it is taken. Among all rates that meet the token
constraints the balanced ones are nearest to 1 in relative entropy; they have the form exp(sum of the
multipliers of the constraints the document is in), cut at ``max_rate``. The multipliers are the
maximum of a concave dual. Newton steps find it: gradient and curvature are sums over the corpus,
aggregated by Spark from sizes per cell (a combination of constraint values), so an iteration never
reads documents. Rates then become copies: whole parts, and fractions rounded systematically along
the sizes of a source, with a last pass over the smallest documents that closes the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.text import count_words
from tallyfield.operators.ordered import Ordered, row_number, running_sum
from tallyfield.session import checkpoint

MAX_RATE = 3
UNIT = 1_000_000  # fractions are rounded to this before they are summed, so that sums are exact
ROUNDS = 60  # of Newton; it ends far earlier unless constraints contradict each other


def shares(per: DataFrame, weights: Sequence[int], max_rate: int = MAX_RATE) -> DataFrame:
    """``per`` (source, mass) with ``target``: mass shared by weight, at most max_rate times its own.

    Sources by code point, null last, take the weights in turn. What is above a limit is shared
    again by weight among the others until none is above.
    """
    ranked = Ordered(per, [], [F.col("source").isNull(), F.col("source")]).add(_nth=row_number())
    turn = F.get(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_nth") - 1) % len(weights)).cast("int"))
    per = checkpoint(ranked.result().withColumn("_weight", turn).drop("_nth"))
    most = F.col("mass") * max_rate
    total = per.agg(F.sum("mass")).first()[0] or 0
    level, capped = None, None
    while True:
        above = F.lit(False) if level is None else F.col("_weight") * F.lit(level) > most
        got = per.agg(
            F.sum(F.when(above, most).otherwise(0)).alias("held"),
            F.sum(F.when(~above, F.col("_weight")).otherwise(0)).alias("weight"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if got["n"] == capped or not got["weight"]:
            break
        level, capped = (total - got["held"]) / got["weight"], got["n"]
    target = F.least(F.col("_weight") * F.lit(float(level or 0)), most.cast("double"))
    return per.select("source", "mass", target.alias("target"))


def balanced(
    cells: DataFrame, constraints: Sequence[tuple[str, DataFrame]], max_rate: float = MAX_RATE,
    tolerance: float = 1e-10,
) -> DataFrame:
    """``cells`` (constraint columns, mass) with ``rate``.

    ``constraints`` are (column, table of that column and ``target``): the mass times rate of each
    value must come to its target. Values of one column exclude each other, so the Hessian of a
    column is diagonal and its Newton step is one aggregation; columns take turns. Stops when all
    constraints hold to ``tolerance`` of the mass, or after ROUNDS (constraints that contradict).
    """
    names = [c for c, _ in constraints]
    state = checkpoint(cells.select(*names, "mass", F.lit(0.0).alias("eta")))
    mass = state.agg(F.sum("mass")).first()[0] or 0
    rate = F.least(F.exp("eta"), F.lit(float(max_rate)))
    tables = [(c, t.select(F.col(c).alias("_of"), F.col("target").alias("_target"))) for c, t in constraints]
    for _ in range(ROUNDS):
        worst = 0.0
        for c, targets in tables:
            sums = state.groupBy(c).agg(
                F.sum(F.col("mass") * rate).alias("_got"),
                F.sum(F.when(F.exp("eta") < max_rate, F.col("mass") * rate)).alias("_curve"),
            )
            sums = sums.join(targets, sums[c].eqNullSafe(targets["_of"]))
            # far from the solution a full step overshoots: e-folds of more than 2 come in parts
            full = F.greatest(F.least((F.col("_target") - F.col("_got")) / F.col("_curve"), F.lit(2.0)), F.lit(-2.0))
            back = F.when(F.col("_target") < F.col("_got"), F.lit(-0.1)).otherwise(F.lit(0.0))
            steps = checkpoint(
                sums.select(
                    "_of", F.abs(F.col("_target") - F.col("_got")).alias("_gap"),
                    F.when(F.col("_curve") > 0, full).otherwise(back).alias("_step"),
                )
            )
            worst = max(worst, steps.agg(F.max("_gap")).first()[0] or 0.0)
            state = state.join(steps, state[c].eqNullSafe(steps["_of"]), "left")
            eta = F.col("eta") + F.coalesce(F.col("_step"), F.lit(0.0))
            state = checkpoint(state.select(*names, "mass", eta.alias("eta")))
        if worst <= tolerance * mass:
            break
    return state.select(*names, "mass", rate.alias("rate"))


def rounded(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (source, size, rate, target, _tie, _row) with whole ``copies``, floor or ceiling of the rate.

    Systematic rounding: documents of a source in order of size; one more copy each time the
    running sum of fractions passes a whole number. What a source is then short of (or over) its
    target goes to (or comes from) its smallest documents, up to half the size of the last one.
    """
    part = F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long")
    rows = rows.withColumn("_part", part)
    order = [F.col("size").desc(), "_tie", "_row"]
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(UNIT))
    summed = Ordered(rows, ["source"], order).add(_sum=running_sum(F.col("_part"))).result()
    to = F.floor((F.col("_sum") + offset) / UNIT)
    since = F.floor((F.col("_sum") - F.col("_part") + offset) / UNIT)
    summed = checkpoint(summed.withColumn("_more", (to - since).cast("long")).drop("_sum"))
    copies = F.floor("rate").cast("long") + F.col("_more")
    gap = summed.groupBy("source").agg(
        (F.first("target") - F.sum(copies * F.col("size"))).alias("_gap")
    ).withColumnRenamed("source", "_source")
    with_gap = summed.join(gap, summed["source"].eqNullSafe(gap["_source"]), "left").drop("_source")
    movable = (F.col("size") > 0) & F.when(
        F.col("_gap") > 0, (F.col("_more") == 0) & (F.col("_part") > 0)
    ).otherwise(F.col("_more") == 1)
    with_gap = with_gap.withColumn("_moves", F.when(movable, F.col("size")).otherwise(F.lit(0).cast("long")))
    last = Ordered(with_gap, ["source"], ["size", "_tie", "_row"]).add(_upto=running_sum(F.col("_moves")))
    change = F.when(
        (F.col("_moves") > 0) & (F.col("_upto") - F.col("_moves") / 2 <= F.abs("_gap")),
        F.when(F.col("_gap") > 0, F.lit(1)).otherwise(F.lit(-1)),
    ).otherwise(F.lit(0)).cast("long")
    kept = [c for c in rows.columns if c != "_part"]
    return last.result().select(*kept, (copies + change).alias("copies"))


def mixed(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = MAX_RATE, seed: int = 0,
    key: str = "doc_id", source: str = "source", size: Column | None = None, row: str | None = None,
) -> DataFrame:
    """(key, size, source, source_size, target, copies) of every row, and its ``row`` if given.

    ``row`` is a column of row numbers, which tell rows apart that share a key.

    Size is the number of words unless a column is given. A null source is a source of its own; a
    null or empty text has size 0, rate and copies as its source. Rows that repeat count one each.
    An empty table gives an empty result. The outcome depends on keys and sizes, not on partitions.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.col(source).cast("string").alias("source"),
        (count_words() if size is None else size.cast("long")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("_tie"),
        *([] if row is None else [F.col(row).alias("_row")]),
    )
    if row is None:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = checkpoint(rows)
    per = rows.groupBy("source").agg(F.sum("size").alias("mass"))
    goal = checkpoint(shares(per, weights, max_rate))
    rates = balanced(goal.select("source", "mass"), [("source", goal.select("source", "target"))], max_rate)
    rates = rates.select(F.col("source").alias("_s"), F.round("rate", 9).alias("rate"))
    goal = goal.join(rates, goal["source"].eqNullSafe(rates["_s"])).select(
        F.col("source").alias("_s"), F.col("mass").alias("source_size"), "target", "rate"
    )
    rows = rows.join(checkpoint(goal), rows["source"].eqNullSafe(F.col("_s"))).drop("_s")
    out = rounded(rows, seed)
    number = [] if row is None else [F.col("_row").alias(row)]
    return out.select(F.col("_key").alias(key), "size", "source", "source_size", "target", "copies", *number)
