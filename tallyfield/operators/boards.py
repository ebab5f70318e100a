"""Leaderboards from run logs and evaluations.

Long form: one row per (group, row, metric) with ``value``; a row of the board has a label, a
position, a kind (``static`` or ``ours``) and perhaps a reason to train it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.ordered import (
    MAX_GROUP_ROWS,
    Ordered,
    carried,
    min_before,
    previous,
    row_number,
)
from tallyfield.operators.quantiles import no_nan
from tallyfield.operators.sequences import pick_even

HIGHER_IS_BETTER = ("map",)  # fixed value
PLACEMENT = ("abs_mpjpe", "transl_err_m", "map")  # fixed value: metrics that need a position
BOARD_METRICS = ("mpjpe", "pa_mpjpe", "pve", "abs_mpjpe", "transl_err_m", "map")  # fixed value
LOG_RENAMES = {"transl_err": "transl_err_m"}  # fixed value: log name -> board name


def _finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))


def _higher(metric: Column) -> Column:
    return F.element_at(F.split(metric, "_"), -1).isin(list(HIGHER_IS_BETTER))


def explode_log(df: DataFrame, line: str = "line") -> DataFrame:
    """Sparse log lines as (run, step, split, metric, value): the keys ``val/<split>/<metric>``.

    Lines that are no JSON object give no rows.
    """
    row = F.from_json(line, "map<string,double>")
    d = df.withColumn("_m", row).where(F.col("_m").isNotNull())
    d = d.withColumn("step", F.try_element_at("_m", F.lit("step")).cast("long"))
    keep = [c for c in df.columns if c != line]
    d = d.select(*keep, "step", F.explode("_m").alias("_k", "value"))
    part = F.split("_k", "/")
    d = d.where(F.col("_k").startswith("val/") & (F.size(part) == 3) & F.col("value").isNotNull())
    name = part[2]
    for old, new in LOG_RENAMES.items():
        name = F.when(name == old, new).otherwise(name)
    return d.select(*keep, "step", part[1].alias("split"), name.alias("metric"), "value")


def to_wide(
    df: DataFrame, by: Sequence[str], splits: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """One row per run with a column ``<split>_<metric>`` for every listed pair, NULL if absent."""
    cells = [
        F.max(
            F.when((F.col("split") == s) & (F.col("metric") == m), F.col("value"))
        ).alias(f"{s}_{m}")
        for s in splits
        for m in metrics
    ]
    return df.groupBy(*by).agg(*cells)


def to_long(
    df: DataFrame, by: Sequence[str], splits: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """The wide table as (by, split, metric, value); NULL cells give no rows."""
    cells = F.array(
        *[
            F.struct(
                F.lit(s).alias("split"), F.lit(m).alias("metric"), F.col(f"{s}_{m}").alias("value")
            )
            for s in splits
            for m in metrics
        ]
    )
    d = df.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")
    return d.where(F.col("value").isNotNull())


def load_runs(evals: DataFrame, logs: DataFrame, done: DataFrame) -> DataFrame:
    """Values per run: its full evaluation if there is one, else its last logged validation row.

    ``evals`` and ``logs`` are (run, step, split, metric, value); ``done`` lists finished runs.
    Old log rows without the absolute error carry a placement error that is not comparable: it
    is blanked. Adds ``note``.
    """
    last = logs.groupBy("run").agg(F.max("step").alias("step"))
    row = logs.join(last, ["run", "step"])
    flags = row.groupBy("run", "split").agg(
        F.max((F.col("metric") == "abs_mpjpe").cast("int")).alias("_abs")
    )
    row = row.join(flags, ["run", "split"])
    old = (F.col("metric") == "transl_err_m") & (F.col("_abs") == 0)
    row = row.withColumn("value", F.when(~old, F.col("value"))).drop("_abs")
    fallback = row.join(evals.select("run").distinct(), "run", "left_anti")
    both = evals.withColumn("_full", F.lit(True)).unionByName(fallback.withColumn("_full", F.lit(False)))
    finished = done.select("run", F.lit(True).alias("_done")).distinct()
    d = both.join(finished, "run", "left")
    final = F.col("_done").isNotNull()
    k = F.floor(F.col("step") / 1000).cast("string")
    state = (
        F.when(F.col("_full") & final, F.concat(F.lit("final step "), k))
        .when(F.col("_full"), F.concat(F.lit("running, full-set eval at step "), k))
        .when(final, F.concat(F.lit("final, step "), k))
        .otherwise(F.concat(F.lit("running, step "), k))
    )
    return d.select("run", "step", "split", "metric", "value", F.concat(state, F.lit("k")).alias("note"))


def fill_from_siblings(df: DataFrame, primary: str, by: Sequence[str] = ("method", "split")):
    """For each method and split the rows of the first file that has them, primary file first."""
    order = F.struct((F.col("file") != primary).alias("p"), F.col("file").alias("f"))
    best = df.groupBy(*by).agg(F.min(order).alias("_b"))
    d = df.join(best, list(by))
    return d.where(F.col("file") == F.col("_b.f")).drop("_b")


def blank(df: DataFrame, methods: Sequence[str], metrics: Sequence[str] = PLACEMENT) -> DataFrame:
    """Listed metrics of listed methods set to NULL (their depth is not metric)."""
    gone = F.col("method").isin(list(methods)) & F.col("metric").isin(list(metrics))
    return df.withColumn("value", F.when(~gone, F.col("value")))


def seed_mean(df: DataFrame, spec: DataFrame, pending: bool = True) -> DataFrame:
    """Board rows from runs: mean over the seeds of a row that have a value.

    ``spec`` is (label, run), ``df`` is (run, metric, value, note). Rows without any result are
    shown as ``queued`` when ``pending``, else left out. The note says how many seeds count.
    """
    planned = spec.groupBy("label").agg(F.countDistinct("run").alias("_planned"))
    d = spec.join(df, "run")
    found = d.groupBy("label").agg(
        F.countDistinct("run").alias("_found"),
        F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("_notes"),
    )
    text = F.concat(
        F.when(F.col("_found") > 1, F.format_string("mean of %d seeds; ", "_found")).otherwise(""),
        F.col("_notes"),
        F.when(
            F.col("_found") < F.col("_planned"),
            F.format_string(" (%d seed pending)", F.col("_planned") - F.col("_found")),
        ).otherwise(""),
    )
    rows = planned.join(found, "label", "left" if pending else "inner").select(
        "label", F.when(F.col("_found").isNull(), "queued").otherwise(text).alias("note")
    )
    means = d.groupBy("label", "metric").agg(F.avg(no_nan(F.col("value"))).alias("value"))
    return rows.join(means, "label", "left")


def annotate(rows: DataFrame, notes: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The first note of a row over its ordered list of keys; NULL without one."""
    hit = rows.select("label", key, order).join(notes.select(key, text), key)
    first = hit.groupBy("label").agg(F.min_by(F.col(text), F.col(order)).alias(text))
    return rows.select("label").distinct().join(first, "label", "left")


def rank_columns(df: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """Ranks 0.. of the best ``k`` rows per column; equal values by position.

    Rows to be trained again and values that are not finite are left out.
    """
    v = F.col("value")
    ok = df.where(_finite(v) & F.col("retrain").isNull())
    key = F.when(_higher(F.col("metric")), -v).otherwise(v)
    w = Window.partitionBy(*by, "metric").orderBy("_k", "pos")
    d = ok.withColumn("_k", key).withColumn("_rn", F.row_number().over(w))
    return d.where(F.col("_rn") <= k).withColumn("rank", F.col("_rn") - 1).drop("_rn", "_k")


def beats_static(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Our rows that are strictly better than every compared row of their column."""
    v = F.when(_finite(F.col("value")), F.col("value"))
    static = F.when(F.col("kind") == "static", v)
    bars = df.groupBy(*by, "metric").agg(F.min(static).alias("_lo"), F.max(static).alias("_hi"))
    d = df.where((F.col("kind") == "ours") & v.isNotNull()).join(bars, [*by, "metric"])
    better = F.when(_higher(F.col("metric")), v > F.col("_hi")).otherwise(v < F.col("_lo"))
    return d.where(better).drop("_lo", "_hi")


def scoreboard(
    evals: DataFrame,
    logs: DataFrame,
    done: DataFrame,
    spec: DataFrame,
    static: DataFrame,
    primary: str,
    splits: Sequence[str],
    blanked: Sequence = (),
) -> DataFrame:
    """The whole board, from run results to ranks: (label, split, metric, value, note, kind, rank, beats).

    ``spec`` is (label, run, pos, retrain), the planned rows; see ``load_runs`` for the results.
    ``static`` is (method, split, file, metric, value, pos), compared rows, filled from sibling files
    of ``primary``. Placement of ``blanked`` runs is left out. ``rank`` is NULL beyond the best three,
    ``beats`` marks our rows that are better than every static one of their column. Planned rows
    without a result have the note ``queued`` and neither metric nor value.
    """
    runs = load_runs(evals, logs, done).withColumnRenamed("run", "method")
    runs = blank(runs, blanked).withColumnRenamed("method", "run")
    plan = spec.select("label", "run").distinct()
    ours = None
    for s in splits:
        part = seed_mean(runs.where(F.col("split") == s), plan).withColumn("split", F.lit(s))
        ours = part if ours is None else ours.unionByName(part)
    about = spec.groupBy("label").agg(F.min("pos").alias("pos"), F.min("retrain").alias("retrain"))
    ours = ours.join(about, "label").withColumn("kind", F.lit("ours"))
    others = fill_from_siblings(static.where(F.col("split").isin(list(splits))), primary)
    others = others.select(
        F.col("method").alias("label"), F.col("file").alias("note"), "metric", "value", "split", "pos",
        F.lit(None).cast("string").alias("retrain"), F.lit("static").alias("kind"),
    )
    rows = ours.unionByName(others)
    at = ["label", "split", "metric", "kind"]
    ranked = rank_columns(rows, ["split"]).select(*at, "rank")
    better = beats_static(rows, ["split"]).select(*at, F.lit(True).alias("beats"))
    out = rows.join(ranked, at, "left").join(better, at, "left")
    return out.select(
        "label", "split", "metric", "value", "note", "kind", "rank", F.coalesce("beats", F.lit(False)).alias("beats")
    )


def trend(df: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """Latest evaluation of a series and its change against the one before, in percent.

    Only the two latest rows of a series meet: an aggregate finds the last step, another the
    last step before it.
    """
    at = F.struct(step, value)
    last = df.groupBy(*by).agg(F.max(at).alias("_l"))
    before = df.join(last, list(by)).where(F.col(step) < F.col(f"_l.{step}"))
    prev = before.groupBy(*by).agg(F.max(at).alias("_p"))
    d = last.join(prev, list(by), "left")
    now, then = F.col(f"_l.{value}"), F.col(f"_p.{value}")
    return d.select(
        *by,
        F.col(f"_l.{step}").alias(step),
        now.alias(value),
        F.when(then != 0, (now - then) / then * 100).alias("change_pct"),
    )


def mean_score(df: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """Mean over the finite sources of one evaluation (infinite when there is none)."""
    v = F.when(_finite(F.col(value)), F.col(value))
    return df.groupBy(*by, step).agg(F.coalesce(F.avg(v), F.lit(float("inf"))).alias("score"))


def best_so_far(
    scores: DataFrame, by: Sequence[str], step: str, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Adds ``is_best``: the evaluation beats every earlier one of its run."""
    d = Ordered(scores, by, [step], limit).add(_b=min_before(F.col("score"))).result()
    better = F.col("score") < F.coalesce(F.col("_b"), F.lit(float("inf")))
    return d.withColumn("is_best", better).drop("_b")


def patience(
    df: DataFrame,
    by: Sequence[str],
    step: str,
    source: str,
    value: str,
    n: int,
    min_steps: int = 0,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per evaluation: whether any source improved its own best, evaluations since, and stop.

    ``stop`` is set from ``min_steps`` on when ``n`` evaluations in a row brought nothing.
    """
    v = F.when(_finite(F.col(value)), F.col(value))
    d = Ordered(df.select(*by, step, source, v.alias("_v")), [*by, source], [step], limit)
    d = d.add(_b=min_before(F.col("_v"))).result()
    hit = F.coalesce(F.col("_v") < F.coalesce(F.col("_b"), F.lit(float("inf"))), F.lit(False))
    evals = d.groupBy(*by, step).agg(F.bool_or(hit).alias("improved"))
    e = Ordered(evals, by, [step], limit).add(_rn=row_number())
    e = e.add(_at=carried(F.when(F.col("improved"), F.col("_rn")))).result()
    e = e.withColumn("since", F.col("_rn") - F.coalesce(F.col("_at"), F.lit(0)))
    stop = (F.lit(n) > 0) & (F.col(step) >= min_steps) & (F.col("since") >= n)
    return e.withColumn("stop", stop).drop("_rn", "_at")


def downsample(
    df: DataFrame, by: Sequence[str], order: str, n: int = 40, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """At most ``n`` points of each series: n - 1 even ones and the last."""
    return pick_even(df, n, by, [order], "series", limit)


def pick_records(
    df: DataFrame, ours: str, image_methods: Sequence[str], cloud_method: str, key: str = "key"
) -> DataFrame:
    """Records that tell a story: (story, key, margin); equal margins go to the smaller key.

    ``placement``: image methods misplace what we place; ``pose``: largest lead over the point
    method; ``far``: the farthest record still good.
    """
    from tallyfield.operators.matching import side_by_side

    names = [ours, *image_methods, cloud_method]
    w = side_by_side(df, key, names, ["mpjpe", "transl_err_m", "gt_depth_m"])
    mp, tr, z = (F.col(f"{ours}_{c}") for c in ("mpjpe", "transl_err_m", "gt_depth_m"))
    others = F.array_min(F.array(*[F.col(f"{m}_transl_err_m") for m in image_methods]))
    place = F.when((mp < 90) & (tr < 0.25), others - tr)
    pose = F.when(mp <= 60, F.col(f"{cloud_method}_mpjpe") - mp)
    far = F.when((tr < 0.3) & (mp < 90), z)

    def best(value: Column, floor: float) -> Column:
        ok = F.when(value > floor, F.struct((-value).alias("m"), F.col(key).alias("k")))
        return F.min(ok)

    top = w.agg(best(place, -1.0).alias("placement"), best(pose, -1.0).alias("pose"), best(far, float("-inf")).alias("far"))
    stories = F.array(
        *[
            F.struct(F.lit(s).alias("story"), F.col(f"{s}.k").alias("key"), (-F.col(f"{s}.m")).alias("margin"))
            for s in ("placement", "pose", "far")
        ]
    )
    return top.select(F.explode(stories).alias("s")).select("s.*").where(F.col("key").isNotNull())


def to_page_json(
    values: DataFrame, curves: DataFrame, by: str = "run", n: int = 40, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """One JSON document per board row: its values and its thinned curves.

    A series has at most ``n`` points and a row a fixed set of series, so a document is small
    however long a run logs; the page reads one line per row.
    """
    cell = F.struct("metric", F.round("value", 3).alias("value"))
    vals = values.where(_finite(F.col("value"))).groupBy(by).agg(
        F.array_sort(F.collect_list(cell)).alias("v")
    )
    thin = downsample(curves, [by, "metric"], "step", n, limit)
    point = F.struct("step", F.round("value", 4).alias("value"))
    series = thin.groupBy(by, "metric").agg(F.array_sort(F.collect_list(point)).alias("points"))
    per = series.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("metric", "points"))).alias("c"))
    d = vals.join(per, by, "full")
    return d.select(
        by, F.to_json(F.struct(F.col(by), F.col("v").alias("values"), F.col("c").alias("curves"))).alias("json")
    )


def distinct_status(df: DataFrame, line: str = "line", order: str = "pos") -> DataFrame:
    """Every distinct status line once, with the place it was first seen."""
    return df.groupBy(line).agg(F.min(order).alias(order))


def latest_per_run(df: DataFrame, by: str, step: str, values: Sequence[str]) -> DataFrame:
    """The values of the last step of every run."""
    return df.groupBy(by).agg(F.max(F.struct(step, *values)).alias("_l")).select(by, "_l.*")


def monotonic_step(
    df: DataFrame, by: str, order: str, step: str, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Steps that never go back: each row gets the largest step logged so far in its run."""
    from tallyfield.operators.ordered import running_max

    d = Ordered(df, [by], [order], limit).add(_s=running_max(F.col(step))).result()
    return d.withColumn(step, F.col("_s")).drop("_s")


def open_runs(logs: DataFrame, done: DataFrame, by: str = "run") -> DataFrame:
    """Log rows of runs that are not closed."""
    return logs.join(done.select(by), by, "left_anti")


def perf_windows(df: DataFrame, by: str, step: str, seconds: str, batch: int, memory: str, every: int = 50):
    """Seconds per step, samples per second and peak memory over windows of ``every`` steps."""
    window = F.floor((F.col(step) - 1) / every).alias("window")
    d = df.groupBy(by, window).agg(
        F.max(step).alias("last_step"),
        F.avg(seconds).alias("step_s"),
        F.max(memory).alias("peak_mem"),
    )
    return d.withColumn("samples_per_s", F.lit(float(batch)) / F.greatest("step_s", F.lit(1e-9)))


def stale(df: DataFrame, by: str, time: str, now: Column, hours: float = 6.0) -> DataFrame:
    """Groups whose newest entry is older than the limit."""
    last = df.groupBy(by).agg(F.max(time).alias("last_seen"))
    return last.where(F.col("last_seen") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(hours * 60))))
