"""Leaderboard and run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import text as X
from tallyfield.operators import boards as D
from tallyfield.operators import sequences as S
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query
from tallyfield.sources.tables import rate


def _r(col, n=4):
    return F.round(col, n)


def _long(spark, sf):
    """(run, step, split, metric, value) from the log rows."""
    m = fx.metrics(spark, sf).where(~F.col("missing"))
    cells = F.array(
        F.struct(F.lit("mpjpe").alias("metric"), F.col("mpjpe").alias("value")),
        F.struct(F.lit("transl_err_m").alias("metric"), F.col("transl_err").alias("value")),
        F.struct(
            F.lit("map").alias("metric"),
            F.when(F.col("step") % 3 == 0, F.lit(1.0) / (1 + F.col("mpjpe"))).alias("value"),
        ),
    )
    d = m.select("run", "step", "split", F.explode(cells).alias("c")).select("run", "step", "split", "c.*")
    return d.where(F.col("value").isNotNull())


_LONG = """lg AS (SELECT run, step, split, 'mpjpe' AS metric, mpjpe AS value FROM fx_metrics WHERE NOT missing
 UNION ALL SELECT run, step, split, 'transl_err_m', transl_err FROM fx_metrics WHERE NOT missing
 UNION ALL SELECT run, step, split, 'map', 1.0/(1+mpjpe) FROM fx_metrics WHERE NOT missing AND step % 3 = 0),
av AS (SELECT run, split, metric, avg(value) AS value FROM lg GROUP BY ALL)"""


def _means(spark, sf):
    return _long(spark, sf).groupBy("run", "split", "metric").agg(F.avg("value").alias("value"))


@query(
    "log_lines_exploded",
    """SELECT run, split, metric, count(*) AS n, round(sum(value), 4) AS total FROM lg WHERE metric <> 'map' GROUP BY ALL""",
    views=("fx_metrics",),
    ctes=_LONG,
)
def log_lines_exploded(spark, sf):
    m = fx.metrics(spark, sf)
    both = F.map_from_arrays(
        F.array(
            F.lit("step"), F.concat(F.lit("val/"), "split", F.lit("/mpjpe")),
            F.concat(F.lit("val/"), "split", F.lit("/transl_err")),
        ),
        F.array(F.col("step").cast("double"), F.col("mpjpe"), F.col("transl_err")),
    )
    only = F.create_map(F.lit("step"), F.col("step").cast("double"), F.lit("train/loss"), F.col("mpjpe"))
    lines = m.select("run", F.to_json(F.when(F.col("missing"), only).otherwise(both)).alias("line"))
    d = D.explode_log(lines)
    return d.groupBy("run", "split", "metric").agg(
        F.count(F.lit(1)).alias("n"), _r(F.sum("value")).alias("total")
    )


@query(
    "board_wide",
    """SELECT run, round(max(value) FILTER (split = 'view' AND metric = 'mpjpe'), 4) AS view_mpjpe,
  round(max(value) FILTER (split = 'view' AND metric = 'pve'), 4) AS view_pve,
  round(max(value) FILTER (split = 'error' AND metric = 'map'), 4) AS error_map FROM av GROUP BY run""",
    views=("fx_metrics",),
    ctes=_LONG,
)
def board_wide(spark, sf):
    w = D.to_wide(_means(spark, sf), ["run"], ["view", "error"], D.BOARD_METRICS)
    return w.select("run", *[_r(c).alias(c) for c in ("view_mpjpe", "view_pve", "error_map")])


@query(
    "board_long",
    "SELECT run, split, metric, round(value, 4) AS value FROM av WHERE split IN ('view', 'error')",
    views=("fx_metrics",),
    ctes=_LONG,
)
def board_long(spark, sf):
    splits = ["view", "error"]
    w = D.to_wide(_means(spark, sf), ["run"], splits, D.BOARD_METRICS)
    d = D.to_long(w, ["run"], splits, D.BOARD_METRICS)
    return d.select("run", "split", "metric", _r("value").alias("value"))


def _rows(spark, sf):
    m = _means(spark, sf)
    return m.select(
        F.col("split").alias("grp"),
        F.col("run").alias("pos"),
        "metric",
        "value",
        F.when(F.col("run") % 4 == 0, "static").otherwise("ours").alias("kind"),
        F.when(F.col("run") == 5, "bad data").alias("retrain"),
    )


@query(
    "column_ranks",
    """SELECT grp, metric, pos, rank FROM (SELECT split AS grp, metric, run AS pos, row_number() OVER (PARTITION BY split, metric
  ORDER BY CASE WHEN metric = 'map' THEN -value ELSE value END, run) - 1 AS rank FROM av WHERE run <> 5) WHERE rank < 3""",
    views=("fx_metrics",),
    ctes=_LONG,
)
def column_ranks(spark, sf):
    d = D.rank_columns(_rows(spark, sf), ["grp"])
    return d.select("grp", "metric", "pos", F.col("rank").cast("long").alias("rank"))


@query(
    "rows_beating_static",
    """SELECT a.split AS grp, a.metric, a.run AS pos FROM av a JOIN (SELECT split, metric, min(value) lo, max(value) hi FROM av WHERE run % 4 = 0
  GROUP BY ALL) b USING (split, metric) WHERE a.run % 4 <> 0 AND CASE WHEN metric = 'map' THEN a.value > hi ELSE a.value < lo END""",
    views=("fx_metrics",),
    ctes=_LONG,
)
def rows_beating_static(spark, sf):
    return D.beats_static(_rows(spark, sf), ["grp"]).select("grp", "metric", "pos")


@query(
    "runs_loaded",
    """SELECT run, split, metric, round(value, 4) AS value, note FROM (
 SELECT run, 'all' AS split, metric, avg(value) AS value, CASE WHEN run % 3 = 0 THEN 'final step 12k' ELSE 'running, full-set eval at step 12k' END AS note
 FROM av WHERE run % 2 = 0 GROUP BY run, metric
 UNION ALL SELECT run, split, metric, CASE WHEN metric <> 'transl_err_m' THEN value END, CASE WHEN run % 3 = 0 THEN 'final, step ' ELSE 'running, step ' END || (step // 1000) || 'k'
 FROM lg WHERE run % 2 = 1 AND (run, step) IN (SELECT run, max(step) FROM lg GROUP BY run))""",
    views=("fx_metrics",),
    ctes=_LONG,
)
def runs_loaded(spark, sf):
    means = _means(spark, sf).where("run % 2 = 0").groupBy("run", "metric").agg(F.avg("value").alias("value"))
    evals = means.select("run", F.lit(12000).cast("long").alias("step"), F.lit("all").alias("split"), "metric", "value")
    done = fx.metrics(spark, sf).where("run % 3 = 0").select("run")
    d = D.load_runs(evals, _long(spark, sf), done)
    return d.select("run", "split", "metric", _r("value").alias("value"), "note")


@query(
    "siblings_filled",
    """SELECT method, split, file, n FROM (SELECT run AS method, split, 'f' || f AS file, count(*) AS n,
  row_number() OVER (PARTITION BY run, split ORDER BY f <> 2, f) AS rn FROM (SELECT *, (run + step // 4000) % 4 AS f FROM fx_metrics) GROUP BY run, split, f) WHERE rn = 1""",
    views=("fx_metrics",),
)
def siblings_filled(spark, sf):
    f = (F.col("run") + F.floor(F.col("step") / 4000)) % 4
    d = fx.metrics(spark, sf).select(
        F.col("run").alias("method"), "split", F.concat(F.lit("f"), f.cast("string")).alias("file")
    )
    out = D.fill_from_siblings(d, "f2")
    return out.groupBy("method", "split", "file").agg(F.count(F.lit(1)).alias("n"))


@query(
    "placement_blanked",
    """SELECT run AS method, split, metric, CASE WHEN NOT (run IN (3, 7) AND metric IN ('map', 'transl_err_m')) THEN round(value, 4) END AS value FROM av""",
    views=("fx_metrics",),
    ctes=_LONG,
)
def placement_blanked(spark, sf):
    d = D.blank(_means(spark, sf).withColumnRenamed("run", "method"), [3, 7])
    return d.select("method", "split", "metric", _r("value").alias("value"))


@query(
    "seeds_averaged",
    """SELECT p.label, CASE WHEN f.found IS NULL THEN 'queued' ELSE CASE WHEN found > 1 THEN 'mean of ' || found || ' seeds; ' ELSE '' END || notes
   || CASE WHEN found < planned THEN ' (' || (planned - found) || ' seed pending)' ELSE '' END END AS note, metric, round(value, 4) AS value
 FROM (SELECT label, count(DISTINCT run) AS planned FROM spec GROUP BY label) p
 LEFT JOIN (SELECT label, count(DISTINCT run) AS found, string_agg(DISTINCT 'final ' || split, '; ' ORDER BY 'final ' || split) AS notes FROM spec JOIN av USING (run) GROUP BY label) f USING (label)
 LEFT JOIN (SELECT label, metric, avg(value) AS value FROM spec JOIN av USING (run) GROUP BY ALL) v USING (label)""",
    views=("fx_metrics",),
    ctes=_LONG + """, spec AS (SELECT DISTINCT 'row' || (n_nationkey // 3) AS label, n_nationkey AS run FROM nation)""",
)
def seeds_averaged(spark, sf):
    n = fx.table(spark, sf, "nation")
    spec = n.select(
        F.concat(F.lit("row"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("label"),
        F.col("n_nationkey").cast("long").alias("run"),
    ).distinct()
    d = _means(spark, sf).withColumn("note", F.concat(F.lit("final "), "split"))
    out = D.seed_mean(d, spec)
    return out.select("label", "note", "metric", _r("value").alias("value"))


_BOARD = _LONG + """, ld AS (SELECT run, split, metric, value, CASE WHEN run % 3 = 0 THEN 'final step 12k' ELSE 'running, full-set eval at step 12k' END AS note
  FROM av WHERE run % 2 = 0
 UNION ALL SELECT run, split, metric, CASE WHEN metric <> 'transl_err_m' THEN value END, CASE WHEN run % 3 = 0 THEN 'final, step ' ELSE 'running, step ' END || (step // 1000) || 'k'
  FROM lg WHERE run % 2 = 1 AND (run, step) IN (SELECT run, max(step) FROM lg GROUP BY run)),
bl AS (SELECT run, split, metric, CASE WHEN NOT (run = 4 AND metric IN ('map', 'transl_err_m')) THEN value END AS value, note FROM ld WHERE split IN ('view', 'error')),
spec AS (SELECT DISTINCT 'row' || (n_nationkey // 3) AS label, n_nationkey AS run, n_nationkey // 3 AS pos FROM nation),
plan AS (SELECT label, min(pos) AS pos, count(DISTINCT run) AS planned FROM spec GROUP BY label),
sp AS (SELECT * FROM (VALUES ('view'), ('error')) AS t(split)),
found AS (SELECT label, split, count(DISTINCT run) AS found, string_agg(DISTINCT note, '; ' ORDER BY note) AS notes FROM spec JOIN bl USING (run) GROUP BY ALL),
mean AS (SELECT label, split, metric, avg(value) AS value FROM spec JOIN bl USING (run) GROUP BY ALL),
ours AS (SELECT p.label, sp.split, m.metric, m.value, CASE WHEN f.found IS NULL THEN 'queued' ELSE CASE WHEN found > 1 THEN 'mean of ' || found || ' seeds; ' ELSE '' END || notes
   || CASE WHEN found < planned THEN ' (' || (planned - found) || ' seed pending)' ELSE '' END END AS note, 'ours' AS kind, pos, p.label = 'row1' AS again
 FROM plan p CROSS JOIN sp LEFT JOIN found f ON f.label = p.label AND f.split = sp.split LEFT JOIN mean m ON m.label = p.label AND m.split = sp.split),
st AS (SELECT *, dense_rank() OVER (PARTITION BY run, split ORDER BY f <> 2, f) AS nth FROM
 (SELECT run, split, (run + step // 4000) % 4 AS f, avg(mpjpe) AS value FROM fx_metrics WHERE NOT missing AND run % 4 = 0 AND split IN ('view', 'error') GROUP BY ALL)),
board AS (SELECT * FROM ours UNION ALL
 SELECT 's' || run, split, 'mpjpe', value, 'f' || f, 'static', 100 + run, false FROM st WHERE nth = 1),
ranks AS (SELECT label, split, metric, kind, row_number() OVER (PARTITION BY split, metric ORDER BY CASE WHEN metric = 'map' THEN -value ELSE value END, pos) - 1 AS rank
 FROM board WHERE value IS NOT NULL AND NOT again),
bars AS (SELECT split, metric, min(value) AS lo FROM board WHERE kind = 'static' GROUP BY ALL)"""


@query(
    "scoreboard",
    """SELECT b.label, b.split, b.metric, round(b.value, 4) AS value, b.note, b.kind, CASE WHEN r.rank < 3 THEN r.rank END AS rank,
  coalesce(b.kind = 'ours' AND b.value < bars.lo, false) AS beats
 FROM board b LEFT JOIN ranks r USING (label, split, metric, kind) LEFT JOIN bars USING (split, metric)""",
    views=("fx_metrics",),
    ctes=_BOARD,
)
def scoreboard(spark, sf):
    means = _means(spark, sf).where("run % 2 = 0")
    evals = means.select("run", F.lit(12000).cast("long").alias("step"), "split", "metric", "value")
    done = fx.metrics(spark, sf).where("run % 3 = 0").select("run")
    pos = F.floor(F.col("n_nationkey") / 3)
    spec = fx.table(spark, sf, "nation").select(
        F.concat(F.lit("row"), pos.cast("string")).alias("label"), F.col("n_nationkey").cast("long").alias("run"),
        pos.alias("pos"), F.when(pos == 1, "again").alias("retrain"),
    )
    m = fx.metrics(spark, sf).where("not missing and run % 4 = 0")
    f = (F.col("run") + F.floor(F.col("step") / 4000)) % 4
    m = m.select("run", "split", F.concat(F.lit("f"), f.cast("string")).alias("file"), "mpjpe")
    m = m.groupBy("run", "split", "file").agg(F.avg("mpjpe").alias("value"))
    static = m.select(
        F.concat(F.lit("s"), F.col("run").cast("string")).alias("method"), "split", "file", F.lit("mpjpe").alias("metric"),
        "value", (F.col("run") + 100).alias("pos"),
    )
    b = D.scoreboard(evals, _long(spark, sf), done, spec, static, "f2", ["view", "error"], [4])
    return b.select("label", "split", "metric", _r("value").alias("value"), "note", "kind", F.col("rank").cast("long").alias("rank"), "beats")


@query(
    "rows_annotated",
    """SELECT 'row' || (n_nationkey // 3) AS label, arg_min(r_name, n_nationkey) FILTER (r_regionkey IN (1, 3)) AS reason FROM nation
 JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def rows_annotated(spark, sf):
    n = fx.table(spark, sf, "nation")
    rows = n.select(
        F.concat(F.lit("row"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("label"),
        F.col("n_regionkey").alias("run"),
        F.col("n_nationkey").alias("pos"),
    )
    notes = fx.table(spark, sf, "region").where("r_regionkey IN (1, 3)")
    notes = notes.select(F.col("r_regionkey").alias("run"), F.col("r_name").alias("reason"))
    return D.annotate(rows, notes, "run", "reason", "pos")


@query(
    "pending_rows",
    """SELECT CAST(n_nationkey AS BIGINT) AS run, CASE WHEN m.run IS NULL THEN 'queued' ELSE 'has results' END AS state FROM nation
 LEFT JOIN (SELECT DISTINCT run FROM fx_metrics) m ON m.run = n_nationkey""",
    views=("fx_metrics",),
)
def pending_rows(spark, sf):
    n = fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("run"))
    spec = n.withColumn("label", F.col("run").cast("string"))
    have = fx.metrics(spark, sf).select("run").distinct()
    d = D.seed_mean(
        have.select("run", F.lit("m").alias("metric"), F.lit(1.0).alias("value"), F.lit("has results").alias("note")), spec
    )
    return d.select(F.col("label").cast("long").alias("run"), F.col("note").alias("state"))


@query(
    "metric_trend",
    """SELECT run, split, step, mpjpe, round((mpjpe - p)/p*100, 4) AS change_pct FROM (SELECT run, split, step, mpjpe, lag(mpjpe) OVER w AS p,
  row_number() OVER (PARTITION BY run, split ORDER BY step DESC) AS rn FROM fx_metrics WINDOW w AS (PARTITION BY run, split ORDER BY step)) WHERE rn = 1""",
    views=("fx_metrics",),
)
def metric_trend(spark, sf):
    d = D.trend(fx.metrics(spark, sf), ["run", "split"], "step", "mpjpe")
    return d.select("run", "split", "step", "mpjpe", _r("change_pct").alias("change_pct"))


_EVALS = """ev AS (SELECT run, step // 200 AS eval, split, round(avg(mpjpe), 6) AS mpjpe FROM fx_metrics WHERE NOT missing GROUP BY ALL)"""


def _evals(spark, sf):
    m = fx.metrics(spark, sf).where(~F.col("missing"))
    return m.groupBy("run", F.floor(F.col("step") / 200).alias("eval"), "split").agg(
        F.round(F.avg("mpjpe"), 6).alias("mpjpe")
    )


@query(
    "best_checkpoints",
    """SELECT run, eval, round(score, 9) AS score, score < coalesce(min(score) OVER (PARTITION BY run ORDER BY eval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS is_best
 FROM (SELECT run, eval, avg(mpjpe) AS score FROM ev GROUP BY ALL)""",
    views=("fx_metrics",),
    ctes=_EVALS,
)
def best_checkpoints(spark, sf):
    s = D.mean_score(_evals(spark, sf), ["run"], "eval", "mpjpe")
    return D.best_so_far(s, ["run"], "eval").select("run", "eval", _r("score", 9).alias("score"), "is_best")


@query(
    "early_stops",
    """SELECT run, eval, improved, since, eval >= 10 AND since >= 3 AS stop FROM (SELECT run, eval, improved, rn - coalesce(max(CASE WHEN improved THEN rn END) OVER (PARTITION BY run ORDER BY eval), 0) AS since
 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval) AS rn FROM (SELECT run, eval, bool_or(mpjpe < coalesce(b, 1e300)) AS improved FROM (
  SELECT *, min(mpjpe) OVER (PARTITION BY run, split ORDER BY eval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev) GROUP BY ALL)))""",
    views=("fx_metrics",),
    ctes=_EVALS,
)
def early_stops(spark, sf):
    return D.patience(_evals(spark, sf), ["run"], "eval", "split", "mpjpe", 3, 10)


@query(
    "curves_thinned",
    """SELECT run, split, step FROM (SELECT run, split, step, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run, split) AS n FROM fx_metrics
 WINDOW w AS (PARTITION BY run, split ORDER BY step)) WHERE n <= 40 OR i = n - 1 OR i IN (SELECT CAST(floor(j * (n / 40.0E0)) AS BIGINT) FROM range(39) t(j))""",
    views=("fx_metrics",),
)
def curves_thinned(spark, sf):
    d = D.downsample(fx.metrics(spark, sf), ["run", "split"], "step")
    return d.select("run", "split", "step")


@query(
    "evaluation_heads",
    "SELECT run, step FROM (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM fx_metrics) WHERE rn <= 5",
    views=("fx_metrics",),
)
def evaluation_heads(spark, sf):
    return S.head(fx.metrics(spark, sf), 5, ["run"], ["step"]).select("run", "step")


@query(
    "even_picks",
    """SELECT run, step, 'floor' AS how FROM r WHERE i IN (SELECT (j * n) // 7 FROM range(7) t(j))
 UNION ALL SELECT run, step, 'ends' FROM r WHERE i IN (SELECT CAST(round_even(j * ((n - 1) / 6.0E0), 0) AS BIGINT) FROM range(7) t(j))""",
    views=("fx_metrics",),
    ctes="""r AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM fx_metrics)""",
)
def even_picks(spark, sf):
    m = fx.metrics(spark, sf).select("run", "step")
    a = S.pick_even(m, 7, ["run"], ["step"], "floor").withColumn("how", F.lit("floor"))
    b = S.pick_even(m, 7, ["run"], ["step"], "ends").withColumn("how", F.lit("ends"))
    return a.unionByName(b)


@query(
    "story_picks",
    """SELECT * FROM (SELECT 'placement' AS story, run AS key, round(least(c, d) - b, 6) AS margin FROM w WHERE a < 90 AND b < 0.25 AND least(c, d) - b > -1 ORDER BY least(c, d) - b DESC, run LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'pose', run, round(e - a, 6) FROM w WHERE a <= 60 AND e - a > -1 ORDER BY e - a DESC, run LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'far', run, round(z, 6) FROM w WHERE b < 0.3 AND a < 90 ORDER BY z DESC, run LIMIT 1)""",
    views=("fx_tracks",),
    ctes="""w AS (SELECT track AS run, max(value) FILTER (source = 'view') AS a, max(value / 500) FILTER (source = 'view') AS b, max(value / 500) FILTER (source = 'click') AS c,
  max(value / 500) FILTER (source = 'error') AS d, max(value) FILTER (source = 'signup') AS e, max(rec) FILTER (source = 'view') AS z FROM fx_tracks GROUP BY track)""",
)
def story_picks(spark, sf):
    t = fx.tracks(spark, sf)
    d = t.groupBy(F.col("track").alias("key"), F.col("source").alias("method")).agg(
        F.max("value").alias("mpjpe"),
        F.max(F.col("value") / 500).alias("transl_err_m"),
        F.max("rec").cast("double").alias("gt_depth_m"),
    )
    out = D.pick_records(d, "view", ["click", "error"], "signup")
    return out.select("story", "key", _r("margin", 6).alias("margin"))


@query(
    "page_documents",
    """SELECT run, count(DISTINCT split) AS series, sum(least(n, 40))::BIGINT AS points FROM (SELECT run, split, count(*) AS n FROM lg WHERE metric = 'mpjpe' GROUP BY ALL) GROUP BY run""",
    views=("fx_metrics",),
    ctes=_LONG,
)
def page_documents(spark, sf):
    curves = _long(spark, sf).where("metric = 'mpjpe'").select("run", F.col("split").alias("metric"), "step", "value")
    values = _means(spark, sf).select("run", F.concat_ws("_", "split", "metric").alias("metric"), "value")
    d = D.to_page_json(values, curves)
    schema = "struct<curves: array<struct<metric: string, points: array<struct<step: long, value: double>>>>>"
    doc = F.from_json("json", schema)
    n = F.aggregate(doc["curves"], F.lit(0).cast("long"), lambda s, c: s + F.size(c["points"]))
    return d.select("run", F.size(doc["curves"]).cast("long").alias("series"), n.alias("points"))


@query(
    "status_lines",
    "SELECT run || ' ' || split AS line, min(step) AS pos FROM fx_metrics GROUP BY 1",
    views=("fx_metrics",),
)
def status_lines(spark, sf):
    m = fx.metrics(spark, sf)
    d = m.select(F.concat_ws(" ", F.col("run").cast("string"), "split").alias("line"), F.col("step").alias("pos"))
    return D.distinct_status(d)


@query(
    "loader_rate",
    "SELECT run, round(count(*) / greatest(sum(mpjpe), 1e-9), 5) AS rate FROM fx_metrics GROUP BY run",
    views=("fx_metrics",),
)
def loader_rate(spark, sf):
    return fx.metrics(spark, sf).groupBy("run").agg(_r(rate(F.lit(1), F.col("mpjpe")), 5).alias("rate"))


@query(
    "readable_cells",
    """SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS BIGINT) || ' B' WHEN b/1024 < 1024 THEN CAST(round_even(b/1024, 0) AS BIGINT) || ' KB'
   ELSE CAST(round_even(b/1048576, 0) AS BIGINT) || ' MB' END AS size, CASE WHEN n_chars < 3600 THEN '~' || CAST(round_even(n_chars/60.0E0, 0) AS BIGINT) || ' min' ELSE printf('~%.1f h', n_chars/3600.0E0) END AS eta,
  printf('%.3f m', n_chars / 7.0E0) AS metric FROM (SELECT doc_id, n_chars, n_chars * 777.0E0 AS b FROM documents)""",
)
def readable_cells(spark, sf):
    n = F.col("n_chars")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        X.fmt_bytes(n * 777).alias("size"),
        X.fmt_eta(n).alias("eta"),
        X.fmt_metric(F.lit("a_transl_err_m"), n / 7.0).alias("metric"),
    )


@query(
    "run_names",
    """SELECT r.run, 'configs/' || replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r.run, '-[0-9][0-9][0-9]$', ''), '-s[0-9]$', ''), '^abl-', 'ablation-'), '^a-abl-', 'a-ablation-'), '-', '_') || '.yaml' AS config,
  (SELECT 'a-abl-mix-' || lpad(CAST(max(n_nationkey) FILTER (n_nationkey % 3 = 1) + 1 AS VARCHAR), 3, '0') FROM nation) AS next_name
 FROM (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'abl-x' WHEN 1 THEN 'a-abl-mix' ELSE 'b-ratio-s1' END || '-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS run FROM nation) r""",
)
def run_names(spark, sf):
    k = F.col("n_nationkey")
    base = F.when(k % 3 == 0, "abl-x").when(k % 3 == 1, "a-abl-mix").otherwise("b-ratio-s1")
    runs = fx.table(spark, sf, "nation").select(F.format_string("%s-%03d", base, k).alias("run"))
    nxt = X.next_run_name(runs, "a-abl-mix").withColumnRenamed("run", "next_name")
    return runs.select("run", X.config_of(F.col("run")).alias("config"), nxt.scalar().alias("next_name"))


@query(
    "genders",
    "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'neutral' ELSE 'other' END AS gender FROM nation",
)
def genders(spark, sf):
    k = F.col("n_nationkey")
    code = F.when(k % 4 == 0, "m").when(k % 4 == 1, "f").when(k % 4 == 2, "n").otherwise("other")
    return fx.table(spark, sf, "nation").select(k.alias("id"), X.gender(code).alias("gender"))


@query(
    "steps_monotonic",
    "SELECT run, step AS pos, max(step - (step % 7) * 40) OVER (PARTITION BY run ORDER BY step) AS step FROM fx_metrics",
    views=("fx_metrics",),
)
def steps_monotonic(spark, sf):
    m = fx.metrics(spark, sf).select("run", F.col("step").alias("pos"), (F.col("step") - F.col("step") % 7 * 40).alias("step"))
    return D.monotonic_step(m, "run", "pos", "step")


@query(
    "runs_still_open",
    "SELECT run, count(*) AS n FROM fx_metrics WHERE run % 3 <> 0 GROUP BY run",
    views=("fx_metrics",),
)
def runs_still_open(spark, sf):
    m = fx.metrics(spark, sf)
    done = m.where("run % 3 = 0").select("run").distinct()
    return D.open_runs(m, done).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query(
    "perf_windows",
    """SELECT run, floor((step - 1) / 50.0)::BIGINT AS "window", max(step) AS last_step, round(avg(mpjpe), 5) AS step_s, max(transl_err) AS peak_mem,
  round(2048 / greatest(avg(mpjpe), 1e-9), 4) AS samples_per_s FROM fx_metrics GROUP BY ALL""",
    views=("fx_metrics",),
)
def perf_windows(spark, sf):
    m = fx.metrics(spark, sf)
    d = D.perf_windows(m, "run", "step", "mpjpe", 2048, "transl_err")
    return d.select("run", "window", "last_step", _r("step_s", 5).alias("step_s"), "peak_mem", _r("samples_per_s").alias("samples_per_s"))


@query(
    "stale_tracks",
    "SELECT track, max(epoch_us(ts)) AS last_us FROM fx_tracks GROUP BY track HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 HOUR",
    views=("fx_tracks",),
)
def stale_tracks(spark, sf):
    t = fx.tracks(spark, sf).select("track", F.col("ts").cast("timestamp").alias("ts"))
    d = D.stale(t, "track", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return d.select("track", F.unix_micros("last_seen").alias("last_us"))


@query(
    "track_sessions",
    """SELECT track, session, count(*) AS n FROM (SELECT track, coalesce(sum(CASE WHEN gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY us, rec), 0)::BIGINT AS session
 FROM (SELECT *, us - lag(us) OVER (PARTITION BY track ORDER BY us, rec) AS gap FROM fx_tracks)) GROUP BY ALL""",
    views=("fx_tracks",),
)
def track_sessions(spark, sf):
    d = S.track_sessions(fx.tracks(spark, sf), ["track"], "us", "rec", 3_600_000_000)
    return d.groupBy("track", "session").agg(F.count(F.lit(1)).alias("n"))


@query(
    "latest_values",
    "SELECT run, max(step) AS step, arg_max(split, step) AS split, arg_max(mpjpe, step) AS mpjpe FROM fx_metrics GROUP BY run",
    views=("fx_metrics",),
)
def latest_values(spark, sf):
    return D.latest_per_run(fx.metrics(spark, sf), "run", "step", ["split", "mpjpe"])
