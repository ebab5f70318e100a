"""Stream queries, run over the events that are there and held to a batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import boards as D
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query
from tallyfield.session import scratch_path
from tallyfield.streaming import keyed as K
from tallyfield.streaming import logs as G


DAY_MS = 24 * K.HOUR_MS  # a run unseen for a day is over


def _r(col, n=4):
    return F.round(col, n)


def _named(e):
    return e.select(
        (F.col("user_id") % 12).alias("run"),
        F.col("user_id").alias("track"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("split"),
        F.col("value").alias("mpjpe"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 17 == 0).alias("missing"),
    )


def _events(spark, sf, batches=3):
    """The events table as a stream of ``batches`` micro-batches, in order of the events.

    Each batch is written on its own, in as many files as one trigger then reads.
    """
    events = fx.table(spark, sf, "events")
    n, low, high = events.agg(F.count(F.lit(1)), F.min("event_id"), F.max("event_id")).first()
    base = scratch_path(spark, "events")
    files = max(1, -(-n // batches // 1_000_000))
    cuts = [(low or 0) + ((high or 0) + 1 - (low or 0)) * i // batches for i in range(batches + 1)]
    for a, b in zip(cuts, cuts[1:]):
        part = events.where((F.col("event_id") >= a) & (F.col("event_id") < b))
        part.repartition(files).write.mode("append").parquet(base)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(base)
    return _named(stream)


@query(
    "stream_log_tail",
    "SELECT CAST(run AS VARCHAR) AS run, split, count(*) AS n, round(sum(mpjpe), 4) AS total FROM fx_metrics WHERE NOT missing GROUP BY ALL",
    views=("fx_metrics",),
)
def stream_log_tail(spark, sf):
    base = scratch_path(spark, "logs")
    m = fx.metrics(spark, sf).where(~F.col("missing"))
    line = F.to_json(
        F.map_from_arrays(
            F.array(F.lit("step"), F.concat(F.lit("val/"), "split", F.lit("/mpjpe"))),
            F.array(F.col("step").cast("double"), F.col("mpjpe")),
        )
    )
    for half in (0, 1):  # two rolls of the log
        part = m.where(F.col("step") % 2 == half).select(F.col("run").alias("folder"), line.alias("value"))
        part.write.mode("append").partitionBy("folder").text(base)
    rows = G.validation_rows(G.tail_logs(spark, base, 8))
    got = G.run_available(rows)
    got = got.withColumn("run", F.regexp_replace("run", "folder=", ""))
    return got.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("value")).alias("total"))


def _grown(lines, base, cut):
    """Write the log of every run, up to step ``cut`` and half a line more, or whole.

    A run's file is written anew with a longer text, which is how a growing file looks from outside.
    """

    def run(frames):
        from pyarrow import fs

        out, name = None, None
        store, root = fs.FileSystem.from_uri(base) if ":" in base else (fs.LocalFileSystem(), base)
        for frame in frames:
            for folder, step, line in zip(frame["run"].tolist(), frame["step"].tolist(), frame["line"].tolist()):
                if folder != name:
                    if out is not None:
                        out.close()
                    store.create_dir(f"{root}/{folder}")
                    out, name, over = store.open_output_stream(f"{root}/{folder}/log.jsonl"), folder, False
                data = f"{line}\n".encode()
                if cut is None or step < cut:
                    out.write(data)
                elif not over:
                    out.write(data[: len(data) // 2])
                    over = True
        if out is not None:
            out.close()
        yield from ()

    spread = lines.repartition("run").sortWithinPartitions("run", "step", "line")
    spread.mapInPandas(run, "n long").count()


@query(
    "stream_growing_logs",
    "SELECT CAST(run AS VARCHAR) AS run, split, count(*) AS n, round(sum(mpjpe), 4) AS total FROM fx_metrics WHERE NOT missing GROUP BY ALL",
    views=("fx_metrics",),
)
def stream_growing_logs(spark, sf):
    base = scratch_path(spark, "growing")
    m = fx.metrics(spark, sf).where(~F.col("missing"))
    line = F.to_json(
        F.map_from_arrays(
            F.array(F.lit("step"), F.concat(F.lit("val/"), "split", F.lit("/mpjpe"))),
            F.array(F.col("step").cast("double"), F.col("mpjpe")),
        )
    )
    lines = m.select(F.col("run").cast("string").alias("run"), "step", line.alias("line"))
    half = (lines.agg(F.max("step")).first()[0] or 0) // 2
    checkpoint, out = f"{base}-state", f"{base}-out"
    for cut in (half, None):  # two passes of one query, the logs grow in between
        _grown(lines, base, cut)
        rows = G.validation_rows(G.tail_growing(spark, base, split_bytes=1 << 26).select("run", "line"))
        write = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        write.format("parquet").option("path", out).start().awaitTermination()
    got = spark.read.schema(rows.schema).parquet(out)
    return got.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("value")).alias("total"))


@query(
    "stream_steps_monotonic",
    "SELECT run, pos, max(s) OVER (PARTITION BY run ORDER BY pos) AS step FROM (SELECT run, step AS pos, step - (step % 7) * 40 AS s FROM fx_metrics)",
    views=("fx_metrics",),
)
def stream_steps_monotonic(spark, sf):
    e = _events(spark, sf)
    d = e.select("run", F.col("step").alias("pos"), (F.col("step") - F.col("step") % 7 * 40).alias("step"))
    return G.run_available(K.monotonic_step(d, "run", "pos", "step", DAY_MS), idle=False)


@query(
    "stream_runs_open",
    "SELECT run, count(*) AS n FROM fx_metrics WHERE run % 3 <> 0 GROUP BY run",
    views=("fx_metrics",),
)
def stream_runs_open(spark, sf):
    done = fx.metrics(spark, sf).where("run % 3 = 0").select("run").distinct()
    got = G.run_available(D.open_runs(_events(spark, sf).select("run", "step"), done))
    return got.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_status_recent",
    "SELECT DISTINCT run || ' ' || split AS line FROM fx_metrics",
    views=("fx_metrics",),
)
def stream_status_recent(spark, sf):
    e = _events(spark, sf).select("ts", F.concat_ws(" ", F.col("run").cast("string"), "split").alias("line"))
    return G.run_available(G.new_status(e, "line", "ts", "60 days")).select("line")


@query(
    "stream_status_lines",
    "SELECT DISTINCT run || ' ' || split AS line FROM fx_metrics",
    views=("fx_metrics",),
)
def stream_status_lines(spark, sf):
    e = _events(spark, sf).select(F.concat_ws(" ", F.col("run").cast("string"), "split").alias("line"))
    return G.run_available(G.new_status(e, "line"))


@query(
    "stream_perf_windows",
    "SELECT run, floor((step - 1) / 50.0)::BIGINT AS \"window\", max(step) AS last_step, round(avg(mpjpe), 5) AS step_s FROM fx_metrics GROUP BY ALL",
    views=("fx_metrics",),
)
def stream_perf_windows(spark, sf):
    e = _events(spark, sf).withColumn("mem", F.col("mpjpe"))
    got = G.run_upserts(K.perf_windows(e, "run", "step", "mpjpe", "mem", ttl=DAY_MS), ["run", "window"], idle=False)
    return got.select("run", "window", "last_step", _r("step_s", 5).alias("step_s"))


@query(
    "stream_perf_by_time",
    """SELECT user_id % 12 AS run, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n, round(avg(value), 9) AS step_s FROM events GROUP BY ALL""",
)
def stream_perf_by_time(spark, sf):
    d = G.perf_time_windows(_events(spark, sf), "run", "ts", "mpjpe", "1 day")
    got = G.run_upserts(d, ["run", "start"])
    return got.select("run", F.unix_micros("start").alias("start_us"), "n", _r("step_s", 9).alias("step_s"))


# of the stream's last event, ten minutes are waited for late ones
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stream_perf_closed",
    f"""SELECT user_id % 12 AS run, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(avg(value), 9) AS step_s
FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY ALL""",
)
def stream_perf_closed(spark, sf):
    e = _events(spark, sf).withWatermark("ts", "10 minutes")
    got = G.run_available(G.perf_time_windows(e, "run", "ts", "mpjpe", "1 hour"))
    return got.select("run", F.unix_micros("start").alias("start_us"), "n", _r("step_s", 9).alias("step_s"))


@query(
    "stream_sessions_closed",
    f"""SELECT track, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT track, ts, us, sum(CASE WHEN gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY us, rec) AS s
 FROM (SELECT *, us - lag(us) OVER (PARTITION BY track ORDER BY us, rec) AS gap FROM fx_tracks)) GROUP BY track, s HAVING max(us) + 3600000000 <= epoch_us({_CLOSED})""",
    views=("fx_tracks",),
)
def stream_sessions_closed(spark, sf):
    got = G.run_available(G.track_sessions(_events(spark, sf), "track", "ts", 3_600_000_000, "10 minutes"))
    return got.select("track", F.unix_micros("start").alias("start_us"), "n")


@query(
    "stream_stale_tracks",
    f"SELECT track, max(us) AS last_us FROM fx_tracks GROUP BY track HAVING max(us) + 21600000000 < epoch_us({_CLOSED})",
    views=("fx_tracks",),
)
def stream_stale_tracks(spark, sf):
    found = G.run_available(K.stale(_events(spark, sf), "track", "ts", 6 * K.HOUR_MS, "10 minutes"))
    # a track that came back was stale only for a while
    last = fx.tracks(spark, sf).groupBy("track").agg(F.max("us").alias("last_us"))
    return found.join(last, ["track", "last_us"], "left_semi").select("track", "last_us").distinct()


@query(
    "stream_early_stop",
    """SELECT run, step, improved, since, step >= 50 AND since >= 30 AS stop FROM (SELECT run, step, improved, rn - coalesce(max(CASE WHEN improved THEN rn END) OVER (PARTITION BY run ORDER BY step), 0) AS since
 FROM (SELECT run, step, mpjpe < coalesce(min(mpjpe) OVER (PARTITION BY run, split ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS improved,
  row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM fx_metrics))""",
    views=("fx_metrics",),
)
def stream_early_stop(spark, sf):
    e = _events(spark, sf).select("run", "step", "split", "mpjpe")
    return G.run_available(K.early_stop(e, "run", "step", "split", "mpjpe", 30, 50, DAY_MS), idle=False)


@query(
    "stream_track_sessions",
    """SELECT track, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT track, ts, sum(CASE WHEN gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY us, rec) AS s
 FROM (SELECT *, us - lag(us) OVER (PARTITION BY track ORDER BY us, rec) AS gap FROM fx_tracks)) GROUP BY track, s""",
    views=("fx_tracks",),
)
def stream_track_sessions(spark, sf):
    got = G.run_available(G.track_sessions(_events(spark, sf), "track", "ts", 3_600_000_000), "complete")
    return got.select("track", F.unix_micros("start").alias("start_us"), "n")


@query(
    "stream_late_rows",
    """SELECT run, step, coalesce(us < before - 3600000000, false) AS late FROM (SELECT *, max(us) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM (SELECT user_id % 12 AS run, event_id AS step, epoch_us(ts) - CASE WHEN event_id % 23 = 0 THEN 86400000000 ELSE 0 END AS us FROM events))""",
)
def stream_late_rows(spark, sf):
    e = _events(spark, sf)
    us = F.unix_micros("ts") - F.when(F.col("step") % 23 == 0, F.lit(86_400_000_000)).otherwise(0)
    d = e.select("run", "step", us.alias("us"))
    got = G.run_available(K.with_late_side(d, "run", "step", "us", 3_600_000_000, DAY_MS), idle=False)
    return got.select("run", "step", "late")


@query(
    "stream_latest_values",
    "SELECT run, max(step) AS step, arg_max(mpjpe, step) AS mpjpe FROM fx_metrics GROUP BY run",
    views=("fx_metrics",),
)
def stream_latest_values(spark, sf):
    d = D.latest_per_run(_events(spark, sf), "run", "step", ["mpjpe"])
    return G.run_upserts(d, ["run"])
