"""Run logs as streams: tailing, monotonic steps, early stop, sessions, late rows.

Batch twins of all of these are in ``operators``; the tests hold both to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyfield.operators.boards import explode_log
from tallyfield.operators.ordered import (
    MAX_GROUP_ROWS,
    Ordered,
    carried,
    min_before,
    row_number,
    running_max,
)
from tallyfield.session import scratch_path
from tallyfield.sources import log_tail

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def state_store(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """A state store off the heap, set while a query starts and runs.

    ``idle`` allows batches without data. A query whose state expires by the clock asks for them for
    ever, so one that is to end with its data must not have them.
    """
    wanted = {PROVIDER: ROCKS, IDLE: str(idle).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tail_logs(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New log lines under ``path`` as (run, line).

    A file is read once, when it is complete: the writer closes a file and starts the next one
    instead of growing one file for ever, so there is no half line to wait for. The run is the
    folder of the file. The checkpoint of the query remembers what was read.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path)
    run = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return lines.select(run.alias("run"), F.col("value").alias("line"))


def tail_growing(spark: SparkSession, path: str, suffix: str = ".jsonl", split_bytes: int | None = None) -> DataFrame:
    """New lines of log files under ``path`` that grow in place, as (run, file, at, line).

    The checkpoint remembers a byte position per file. An unfinished last line waits for the rest of
    it; see ``sources.log_tail``.
    """
    log_tail.register(spark)
    reader = spark.readStream.format("log_tail").option("path", path).option("suffix", suffix)
    if split_bytes:
        reader = reader.option("splitBytes", str(split_bytes))
    return reader.load()


def validation_rows(lines: DataFrame) -> DataFrame:
    """Long validation rows of tailed log lines."""
    return explode_log(lines, "line")


@dataclass(frozen=True)
class Carried:
    """A stream whose micro-batches need what earlier ones left behind, a table with few rows per key.

    Each micro-batch is worked as a batch job over ``Ordered`` groups, so a run that holds most of
    its rows is spread over tasks and no run has to fit into one. ``work(batch, state)`` gives the
    rows to write; ``keep(batch, written, state)`` the state for the next micro-batch. Batches of a
    run must arrive in order; within one any order will do.
    """

    stream: DataFrame
    schema: str  # of the rows written
    state: str  # schema of the state
    work: Callable[[DataFrame, DataFrame], DataFrame]
    keep: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]

    def saver(self, base: str) -> Callable[[DataFrame, int], None]:
        """The function for ``foreachBatch``; rows go to ``base/out``.

        State is kept in two folders in turn: a repeated batch finds the one it started from as it
        was, and its rows replace those of the first attempt.
        """

        def save(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            state = (
                spark.read.schema(self.state).parquet(f"{base}/state/{(number - 1) % 2}")
                if number
                else spark.createDataFrame([], self.state)
            )
            batch = batch.persist()  # read several times
            try:
                out = f"{base}/out/batch={number}"
                self.work(batch, state).write.mode("overwrite").parquet(out)
                written = spark.read.schema(self.schema).parquet(out)
                self.keep(batch, written, state).write.mode("overwrite").parquet(f"{base}/state/{number % 2}")
            finally:
                batch.unpersist()

        return save


def _with_state(df: DataFrame, state: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null; the state's other columns are added."""
    named = state.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in state.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]
    return df.join(named, same, "left").drop(*[f"_k_{c}" for c in on])


def _newest(state: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Largest ``_last`` per key of the state and the new rows."""
    return state.unionByName(rows).groupBy(by).agg(F.max("_last").alias("_last"))


def monotonic_step(df: DataFrame, by: str, order: str, step: str, limit: int = MAX_GROUP_ROWS) -> Carried:
    """Steps that never go back: a row gets the largest step seen so far in its run."""
    kinds = dict(df.dtypes)

    def work(batch: DataFrame, state: DataFrame) -> DataFrame:
        d = Ordered(batch, [by], [order], limit).add(_top=running_max(F.col(step))).result()
        return _with_state(d, state, [by]).select(by, order, F.greatest("_top", "_last").alias(step))

    def keep(batch: DataFrame, written: DataFrame, state: DataFrame) -> DataFrame:
        return _newest(state, written.select(by, F.col(step).alias("_last")), by)

    schema = ", ".join(f"{c} {kinds[c]}" for c in (by, order, step))
    return Carried(df.select(by, order, step), schema, f"{by} {kinds[by]}, _last {kinds[step]}", work, keep)


def early_stop(
    df: DataFrame, by: str, step: str, source: str, value: str, n: int, min_steps: int = 0,
    limit: int = MAX_GROUP_ROWS,
) -> Carried:
    """Per evaluation of a run: improved, evaluations since, stop.

    All rows of one evaluation arrive together, as one log line. The state has the best value of
    every source of a run and, with ``_since`` set, how many evaluations ago the run last improved.
    """
    kinds = dict(df.dtypes)
    best = F.col("_since").isNull()

    def per_source(batch: DataFrame) -> DataFrame:
        v = F.col(value).cast("double")
        finite = F.when(F.abs(v) < float("inf"), v)  # NaN is no smaller
        return batch.groupBy(by, step, source).agg(F.min(finite).alias("_v"))

    def work(batch: DataFrame, state: DataFrame) -> DataFrame:
        d = Ordered(per_source(batch), [by, source], [step], limit).add(_b=min_before(F.col("_v"))).result()
        d = _with_state(d, state.where(best).select(by, source, "_best"), [by, source])
        bar = F.coalesce(F.least("_b", "_best"), F.lit(float("inf")))
        hit = F.coalesce(F.col("_v") < bar, F.lit(False))
        evals = d.groupBy(by, step).agg(F.bool_or(hit).alias("improved"))
        e = Ordered(evals, [by], [step], limit).add(_rn=row_number())
        e = e.add(_at=carried(F.when(F.col("improved"), F.col("_rn")))).result()
        e = _with_state(e, state.where(~best).select(by, "_since"), [by])
        before = F.col("_rn") + F.coalesce("_since", F.lit(0))
        since = F.when(F.col("_at").isNull(), before).otherwise(F.col("_rn") - F.col("_at"))
        stop = (F.lit(n) > 0) & (F.col(step) >= min_steps) & (since >= n)
        return e.select(by, F.col(step).cast("long").alias(step), "improved", since.alias("since"), stop.alias("stop"))

    def keep(batch: DataFrame, written: DataFrame, state: DataFrame) -> DataFrame:
        new = per_source(batch).select(by, source, F.col("_v").alias("_best"))
        bests = state.where(best).select(by, source, "_best").unionByName(new)
        bests = bests.groupBy(by, source).agg(F.min("_best").alias("_best"))
        last = written.select(by, step, F.col("since").alias("_since"))
        last = last.unionByName(state.where(~best).select(by, F.lit(None).cast("long").alias(step), "_since"))
        # rows of the state have no step, so they count only where the run had no new evaluation
        since = last.groupBy(by).agg(F.coalesce(F.max_by("_since", step), F.max("_since")).alias("_since"))
        return bests.unionByName(since, allowMissingColumns=True)

    schema = f"{by} {kinds[by]}, {step} long, improved boolean, since long, stop boolean"
    state = f"{by} {kinds[by]}, {source} {kinds[source]}, _best double, _since long"
    return Carried(df.select(by, step, source, value), schema, state, work, keep)


def with_late_side(
    df: DataFrame, by: str, order: str, time: str, delay: int, limit: int = MAX_GROUP_ROWS
) -> Carried:
    """Adds ``late`` instead of dropping rows: more than ``delay`` behind the newest of the run.

    A watermark would drop such rows without a word; here they keep their place on the time
    axis and can be sent to a side table.
    """
    kinds = dict(df.dtypes)

    def work(batch: DataFrame, state: DataFrame) -> DataFrame:
        d = Ordered(batch, [by], [order], limit).add(_low=min_before(-F.col(time))).result()
        newest = F.greatest(-F.col("_low"), F.col("_last"))
        late = F.coalesce(F.col(time) < newest - delay, F.lit(False))
        return _with_state(d, state, [by]).select(by, order, time, late.alias("late"))

    def keep(batch: DataFrame, written: DataFrame, state: DataFrame) -> DataFrame:
        return _newest(state, batch.select(by, F.col(time).alias("_last")), by)

    schema = ", ".join(f"{c} {kinds[c]}" for c in (by, order, time)) + ", late boolean"
    return Carried(df.select(by, order, time), schema, f"{by} {kinds[by]}, _last {kinds[time]}", work, keep)


def new_status(df: DataFrame, line: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each distinct status line once; with ``time`` only lines of the last ``delay`` are kept in state."""
    if time is None:
        return df.dropDuplicates([line])
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([line])


def track_sessions(df: DataFrame, by: str, time: str, gap_us: int, delay: str | None = None) -> DataFrame:
    """Sessions of a track: split where the gap to the row before is at least ``gap_us``.

    Spark's own sessions also join rows exactly one gap apart, hence one microsecond less.
    """
    d = df.withWatermark(time, delay) if delay else df
    window = F.session_window(time, f"{gap_us - 1} microseconds")
    out = d.groupBy(by, window.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("_w.start").alias("start"), "n")


def perf_time_windows(
    df: DataFrame, by: str, time: str, seconds: str, every: str, slide: str | None = None
) -> DataFrame:
    """Mean seconds per step over windows of time."""
    w = F.window(time, every, slide) if slide else F.window(time, every)
    out = df.groupBy(by, w.alias("_w")).agg(F.avg(seconds).alias("step_s"), F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("_w.start").alias("start"), "step_s", "n")


@dataclass(frozen=True)
class Upserts:
    """A table with one row per key, kept as the changes of each micro-batch.

    A batch writes the rows that changed and no other, under its number, so what it costs does not
    grow with the history; a repeated batch replaces itself. The value of a key is its row of the
    highest number. ``compact`` folds what is there into one part.
    """

    base: str
    keys: Sequence[str]

    def save(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        batch.write.mode("overwrite").parquet(f"{self.base}/batch={number}")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The newest row of every key."""
        stored = StructType([*schema.fields, StructField("batch", LongType())])
        rows = spark.read.schema(stored).parquet(self.base)
        rest = [c for c in schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_v"))
        return newest.select(*self.keys, "_v.*").select(*schema.names)

    def compact(self, spark: SparkSession, schema: StructType, upto: int) -> Upserts:
        """A table with the rows of all batches up to ``upto`` in one, in a folder of its own."""
        rest = [c for c in schema.names if c not in self.keys]
        stored = StructType([*schema.fields, StructField("batch", LongType())])
        rows = spark.read.schema(stored).parquet(self.base)
        old = rows.where(F.col("batch") <= upto).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_v"))
        new = Upserts(scratch_path(spark, "upserts"), self.keys)
        new.save(old.select(*self.keys, "_v.*").select(*schema.names), upto)
        later = rows.where(F.col("batch") > upto)
        later.write.mode("append").partitionBy("batch").parquet(new.base)
        return new


def run_upserts(df: DataFrame, keys: Sequence[str], idle: bool = True) -> DataFrame:
    """Runs a stream over all data that is there in update mode and returns its newest rows.

    ``idle``: see :func:`state_store`.
    """
    spark = df.sparkSession
    base = scratch_path(spark, "stream")
    table = Upserts(f"{base}/out", keys)
    with state_store(spark, idle):
        writer = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").outputMode("update")
        query = writer.trigger(availableNow=True).foreachBatch(table.save).start()
        query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], df.schema)
    return table.read(spark, df.schema)


def run_available(df: DataFrame | Carried, mode: str = "append", idle: bool = True) -> DataFrame:
    """Runs a stream over all data that is there now and returns what it wrote.

    ``append`` writes each row once. ``complete`` writes the whole result per batch into a
    folder of its own, so a repeated batch replaces itself; the last one is returned. ``idle``: see
    :func:`state_store`.
    """
    if isinstance(df, Carried):
        spark = df.stream.sparkSession
        base = scratch_path(spark, "stream")
        seen: list[int] = []
        save = df.saver(base)

        def counted(batch: DataFrame, number: int) -> None:
            save(batch, number)
            seen.append(number)

        writer = df.stream.writeStream.option("checkpointLocation", f"{base}/checkpoint")
        writer.trigger(availableNow=True).foreachBatch(counted).start().awaitTermination()
        if not seen:
            return spark.createDataFrame([], df.schema)
        return spark.read.schema(df.schema).parquet(*[f"{base}/out/batch={i}" for i in sorted(set(seen))])
    spark = df.sparkSession
    base = scratch_path(spark, "stream")
    schema: StructType = df.schema
    with state_store(spark, idle):
        writer = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True
        )
        if mode == "append":
            q = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
            q.awaitTermination()
            return spark.read.schema(schema).parquet(f"{base}/out")
        written: list[int] = []

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
            written.append(number)

        q = writer.outputMode(mode).foreachBatch(save).start()
        q.awaitTermination()
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/out/batch={max(written)}")
