"""Streams in several batches give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import boards as D
from tallyfield.operators import sequences as S
from tallyfield.streaming import logs as G

DATA = [
    (i % 3, i, i - (i % 5) * 3, "ab"[i % 2], float((i * 37) % 50 + 50 / (i + 1)), 1_700_000_000_000_000 + i * 250_000 * (1 + i % 4))
    for i in range(120)
]
SCHEMA = "run int, pos long, step long, split string, v double, us long"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(DATA, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


@pytest.fixture
def stream(spark, table, tmp_path):
    path = str(tmp_path / "in")
    for lo in range(0, 120, 40):  # three files, three batches, in order
        table.where((F.col("pos") >= lo) & (F.col("pos") < lo + 40)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("limit", [1_000_000, 5])  # 5: every run is split over ranges
def test_monotonic_steps(table, stream, limit):
    want = D.monotonic_step(table.select("run", "pos", "step"), "run", "pos", "step")
    got = G.run_available(G.monotonic_step(stream, "run", "pos", "step", limit))
    assert rows(got, "run", "pos", "step") == rows(want, "run", "pos", "step")


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_early_stop(table, stream, limit):
    want = D.patience(table, ["run"], "pos", "split", "v", 4, 20)
    got = G.run_available(G.early_stop(stream, "run", "pos", "split", "v", 4, 20, limit))
    cols = ["run", "pos", "improved", "since", "stop"]
    assert rows(got, *cols) == rows(want, *cols)


def test_status_lines_once(table, stream):
    got = G.run_available(G.new_status(stream.select(F.col("split").alias("line")), "line"))
    assert rows(got, "line") == [("a",), ("b",)]
    timed = G.new_status(stream.select("ts", F.col("split").alias("line")), "line", "ts", "2 hours")
    assert rows(G.run_available(timed), "line") == [("a",), ("b",)]


def test_sessions(table, stream):
    gap = 1_500_000
    want = S.track_sessions(table, ["run"], "us", "pos", gap).groupBy("run", "session").count()
    got = G.run_available(G.track_sessions(stream, "run", "ts", gap), "complete")
    assert rows(got, "run", "n") == rows(want, "run", "count")


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_late_rows_are_flagged_not_dropped(stream, limit):
    got = G.run_available(G.with_late_side(stream, "run", "pos", "us", 2_000_000, limit))
    assert got.count() == 120
    newest, want = {}, []
    for run, pos, _, _, _, us in sorted(DATA, key=lambda r: r[1]):
        want.append((run, pos, run in newest and us < newest[run] - 2_000_000))
        newest[run] = max(us, newest.get(run, us))
    assert rows(got, "run", "pos", "late") == sorted(want)
    assert any(x[2] for x in want)


def test_latest_and_windows(table, stream):
    want = D.latest_per_run(table, "run", "pos", ["v"])
    got = G.run_available(D.latest_per_run(stream, "run", "pos", ["v"]), "complete")
    assert rows(got, "run", "pos", "v") == rows(want, "run", "pos", "v")
    d = stream.where("pos > 0").withColumn("m", F.col("v"))
    got = G.run_available(D.perf_windows(d, "run", "pos", "v", 64, "m"), "complete")
    want = D.perf_windows(table.where("pos > 0").withColumn("m", F.col("v")), "run", "pos", "v", 64, "m")
    assert rows(got, "run", "window", "last_step") == rows(want, "run", "window", "last_step")


def test_log_tail_reads_new_files_only(spark, tmp_path):
    base = tmp_path / "runs"
    (base / "r1").mkdir(parents=True)
    (base / "r1" / "0.jsonl").write_text('{"step": 1, "val/s/mpjpe": 2.5}\n{"step": 2, "train/loss": 1}\nnot json\n')
    rows_ = G.validation_rows(G.tail_logs(spark, str(base)))
    check, out = str(tmp_path / "c"), str(tmp_path / "o")

    def once():
        q = rows_.writeStream.option("checkpointLocation", check).trigger(availableNow=True).format("parquet").start(out)
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("run", "step", "metric", "value").collect())

    assert once() == [("r1", 1, "mpjpe", 2.5)]
    (base / "r1" / "1.jsonl").write_text('{"step": 3, "val/s/transl_err": 0.5}\n')
    assert once() == [("r1", 1, "mpjpe", 2.5), ("r1", 3, "transl_err_m", 0.5)]
