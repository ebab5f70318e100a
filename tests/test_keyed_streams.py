"""Logs that grow in place, state that crosses batches and expires, and tables kept by their changes."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import boards as D
from tallyfield.sources.log_tail import LogTailReader, lines_between, whole_lines
from tallyfield.streaming import keyed as K
from tallyfield.streaming import logs as G

DATA = [
    (i % 3, i, None if i == 7 else i - (i % 5) * 3, "ab"[i % 2], float((i * 37) % 50 + 50 / (i + 1)), 1_700_000_000_000_000 + i * 250_000 * (1 + i % 4))
    for i in range(120)
]
SCHEMA = "run int, pos long, step long, split string, v double, us long"
LONG = 1 << 40


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(DATA, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


@pytest.fixture
def stream(spark, table, tmp_path):
    path = str(tmp_path / "in")
    for lo in range(0, 120, 40):  # three files, three batches, in order
        table.where((F.col("pos") >= lo) & (F.col("pos") < lo + 40)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def once(df, base, mode="append"):
    """One pass of a query with the state in ``base``; everything it wrote so far."""
    spark = df.sparkSession
    with G.state_store(spark, idle=False):
        w = df.writeStream.option("checkpointLocation", f"{base}/c").outputMode(mode).trigger(availableNow=True)
        w.format("parquet").option("path", f"{base}/o").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/o")


def test_lines_are_cut_once(tmp_path):
    from pyarrow import fs

    store = fs.LocalFileSystem()
    body = b"one\n\n" + b"x" * 3_000_000 + b"\nlast whole\nhalf"
    (tmp_path / "f").write_bytes(body)
    path = str(tmp_path / "f")
    stop = whole_lines(store, path, 0, len(body))
    assert stop == len(body) - 4 and whole_lines(store, path, stop, len(body)) == stop
    want = body[:stop].split(b"\n")[:-1]
    for step in (1_000_000_000, 1_048_576, 999_999, 7):
        if step == 7 and stop > 100:  # small parts around the ends of lines only
            cuts = [0, 3, 4, 5, 6, 1_500_000, 3_000_005, 3_000_006, 3_000_007, stop - 1, stop]
        else:
            cuts = [*range(0, stop, step), stop]
        got = [x for a, b in zip(cuts, cuts[1:]) for x in lines_between(store, path, a, b, stop)]
        assert [x for _, x in got] == want
        assert all(body[at : at + len(x)] == x for at, x in got)


def test_growing_logs(spark, tmp_path):
    base = tmp_path / "runs"
    lines = G.tail_growing(spark, str(base), split_bytes=16)
    assert once(lines, str(tmp_path / "none")).count() == 0  # no folder yet
    for run in ("r1", "r2"):
        (base / run).mkdir(parents=True)
    r1, r2 = base / "r1" / "log.jsonl", base / "r2" / "log.jsonl"
    r1.write_text("a1\na2 é\nhal")
    r2.write_text("")
    (base / "r2" / "other.txt").write_text("not a log\n")
    seen = lambda: rows(once(lines, str(tmp_path / "q")), "run", "line")
    assert seen() == [("r1", "a1"), ("r1", "a2 é")]
    assert seen() == [("r1", "a1"), ("r1", "a2 é")]  # a restart repeats nothing
    with r1.open("a") as f:
        f.write("f done\n" + "".join(f"line {i} of many\n" for i in range(200)) + "open")
    r2.write_text("b1\r\n")
    want = [("r1", "a1"), ("r1", "a2 é"), ("r1", "half done"), ("r2", "b1"), *(("r1", f"line {i} of many") for i in range(200))]
    assert seen() == sorted(want, key=str)
    r2.write_text("z\n")  # shorter than before: a new log
    assert seen() == sorted([*want, ("r2", "z")], key=str)


def test_driver_reads_new_bytes_only(tmp_path):
    (tmp_path / "r").mkdir()
    f = tmp_path / "r" / "0.jsonl"
    f.write_bytes(b"x\n" * 10)
    reader = LogTailReader({"path": str(tmp_path), "splitbytes": "6"})
    first = reader.latestOffset()
    assert list(first["files"].values()) == [20] and len(reader.partitions(reader.initialOffset(), first)) == 4
    with f.open("ab") as out:
        out.write(b"yy")
    assert reader.latestOffset() == first and reader.partitions(first, first) == []


@pytest.mark.parametrize("ttl", [None, LONG])
def test_monotonic_steps(table, stream, ttl):
    want = D.monotonic_step(table.select("run", "pos", "step"), "run", "pos", "step")
    got = G.run_available(K.monotonic_step(stream, "run", "pos", "step", ttl), idle=False)
    assert rows(got, "run", "pos", "step") == rows(want, "run", "pos", "step")


def test_hidden_names_are_refused(stream):
    with pytest.raises(ValueError):
        K.monotonic_step(stream.withColumnRenamed("step", "_step"), "run", "pos", "_step")


def test_early_stop(table, stream):
    want = D.patience(table, ["run"], "pos", "split", "v", 4, 20)
    got = G.run_available(K.early_stop(stream, "run", "pos", "split", "v", 4, 20, LONG), idle=False)
    cols = ["run", "pos", "improved", "since", "stop"]
    assert rows(got, *cols) == rows(want, *cols)


def test_late_rows(table, stream):
    want = G.run_available(G.with_late_side(stream, "run", "pos", "us", 2_000_000))
    got = G.run_available(K.with_late_side(stream, "run", "pos", "us", 2_000_000, LONG), idle=False)
    assert rows(got, "run", "pos", "late") == rows(want, "run", "pos", "late")
    assert got.where("late").count() > 0


def test_state_of_an_unseen_run_expires(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "run int, pos long, step long"
    add = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema)
    add([(1, 0, 50), (2, 0, 70)])
    kept, gone = (K.monotonic_step(stream.parquet(path), "run", "pos", "step", ttl) for ttl in (LONG, 1))
    for q, name in ((kept, "kept"), (gone, "gone")):
        once(q, str(tmp_path / name))
    time.sleep(1)
    add([(1, 1, 10), (2, 1, 90)])
    assert rows(once(kept, str(tmp_path / "kept")), "run", "pos", "step") == [(1, 0, 50), (1, 1, 50), (2, 0, 70), (2, 1, 90)]
    assert rows(once(gone, str(tmp_path / "gone")), "run", "pos", "step") == [(1, 0, 50), (1, 1, 10), (2, 0, 70), (2, 1, 90)]


def test_stale_tracks(spark, tmp_path):
    path, hour = str(tmp_path / "in"), 3_600_000_000
    schema = "track int, us long"
    zero = 1_700_000_000_000_000
    for part in ([(1, 0), (2, 0), (None, 0)], [(1, hour), (3, 4 * hour)], [(3, 9 * hour), (2, 9 * hour)]):
        spark.createDataFrame([(t, zero + us) for t, us in part], schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)
    kind = spark.read.parquet(path).schema
    d = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    got = G.run_available(K.stale(d, "track", "ts", 2 * K.HOUR_MS, "1 minute"))
    # 2 and 3 were seen again before the clock of their batch had passed their time
    assert rows(got, "track", "last_us") == sorted([(1, zero + hour), (None, zero)], key=str)


def test_windows_by_their_changes(spark, table, stream, tmp_path):
    d = stream.withColumn("m", F.col("v"))
    got = G.run_upserts(K.perf_windows(d, "run", "pos", "v", "m", 16), ["run", "window"], idle=False)
    want = D.perf_windows(table.withColumn("m", F.col("v")), "run", "pos", "v", 64, "m", 16)
    one = lambda df: rows(df.withColumn("s", F.round("step_s", 9)), "run", "window", "last_step", "s", "peak_mem")
    assert one(got) == one(want)
    last = G.run_upserts(D.latest_per_run(stream, "run", "pos", ["v"]), ["run"])
    assert rows(last, "run", "pos", "v") == rows(D.latest_per_run(table, "run", "pos", ["v"]), "run", "pos", "v")


def test_upserts_write_changes_only(spark, tmp_path):
    t = G.Upserts(str(tmp_path / "t"), ["k"])
    kind = "k long, v long"
    for n in range(6):
        t.save(spark.createDataFrame([(n, n), (0, n * 10)], kind).coalesce(1), n)
    t.save(spark.createDataFrame([(5, 5), (0, 50)], kind).coalesce(1), 5)  # a repeated batch
    size = [sum(os.path.getsize(f) for f in (tmp_path / "t" / f"batch={n}").glob("*.parquet")) for n in range(6)]
    assert max(size) < 1.1 * min(size)
    schema = spark.createDataFrame([], kind).schema
    want = [(0, 50), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert rows(t.read(spark, schema), "k", "v") == want
    small = t.compact(spark, schema, 3)
    assert rows(small.read(spark, schema), "k", "v") == want
    assert spark.read.parquet(small.base).where("batch = 3").count() == 4


def test_closed_windows_do_not_meet_the_store():
    class Store(dict):
        calls = 0

        def iterator(self):
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, key, value):
            self.calls += 1
            self[key[0]] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key[0]]

    work = K._PerfWindows("run", "step", "s", "mem", 10, 2, None)
    work.sums = Store()
    steps = [range(1, 1005), range(1005, 2001)]
    got = {}
    for batch in steps:
        d = pd.DataFrame({"step": list(batch), "s": [float(x % 7) for x in batch], "mem": [float(x % 11) for x in batch]})
        for out in work.handleInputRows(("r",), iter([d]), None):
            got.update({r.window: (r.last_step, r.step_s, r.n, r.peak_mem) for r in out.itertuples()})
    every = {w: range(10 * w + 1, 10 * w + 11) for w in range(200)}
    assert got == {w: (max(x), pytest.approx(sum(i % 7 for i in x) / 10), 10, max(i % 11 for i in x)) for w, x in every.items()}
    assert sorted(work.sums) == [198, 199] and work.sums.calls <= 8
