"""Record generation as one call, file pruning, and counters of the writing job."""

import pytest
from pyspark.sql import functions as F

from tallyfield.operators.generate import generate_records
from tallyfield.sources import tables as T


def test_records_from_files_to_counters(spark, tmp_path):
    rec = spark.createDataFrame([(s, i, 100, 40) for s in (0, 1) for i in range(10)], "seq int, frame int, box_h int, box_w int")
    files = [(s, i, k) for s in (0, 1) for i in range(10) for k in ("png", "depth") if not (k == "depth" and i in (0, 4))]
    files = spark.createDataFrame(files, "seq int, frame int, kind string")
    labels = spark.createDataFrame([(0, i, 9 if i != 3 else 1) for i in range(9)], "seq int, frame int, points int")
    path = str(tmp_path / "out")
    made = generate_records(rec, files, labels, path, frame=["seq", "frame"], sequence=["seq"], label_on=["seq", "frame"], stride=2, n=4)
    # complete frames are 1 2 3 5 6 7 8 9, of which every second one is taken: 1 3 6 8
    got = {(r.seq, r.frame): r.status for r in spark.read.parquet(path).collect()}
    want = {(0, 1): "accepted", (0, 3): "rejected_points", (0, 6): "accepted", (0, 8): "accepted"}
    want |= {(1, i): "rejected_points" for i in (1, 3, 6, 8)}
    assert got == want
    assert made == {"records": 8, "labelled": 4, "accepted": 3, "rejected_box": 0, "rejected_points": 5}
    again = str(tmp_path / "small")
    assert generate_records(rec, files, labels, again, frame=["seq", "frame"], sequence=["seq"], label_on=["seq", "frame"], stride=2, limit=3, n=4) == made
    assert "_labelled" not in spark.read.parquet(path).columns
    none = generate_records(rec.limit(0), files, labels, str(tmp_path / "none"), frame=["seq", "frame"], sequence=["seq"], label_on=["seq", "frame"])
    assert set(none.values()) == {0}


def test_first_files_are_the_only_ones_read(spark, tmp_path):
    base = str(tmp_path / "many")
    spark.range(1000).withColumn("part", (F.col("id") % 100).cast("int")).repartition("part").write.partitionBy("part").parquet(base)
    d = T.limit_files(spark.read.parquet(base), 2, r"part=\d+")
    rows = d.collect()
    assert {r["part"] for r in rows} == {0, 1} and len(rows) == 20
    plan = d._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    assert plan.metrics().apply("numFiles").value() == 2
    (tmp_path / "flat").mkdir()
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.parquet(str(tmp_path / "flat" / f"{i}"))
    spark.range(9).write.parquet(str(tmp_path / "flat" / "0" / "job_stats.parquet"))
    got = T.read_records(spark, [str(tmp_path / "flat")], max_files=2)
    assert sorted(r["id"] for r in got.collect()) == [0, 1]


def test_counters_come_from_the_writing_job(spark, tmp_path):
    made = T.write_counted(spark.range(50), str(tmp_path / "t"), {"n": F.count(F.lit(1)), "even": F.count(F.when(F.col("id") % 2 == 0, 1))})
    assert made == {"n": 50, "even": 25} and spark.read.parquet(str(tmp_path / "t")).count() == 50
    with pytest.raises(Exception):
        T.write_counted(spark.range(1), str(tmp_path / "t"), {"n": F.count(F.lit(1))})
