"""Records, labels, matching, boards: boundary cases and refusals."""

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import text as X
from tallyfield.operators import boards as D
from tallyfield.operators import labels as L
from tallyfield.operators import matching as M
from tallyfield.operators import records as R
from tallyfield.sources import tables as T


def test_gate_order_and_borders(spark):
    data = [(90, 35, 30), (89, 35, 0), (90, 34, 30), (90, 35, 29), (90, 35, None)]
    d = spark.createDataFrame(data, "box_h int, box_w int, points int")
    assert [r["status"] for r in R.gate_records(d).collect()] == [
        "accepted", "rejected_box", "rejected_box", "rejected_points", "rejected_points",
    ]


def test_track_keeps_the_segment(spark):
    d = spark.createDataFrame([("w/s1/1500000_x/7",), ("w/s2/1500000_x/7",)], "key string")
    rows = R.with_track(d).collect()
    assert rows[0]["track"] != rows[1]["track"] and rows[0]["time_s"] == 1.5


def test_incomplete_frames(spark):
    d = spark.createDataFrame([(1, "png"), (1, "depth"), (2, "png"), (3, "mask")], "frame int, kind string")
    got = {r["frame"]: r["complete"] for r in R.complete_frames(d, ["frame"]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_missing_sidecar_is_an_error(spark):
    a = spark.createDataFrame([("a",), ("b",)], "f string")
    with pytest.raises(R.MissingSidecar, match="1 without side file, e.g. b"):
        R.require_sidecar(a, a.where("f = 'a'"), "f")
    assert R.require_sidecar(a, a, "f") is a


def test_key_assertion(spark):
    a = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    R.assert_same_keys(a, a.repartition(3), "key")
    with pytest.raises(ValueError):
        R.assert_same_keys(a, a.distinct(), "key")


def test_updates_must_be_unique_and_keep_types(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    new = spark.createDataFrame([("a", 7.0)], "key string, n double")
    out = R.update_columns(d, new)
    assert dict(out.dtypes)["n"] == "int" and sorted(r["n"] for r in out.collect()) == [2, 7]
    with pytest.raises(ValueError):
        R.update_columns(d, new.union(new))


def test_no_evidence_is_rejected(spark):
    data = [(0.08, 0.06, 6.0), (0.0801, 0.0, 0.0), (float("nan"), 0.0, 0.0), (None, 0.0, 0.0), (0.0, float("inf"), 0.0)]
    d = spark.createDataFrame(data, "kp_error_m double, chamfer_m double, prior_energy double")
    rows = L.label_confidence(d).collect()
    assert [r["accepted"] for r in rows] == [True, False, False, False, False]
    assert rows[0]["confidence"] > 0 and all(r["confidence"] == 0 for r in rows[1:])


def test_fallback_positions(spark):
    r = spark.createDataFrame([("a", [9.0]), ("b", [9.0]), ("c", [9.0]), ("d", [9.0])], "key string, box_centre array<double>")
    first = spark.createDataFrame([("a", [1.0], [1.5])], "key string, pose array<double>, transl array<double>")
    second = spark.createDataFrame([("a", [2.0]), ("b", [2.0]), ("c", [2.0])], "key string, pose array<double>")
    cent = spark.createDataFrame([("b", [4.0])], "key string, centroid array<double>")
    got = {x["key"]: (x["init"], x["transl"]) for x in L.init_with_fallback(r, first, second, cent).collect()}
    assert got == {"a": ("first", [1.5]), "b": ("second", [4.0]), "c": ("second", [9.0]), "d": ("none", None)}


def test_label_without_mask_stays_alone(spark):
    px = [(0, lab, i, float(u), float(v)) for lab, u0 in ((0, 10), (1, 60), (2, 500)) for i, (u, v) in enumerate(
        (u0 + a, 10 + b) for a in range(12) for b in range(12))]
    masks = [(0, m, u, v) for m, u0 in (("p", 10), ("q", 60)) for u in range(u0, u0 + 12) for v in range(10, 22)]
    scores = M.overlap_scores(
        spark.createDataFrame(px, "frame int, label int, idx int, u double, v double"),
        spark.createDataFrame(masks, "frame int, mask string, u long, v long"),
    )
    got = {(r["label"], r["mask"]) for r in M.greedy_match(scores, ["frame"], "label", "mask").collect()}
    assert got == {(0, "p"), (1, "q")}


def test_first_camera_wins_a_tie(spark):
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    cam = lambda n, f: (n, [float(x) for x in eye], f, f, 50.0, 50.0, 100.0, 100.0)
    corners = [[x, y, 10.0] for x in (-1.0, 1.0) for y in (-1.0, 1.0)]
    schema = ("corners array<array<double>>, cams array<struct<channel: string, pose: array<double>, fx: double,"
              " fy: double, cx: double, cy: double, width: double, height: double>>")
    d = spark.createDataFrame([(corners, [cam("a", 100.0), cam("b", 100.0), cam("c", 9000.0)]), (corners, [cam("c", 9000.0)])], schema)
    got = [r[0] for r in d.select(M.best_camera(F.col("corners"), F.col("cams"))).collect()]
    assert got[0]["channel"] == "a" and got[1] is None


def test_old_log_rows_lose_their_placement(spark):
    cols = "run string, step long, split string, metric string, value double"
    logs = spark.createDataFrame(
        [("r", 1000, "s", "mpjpe", 1.0), ("r", 2000, "s", "mpjpe", 2.0), ("r", 2000, "s", "transl_err_m", 9.0),
         ("q", 500, "s", "mpjpe", 5.0)], cols)
    evals = spark.createDataFrame([("q", 3000, "s", "mpjpe", 4.0)], cols)
    done = spark.createDataFrame([("q",)], "run string")
    got = {(r["run"], r["metric"]): (r["value"], r["note"]) for r in D.load_runs(evals, logs, done).collect()}
    assert got == {
        ("r", "mpjpe"): (2.0, "running, step 2k"), ("r", "transl_err_m"): (None, "running, step 2k"),
        ("q", "mpjpe"): (4.0, "final step 3k"),
    }


def test_patience(spark):
    values = [5.0, 4.0, 4.0, 4.5, float("nan"), 3.9]
    d = spark.createDataFrame([("r", i, "a", v) for i, v in enumerate(values)], "run string, step int, split string, v double")
    rows = sorted(D.patience(d, ["run"], "step", "split", "v", 3).collect(), key=lambda r: r["step"])
    assert [r["since"] for r in rows] == [0, 0, 1, 2, 3, 0]
    assert [r["stop"] for r in rows] == [False, False, False, False, True, False]


def test_text_helpers(spark):
    d = spark.createDataFrame([(1023.0, 3599.0), (1536.0, 5400.0)], "b double, s double")
    assert [r[0] for r in d.select(X.fmt_bytes(F.col("b"))).collect()] == ["1023 B", "2 KB"]
    assert [r[0] for r in d.select(X.fmt_eta(F.col("s"))).collect()] == ["~60 min", "~1.5 h"]
    runs = spark.createDataFrame([("x-000",), ("x-007",), ("x-y-031",), ("x-12",)], "run string")
    assert X.next_run_name(runs, "x").first()[0] == "x-008"
    assert X.next_run_name(runs, "z").first()[0] == "z-000"
    kv = spark.createDataFrame([("a=1;noise;b=x=y;a=2",)], "c string").select(X.parse_kv(F.col("c"))).first()[0]
    assert kv == {"a": "2", "b": "x=y"}


def test_decimals_are_rounded_from_the_exact_value(spark):
    values = [1.25, 1.75, 0.15, 0.25, -0.04, 2.675, 0.0005, 1e15, 123456.0625, 9.95, 36_900 / 3600, 7_353 / 7, 1.0000000000000002]
    values += [k / 8000 for k in range(1, 8000, 7)] + [k * 90 / 3600 for k in range(40, 400)] + [k / 7 for k in range(1, 3000, 11)]
    d = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = d.select("v", *[X.fixed(F.col("v"), n).alias(f"d{n}") for n in (1, 2, 3)]).collect()
    assert [(r.d1, r.d2, r.d3) for r in got] == [(f"{r.v:.1f}", f"{r.v:.2f}", f"{r.v:.3f}") for r in got]
    eta = spark.createDataFrame([(4500,), (8100,)], "s long").select(X.fmt_eta(F.col("s")))
    assert [r[0] for r in eta.collect()] == ["~1.2 h", "~2.2 h"]


def test_side_files_are_skipped(spark, tmp_path):
    base = str(tmp_path)
    spark.range(5).write.parquet(f"{base}/a_0000.parquet")
    spark.range(7).write.parquet(f"{base}/b_0001.parquet")
    spark.range(100).write.parquet(f"{base}/a_stats.parquet")
    spark.range(100).write.parquet(f"{base}/a_0000.fit.parquet")
    assert T.read_records(spark, [base]).count() == 12


def test_broken_loader_does_not_stop_the_others(spark):
    def bad():
        raise FileNotFoundError("no calibration")

    d, skipped = T.load_all({"good": lambda: spark.range(3), "bad": bad})
    assert d.count() == 3 and skipped == [("bad", "no calibration")]


def test_versions_are_numbers(spark):
    d = spark.createDataFrame([("v1.9-mini",), ("v1.10-mini",), ("v1.2",)], "version string")
    assert T.latest_version(d).first()[0] == "v1.10-mini"
