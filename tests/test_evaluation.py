"""Analytic cases of joint errors, precision, distance bins and attached predictions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import pose as P
from tallyfield.operators import evaluation as E

JOINTS = [[math.sin(i), math.cos(2 * i), 0.1 * i + 5] for i in range(24)]


def table(spark, gt, pred, valid=None):
    v = valid or [True] * len(gt)
    return spark.createDataFrame(
        [(gt, pred, v)], "gt array<array<double>>, pred array<array<double>>, valid array<boolean>"
    )


def test_one_centimetre_everywhere(spark):
    pred = [[x + 0.01 for x in p] for p in JOINTS]
    d = table(spark, JOINTS, pred)
    g, p, v = F.col("gt"), F.col("pred"), F.col("valid")
    r = d.select(
        P.mpjpe(g, p, v).alias("abs"),
        P.mpjpe(P.centre_joints(g, v), P.centre_joints(p, v), v).alias("rel"),
        P.pve(g, p, g[0], p[0]).alias("pve"),
    ).first()
    assert r["abs"] == pytest.approx(math.sqrt(3) * 10)
    assert r["rel"] == pytest.approx(0, abs=1e-9) and r["pve"] == pytest.approx(0, abs=1e-9)


def test_alignment_ignores_similarity_and_sees_the_rest(spark):
    a = 0.7
    rot = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    moved = (1.7 * np.array(JOINTS) @ rot.T + [3, -1, 2]).tolist()
    valid = [i != 5 for i in range(24)]
    moved[5] = [99.0, 99.0, 99.0]
    d = table(spark, JOINTS, moved, valid)
    assert d.select(P.pa_mpjpe("gt", "pred", "valid")).first()[0] == pytest.approx(0, abs=1e-6)
    flipped = [[-x, y, z] for x, y, z in JOINTS]
    assert table(spark, JOINTS, flipped).select(P.pa_mpjpe("gt", "pred", "valid")).first()[0] > 10


def test_no_valid_joint_gives_null(spark):
    d = table(spark, JOINTS, JOINTS, [False] * 24)
    g, p, v = F.col("gt"), F.col("pred"), F.col("valid")
    r = d.select(P.mpjpe(g, p, v), P.pa_mpjpe(g, p, v), P.centre_joints(g, v)[0][0]).first()
    assert r[0] is None and r[1] is None and r[2] == JOINTS[0][0]


def test_precision_of_perfect_and_half(spark):
    data = [("all", 1, 0.9, 1.0), ("all", 2, 0.1, 1.0), ("half", 1, 0.9, 0.0), ("half", 2, 0.1, 1.0)]
    d = spark.createDataFrame(data, "g string, k int, score double, iou double")
    got = {r["g"]: r for r in E.average_precision(d, ["g"], "iou", "score", "k").collect()}
    assert got["all"]["map"] == 1.0
    assert got["half"]["ap_50"] == pytest.approx(0.25)


def test_equal_scores_are_ranked_by_key(spark):
    data = [("a", 1, 1.0, 1.0), ("a", 2, 1.0, 0.0), ("b", 1, 1.0, 0.0), ("b", 2, 1.0, 1.0)]
    d = spark.createDataFrame(data, "g string, k int, score double, iou double").repartition(4)
    got = {r["g"]: r["ap_50"] for r in E.average_precision(d, ["g"], "iou", "score", "k").collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(0.25)}


def test_distance_bins(spark):
    data = [(5.0, 1.0), (10.0, 2.0), (29.99, 4.0), (30.0, 8.0), (-1.0, 99.0), (float("nan"), 99.0)]
    d = spark.createDataFrame(data, "z double, e double").withColumn("g", F.lit(0))
    got = {r["bin"]: (r["error"], r["n"]) for r in E.error_by_distance(d, ["g"], F.col("e"), F.col("z")).collect()}
    assert got == {"0-10m": (1.0, 1), "10-20m": (2.0, 1), "20-30m": (4.0, 1), ">30m": (8.0, 1)}
    few = E.error_by_distance(d.where("z < 10"), ["g"], F.col("e"), F.col("z"))
    assert few.where("bin = '>30m'").first()["error"] is None


def test_summary_skips_nan_and_null(spark):
    data = [(0, 1.0, 0.5), (0, float("nan"), 0.0), (0, None, 1.0), (0, 3.0, 0.5)]
    d = spark.createDataFrame(data, "g int, e double, iou double")
    r = E.summarize(d, ["g"], ["e"], "iou").first()
    assert (r["n"], r["e"], r["mean_iou"]) == (4, 2.0, 0.5)


def test_last_prediction_wins(spark):
    gt = spark.createDataFrame([("a",), ("b",)], "key string")
    pred = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("c", 0, 3.0)], "key string, pos int, x double")
    got = {r["key"]: (r["x"], r["missing"]) for r in E.attach_predictions(gt, pred).collect()}
    assert got == {"a": (2.0, False), "b": (None, True)}
    assert [r[0] for r in E.missing_keys(gt, pred).collect()] == ["b"]


def test_placement_needs_both_hips(spark):
    d = table(spark, JOINTS[:15], JOINTS[:21])
    ok = [True] * 15
    gt, coco = F.col("gt"), F.col("pred")
    got = d.select(
        P.keypoint_placement(gt, F.array(*[F.lit(x) for x in ok]), coco),
        P.keypoint_placement(gt, F.array(*[F.lit(i != 10) for i in range(15)]), coco),
    ).first()
    assert got[0] is not None and got[1] is None


def test_cloud_without_valid_points_has_no_centroid(spark):
    d = spark.createDataFrame([(0, 1.0, 1.0, 1.0, False)], "c int, x double, y double, z double, v boolean")
    r = E.centroid(d, ["c"], F.col("v")).first()
    assert r["x"] is None and r["any_valid"] is False
    from tallyfield.operators.labels import place_at_centroid

    p = spark.createDataFrame([(0, [[1.0, 2.0, 3.0]])], "c int, j array<array<double>>")
    out = place_at_centroid(p, E.centroid(d, ["c"], F.col("v")), "c", "j").first()
    assert out["j"] == [[1.0, 2.0, 3.0]]


def test_flat_boxes_are_null(spark):
    d = spark.createDataFrame(
        [(0, 1.0, 1.0), (0, 1.0, 5.0), (1, float("nan"), 1.0), (2, -5.0, 0.0), (2, 900.0, 50.0)],
        "c int, u double, v double",
    )
    got = {r["c"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in E.bbox2d(d, ["c"], 256, 256).collect()}
    assert got[0] == (None,) * 4 and got[1] == (None,) * 4
    assert got[2] == (0.0, 0.0, 255.0, 50.0)


def test_missing_overlap_is_a_miss_and_missing_score_last(spark):
    from tallyfield.operators.evaluation import average_precision
    from tallyfield.operators.records import gate_status

    nan = float("nan")
    d = spark.createDataFrame([("a", 1, nan, 0.9), ("b", 1, 0.9, 0.8), ("b", 2, 0.1, nan)], "g string, k int, iou double, s double")
    got = {r["g"]: r["ap_50"] for r in average_precision(d, ["g"], "iou", "s", "k", (0.5,)).collect()}
    assert got == {"a": 0.0, "b": 0.5}
    b = spark.createDataFrame([(nan, 900.0, 900), (900.0, None, 900)], "h double, w double, n int")
    assert {r[0] for r in b.select(gate_status(F.col("h"), F.col("w"), F.col("n"))).collect()} == {"rejected_box"}


def test_metric_summary_of_missing_predictions(spark):
    """A row without a prediction is a miss in every precision and counts; means skip it."""
    nan = float("nan")
    data = [
        ("m", 1, 10.0, 0.8, 0.9, 0.5, 5.0), ("m", 2, 30.0, 0.3, 0.8, 1.5, 12.0),
        ("m", 3, None, None, None, None, None), (None, 4, nan, nan, nan, nan, 50.0),
    ]
    d = spark.createDataFrame(data, "method string, key int, mpjpe double, iou double, score double, err double, depth double")
    got = E.metric_summary(d, ["method"], ["mpjpe"], iou="iou", score="score", key="key", error="err", depth="depth")
    rows = {r["method"]: r for r in got.collect()}
    r = rows["m"]
    assert (r["n"], r["mpjpe"]) == (3, 20.0)
    assert [round(r[c], 6) for c in ("ap_25", "ap_50", "ap_70")] == [round(2 / 3, 6), round(1 / 3, 6), round(1 / 3, 6)]
    assert round(r["map"], 6) == round(4 / 9, 6)
    assert [(b["bin"], b["error"], b["n"]) for b in r["by_distance"]] == [
        ("0-10m", 0.5, 1), ("10-20m", 1.5, 1), ("20-30m", None, 0), (">30m", None, 0)
    ]
    assert rows[None]["n"] == 1 and rows[None]["mpjpe"] is None and rows[None]["map"] == 0.0
