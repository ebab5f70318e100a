"""Grid search against brute force, with copies, dense spots and far points."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polygons import ground_overlap
from tallyfield.operators.evaluation import pairwise_iou
from tallyfield.operators.records import count_in_boxes, points_in_box
from tallyfield.operators.spatial import PointIndex, _first_k, nearest


def cloud(n, seed, spots):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.35:  # copies of one position
            p = (1.0, 1.0, 1.0)
        elif kind < 0.7:  # a dense spot
            p = tuple(2 + rnd.random() * 0.01 for _ in range(3))
        else:
            p = tuple(rnd.uniform(-spots, spots) for _ in range(3))
        out.append((i % 2, i, *p))
    return out


def brute(qs, ps, k, limit=None):
    out = []
    for g, q, *a in qs:
        d = sorted(
            (float(np.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b)))), p)
            for h, p, *b in ps
            if h == g
        )
        d = [x for x in d if limit is None or x[0] <= limit]
        out += [(g, q, p, rank + 1, round(dist, 9)) for rank, (dist, p) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize(
    "k,limit,leaf,small",
    [(1, None, 8, 0), (3, None, 8, 0), (1, 0.5, 8, 0), (2, 0.5, 4, 0), (1, 0.5, 10_000, 0), (3, None, 8, 4096), (1, 0.5, 8, 4096)],
)
def test_nearest_equals_brute_force(spark, k, limit, leaf, small):
    qs, ps = cloud(120, 1, 4), cloud(400, 2, 4)
    schema = "g int, {} int, x double, y double, z double"
    a = spark.createDataFrame(qs, schema.format("q"))
    b = spark.createDataFrame(ps, schema.format("p"))
    got = nearest(
        a, b, by=["g"], coords=["x", "y", "z"], query_id="q", point_id="p", k=k, max_distance=limit, leaf=leaf, small=small
    )
    rows = sorted((r["g"], r["q"], r["p"], r["rank"], round(r["distance"], 9)) for r in got.collect())
    assert rows == brute(qs, ps, k, limit)


def test_nearest_without_groups_and_with_queries_outside(spark):
    ps = [(0, *p) for p in cloud(200, 3, 2)]
    ps = [(r[0], r[2], *r[3:]) for r in ps]
    qs = [(0, i, 50.0 * i - 100, 3.0, -7.0) for i in range(5)]
    a = spark.createDataFrame([r[1:] for r in qs], "q int, x double, y double, z double")
    b = spark.createDataFrame([r[1:] for r in ps], "p int, x double, y double, z double")
    got = nearest(a, b, coords=["x", "y", "z"], query_id="q", point_id="p", k=2, leaf=8, small=0)
    whole = nearest(a, b, coords=["x", "y", "z"], query_id="q", point_id="p", k=2)
    assert sorted(whole.collect()) == sorted(got.collect())
    rows = sorted((0, r["q"], r["p"], r["rank"], round(r["distance"], 9)) for r in got.collect())
    assert rows == brute(qs, ps, 2)


def test_one_index_for_several_searches(spark):
    # groups of one point, of some, and of many, half of it at one spot; one group has no queries
    ps = cloud(500, 8, 5) + [(2, 1000, 0.0, 0.0, 0.0), (3, 1001, 1.0, 1.0, 1.0), (None, 1002, 0.0, 0.0, 0.0)]
    ps += [(4, 2000 + i, i * 0.1, 0.0, None if i == 3 else 1.0) for i in range(10)]
    schema = "g int, {} int, x double, y double, z double"
    b = spark.createDataFrame(ps, schema.format("p"))
    index = PointIndex(b, by=["g"], coords=["x", "y", "z"], point_id="p", k=3, leaf=8, small=20)
    assert index.small is not None and index.leaves is not None
    ps = [p for p in ps if p[0] is not None and p[4] is not None]
    for seed, k, limit in ((11, 1, None), (12, 3, None), (13, 2, 0.7)):
        qs = cloud(60, seed, 5) + [(2, 500, 3.0, 4.0, 0.0), (4, 501, 0.0, 0.0, 0.0), (9, 502, 0.0, 0.0, 0.0)]
        a = spark.createDataFrame([*qs, (None, 7, 0.0, 0.0, 0.0), (2, 503, None, 0.0, 0.0)], schema.format("q"))
        got = index.search(a, "q", k, limit).collect()
        assert sorted((r["g"], r["q"], r["p"], r["rank"], round(r["distance"], 9)) for r in got) == brute(qs, ps, k, limit)
    with pytest.raises(ValueError):
        index.search(a, "q", 4)
    index.drop()
    assert nearest(a, b.limit(0), by=["g"], coords=["x"], query_id="q", point_id="p").count() == 0


def test_leaves_are_not_shuffled(spark):
    b = spark.createDataFrame(cloud(400, 5, 5), "g int, p int, x double, y double, z double")
    a = spark.createDataFrame(cloud(400, 6, 5), "g int, q int, x double, y double, z double")
    index = PointIndex(b, by=["g"], coords=["x", "y", "z"], point_id="p", leaf=8, small=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = index.search(a, "q")
        d.count()
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.rindex(index.table) - 400 :]
    assert "Bucketed: true" in scan


def boxes(n, seed):
    rnd = random.Random(seed)
    return [
        (
            i % 3,
            i,
            [
                rnd.uniform(0, 12), rnd.uniform(0, 1), rnd.uniform(0, 12), rnd.uniform(1, 6),
                1.5, rnd.uniform(1, 6), rnd.uniform(-3, 3),
            ],
        )
        for i in range(n)
    ]


def test_pairwise_overlap_finds_every_pair_once(spark):
    data = boxes(45, 4)
    d = spark.createDataFrame(data, "frame int, rec int, box array<double>")
    got = pairwise_iou(d, d, "frame", ("rec", "rec"), cell_m=3.0).collect()
    pairs = [(r["rec_a"], r["rec_b"]) for r in got]
    assert len(pairs) == len(set(pairs))
    for f, i, a in data:
        for g, j, b in data:
            if f != g:
                continue
            area = ground_overlap(np.array([a]), np.array([b]))[0]
            high = max(0, min(a[1] + 0.75, b[1] + 0.75) - max(a[1] - 0.75, b[1] - 0.75))
            assert ((i, j) in pairs) == (area * high > 1e-12)


def test_points_in_turned_boxes(spark):
    data = boxes(12, 5)
    rnd = random.Random(6)
    pts = [(i % 3, i, rnd.uniform(0, 12), rnd.uniform(0, 1), rnd.uniform(0, 12)) for i in range(300)]
    p = spark.createDataFrame(pts, "frame int, idx int, x double, y double, z double")
    b = spark.createDataFrame(data, "frame int, rec int, box array<double>")
    got = sorted((r["idx"], r["rec"]) for r in points_in_box(p, b, "frame", "rec", 0.15).collect())
    want = []
    for f, i, x, y, z in pts:
        for g, j, q in data:
            c, s = np.cos(q[6]), np.sin(q[6])
            u, v = c * (x - q[0]) + s * (z - q[2]), c * (z - q[2]) - s * (x - q[0])
            m = 0.15
            if f == g and abs(u) <= q[3] / 2 + m and abs(v) <= q[5] / 2 + m and abs(y - q[1]) <= q[4] / 2 + m:
                want.append((i, j))
    assert got == sorted(want)


def test_search_plan_has_no_nested_loop(spark):
    a = spark.range(500).select(F.col("id").alias("q"), (F.col("id") % 7).cast("double").alias("x"))
    b = spark.range(500).select(F.col("id").alias("p"), (F.col("id") % 11).cast("double").alias("x"))
    d = nearest(a, b, coords=["x"], query_id="q", point_id="p", max_distance=0.5)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_one_far_outlier_leaves_no_overfull_cell(spark):
    """A return a thousand kilometres off costs levels of the pyramid, not an all-pairs cell."""
    rows = [(0, i, (i * 37 % 101) / 10.0, (i * 53 % 97) / 10.0) for i in range(300)] + [(0, 300, 1e6, 1e6)]
    pts = spark.createDataFrame(rows, "g int, pid int, x double, y double")
    asked = [(0, 0, 4.0, 4.0), (0, 1, 9e5, 9e5)]
    qs = spark.createDataFrame(asked, "g int, qid int, x double, y double")
    got = nearest(qs, pts, by=["g"], coords=["x", "y"], query_id="qid", point_id="pid", k=1, leaf=16).collect()
    best = {q: min(((x - a) ** 2 + (y - b) ** 2, p) for _, p, a, b in rows)[1] for _, q, x, y in asked}
    assert {r.qid: r.pid for r in got} == best


def test_boxes_of_any_size_and_up_axis(spark):
    """One box of kilometres beside small ones touches few cells; z-up boxes give the same rows."""
    rnd = random.Random(9)
    inf, nan = float("inf"), float("nan")
    data = boxes(30, 8) + [
        (0, 100, [5.0, 0.5, 5.0, 4000.0, 9.0, 4000.0, 0.3]),
        (0, 101, [5.0, 0.5, 5.0, 60.0, 9.0, 1.0, 1.1]),
        (0, 102, [5.0, 0.5, 5.0, inf, 1.0, 1.0, 0.0]),
        (0, 103, [nan, 0.5, 5.0, 1.0, 1.0, 1.0, 0.0]),
        (0, 104, None),
    ]
    pts = [(i % 3, i, rnd.uniform(0, 12), rnd.uniform(0, 1), rnd.uniform(0, 12)) for i in range(200)]
    pts.append((0, 999, 1500.0, 1.0, 1200.0))

    def turned(b):
        return b and [b[0], b[2], b[1], b[3], b[5], b[4], b[6]]

    shape = "frame int, rec int, box array<double>"
    d = spark.createDataFrame(data, shape)
    z = spark.createDataFrame([(f, i, turned(b)) for f, i, b in data], shape)
    both = [
        sorted((r["rec_a"], r["rec_b"], round(r["iou"], 9)) for r in pairwise_iou(x, x, "frame", ("rec", "rec"), once=True, up=up).collect())
        for x, up in ((d, 1), (z, 2))
    ]
    assert both[0] == both[1]
    assert all(a < b for a, b, _ in both[0])
    inside = {b for a, b, _ in both[0] if b == 100}
    assert inside == {100} and sum(b == 100 for _, b, _ in both[0]) == sum(f == 0 and i < 100 for f, i, _ in data)
    assert not {102, 103, 104} & {x for a, b, _ in both[0] for x in (a, b)}
    names = "frame int, idx int, x double, y double, z double"
    p = spark.createDataFrame(pts, names)
    q = spark.createDataFrame([(f, i, x, h, y) for f, i, x, y, h in pts], names)
    got = [
        sorted((r["idx"], r["rec"]) for r in points_in_box(x, b, "frame", "rec", 0.1, up=up).collect())
        for x, b, up in ((p, d, 1), (q, z, 2))
    ]
    assert got[0] == got[1] and (999, 100) in got[0]


def test_corners_of_z_up_boxes(spark):
    from pyspark.sql import functions as F

    from tallyfield.functions.boxes import bev_corners, box_corners

    box = [1.0, 2.0, 3.0, 4.0, 2.0, 1.5, 0.7]
    d = spark.createDataFrame([(box,)], "box array<double>")
    r = d.select(bev_corners(F.col("box"), 2).alias("g"), box_corners(F.col("box"), 2).alias("c")).first()
    c, s = np.cos(0.7), np.sin(0.7)
    want = [(1 + c * a - s * b, 2 + s * a + c * b) for a, b in ((-2, -1), (2, -1), (2, 1), (-2, 1))]
    assert np.allclose(r["g"], want)
    assert np.allclose(sorted({round(p[2], 9) for p in r["c"]}), [2.25, 3.75])
    assert {(round(p[0], 6), round(p[1], 6)) for p in r["c"]} == {(round(a, 6), round(b, 6)) for a, b in want}


def test_copies_are_counted_in_boxes_once(spark):
    rnd = random.Random(4)
    pts = [(rnd.randrange(2), rnd.randrange(40) / 10, rnd.randrange(3) / 2, rnd.randrange(30) / 10) for _ in range(400)] * 3
    kinds = [[rnd.uniform(0, 4), 0.5, rnd.uniform(0, 3), 1.5, 1.0, 0.8, rnd.uniform(0, 3)] for _ in range(6)]
    boxes = [(i, i % 2, kinds[i % 6]) for i in range(24)] + [(99, 0, [float("nan"), *kinds[0][1:]]), (100, 5, kinds[0])]
    p = spark.createDataFrame(pts, "frame int, x double, y double, z double")
    b = spark.createDataFrame(boxes, "rec int, frame int, box array<double>")
    pairs = points_in_box(p, b, "frame", "rec", 0.1).groupBy("rec").count()
    got = {r["rec"]: r["n"] for r in count_in_boxes(p, b, "frame", "rec", 0.1).collect()}
    assert got == {r["rec"]: r["count"] for r in pairs.collect()} and len(got) > 12


def test_first_k_of_equal_distances():
    rnd = np.random.default_rng(1)
    for n, k in ((50, 4), (4, 4), (3, 4), (30, 1)):
        d = rnd.integers(0, 5, (20, n)).astype(float)
        assert (_first_k(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_small_groups_go_to_python_together(spark):
    """One call of Python per bundle of rows, not one per group."""
    rows = spark.range(900).selectExpr("id % 300 AS g", "id", "CAST(id * 7919 % 101 AS DOUBLE) AS x")
    found = nearest(rows, rows.withColumnRenamed("id", "to"), by=["g"], coords=["x"], query_id="id", point_id="to")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "_bundle" in plan
    assert {(r["id"], r["to"], r["distance"]) for r in found.collect()} == {(i, i, 0.0) for i in range(900)}
