"""Analytic cases of cameras, rotations, frames, boxes, sweeps and meshes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polygons import ground_overlap
from tallyfield.functions import boxes as B
from tallyfield.functions import camera as C
from tallyfield.functions import scan as S
from tallyfield.functions import vectors as V
from tallyfield.functions.vectors import vec
from tallyfield.operators import evaluation as E
from tallyfield.operators import mesh as M
from tallyfield.operators import points as O


def test_projection_round_trip_and_behind(one):
    cam = C.camera(F.lit(300.0), F.lit(310.0), F.lit(128.0), F.lit(120.0))
    uv = one(C.project(vec(0.4, -0.2, 5.0), cam))
    back = one(C.unproject(F.lit(uv[0]), F.lit(uv[1]), F.lit(5.0), cam))
    assert back == pytest.approx([0.4, -0.2, 5.0])
    assert one(C.project(vec(0.4, -0.2, -5.0), cam)) is None
    assert one(C.project_clamped(vec(0.0, 0.0, -5.0), cam)) == [128.0, 120.0]


def test_fov_camera(one):
    cam = one(C.camera_from_hfov(F.lit(90.0), F.lit(640), F.lit(480)))
    assert cam["fx"] == pytest.approx(320.0) and cam["cx"] == 319.5


def test_inverse_transform(one):
    m = V.se3(V.rotvec_to_matrix(vec(0.3, -0.5, 0.2)), vec(1.0, 2.0, 3.0))
    same = one(V.se3_mul(V.se3_inv(m), m))
    assert np.allclose(np.array(same).reshape(4, 4), np.eye(4), atol=1e-12)


@pytest.mark.parametrize("v", [(0.0, 0.0, 0.0), (0.1, -0.2, 0.3), (math.pi, 0.0, 0.0), (0.0, 2.0, -2.0)])
def test_rotation_vector_round_trip(spark, v):
    d = spark.range(1).select(V.rotvec_to_matrix(vec(*v)).alias("r"))
    out = d.select(V.matrix_to_rotvec(F.col("r")).alias("v"), V.rotation_angle(F.col("r")).alias("a")).first()
    assert np.linalg.norm(out["v"]) == pytest.approx(np.linalg.norm(v), abs=1e-6)
    assert np.allclose(np.abs(out["v"]), np.abs(v), atol=1e-6)


def test_reflection_is_not_rigid(one):
    flip = vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    eye = vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    zero = vec(0.0, 0.0, 0.0)
    assert one(V.check_rigid(V.se3(flip, zero)), V.check_rigid(V.se3(eye, zero))) == (False, True)


def iou(spark, a, b):
    d = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return d.select(B.iou3d("a", "b")).first()[0]


def test_overlap_of_boxes(spark):
    base = [0.0, 0.0, 5.0, 2.0, 2.0, 2.0, 0.0]
    assert iou(spark, base, base) == pytest.approx(1.0)
    assert iou(spark, base, [9.0, *base[1:]]) == 0.0
    assert iou(spark, base, [1.0, *base[1:]]) == pytest.approx(1 / 3)
    turned = [*base[:6], math.pi / 2]
    assert iou(spark, base, turned) == pytest.approx(1.0)
    diamond = [*base[:6], math.pi / 4]
    inter = 8 * (math.sqrt(2) - 1) * 2
    assert iou(spark, base, diamond) == pytest.approx(inter / (16 - inter))
    same = [0.3, 0.0, 5.0, 1.0, 1.8, 0.6, 0.7]
    assert iou(spark, same, same) == pytest.approx(1.0)


def test_overlap_equals_polygons(spark):
    rnd = np.random.default_rng(2)
    pairs = []
    for i in range(600):
        a = [*rnd.uniform(-1, 1, 3), *rnd.uniform(0.2, 3, 3), rnd.uniform(-4, 4)]
        b = [*rnd.uniform(-1, 1, 3), *rnd.uniform(0.2, 3, 3), rnd.uniform(-4, 4)]
        if i % 4 == 1:  # sides along each other, some shared
            b = [a[0] + rnd.choice([0.0, a[3], -a[3] / 2]), a[1], a[2], *a[3:6], a[6] * 0 + rnd.choice([0, math.pi / 2, math.pi])]
            a[6] = 0.0
        if i % 4 == 2:  # the same, or nearly
            b = [*a[:6], a[6] + rnd.choice([0.0, 1e-12, 1e-7, math.pi])]
        pairs.append((list(map(float, a)), list(map(float, b))))
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<double>, b array<double>")
    got = d.select("i", B.ground_overlap(F.col("a"), F.col("b")).alias("s"), B.iou3d("a", "b").alias("iou")).orderBy("i").collect()
    a, b = (np.array([p[k] for p in pairs]) for k in (0, 1))
    assert np.allclose([r["s"] for r in got], ground_overlap(a, b), atol=2e-6)
    assert all(0 <= r["iou"] <= 1 + 1e-9 for r in got)
    none = spark.createDataFrame([(None, [0.0] * 7)], "a array<double>, b array<double>")
    assert none.select(B.iou3d("a", "b")).first()[0] is None
    assert "Python" not in d.select(B.iou3d("a", "b"))._jdf.queryExecution().executedPlan().toString()


def test_oriented_box_is_recovered(spark):
    yaw = 0.4
    c, s = math.cos(yaw), math.sin(yaw)
    pts = []
    for a in (-1.0, 1.0):
        for y in (-0.9, 0.9):
            for b in (-0.3, 0.3):
                pts.append((0, 1 + c * a - s * b, 0.5 + y, 8 + s * a + c * b))
    d = spark.createDataFrame(pts, "cloud int, x double, y double, z double")
    r = E.oriented_box(d, ["cloud"], F.lit(yaw)).first()
    got = [r[k] for k in ("cx", "cy", "cz", "dx", "dy", "dz", "yaw")]
    assert got == pytest.approx([1.0, 0.5, 8.0, 2.0, 1.8, 0.6, yaw])


def test_sweep_times(one):
    t = one(S.column_times(F.lit(45.0), F.lit(-45.0), F.lit(45.0), 10.0, reference="start"))
    assert t == pytest.approx(0.025)
    shift = []
    for az in (-45.0, 45.0):
        t = S.column_times(F.lit(az), F.lit(-45.0), F.lit(45.0))
        shift.append(one(S.motion_distort(vec(0.0, 0.0, 10.0), t, vec(0.0, 0.0, 10.0))[2]) - 10)
    assert shift == pytest.approx([0.125, -0.125])


def test_azimuth_window_of_a_centred_sensor(spark):
    cam = C.camera_from_hfov(F.lit(90.0), F.lit(640), F.lit(480))
    eye = V.se3(vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), vec(0.0, 0.0, 0.0))
    d = spark.range(1).select(cam.alias("c"), eye.alias("p"))
    w = d.select(
        S.azimuth_window(
            F.col("c"), F.lit(640.0), F.lit(480.0), F.col("p"), F.lit(0.5), F.lit(75.0), F.lit(1024)
        ).alias("w")
    ).first()["w"]
    assert w["columns"] == 256
    assert w["az_min"] == pytest.approx(-45, abs=0.1) and w["az_max"] == pytest.approx(45, abs=0.1)


def test_depth_moves_back(spark):
    px = [(0, u, v, 5.0 if 180 <= u < 220 and 100 <= v < 200 else 20.0) for u in range(100, 300) for v in range(50, 250)]
    d = spark.createDataFrame(px, "frame int, u int, v int, z double")
    out = O.reproject_depth(d, "frame", 5.0, 199.5, 149.5, 400, 300)
    near = out.where("z = 5.0 AND visible")
    assert near.agg(F.min("z2"), F.max("z2")).first()[:] == (10.0, 10.0)
    assert near.select("u2").distinct().count() == pytest.approx(20, abs=1)
    assert out.where("z = 20.0").agg(F.max("z2")).first()[0] == 25.0


def test_pillars(spark):
    pts = [(0, 0, 1.0, 1.0, 0.0), (0, 1, 1.1, 1.1, 0.0), (0, 2, 3.0, 1.0, 0.0), (0, 3, 99.0, 0.0, 0.0),
           (1, 0, 1.0, 1.0, 0.0), (1, 1, 1.1, 1.0, 9.0)]
    d = spark.createDataFrame(pts, "cloud int, idx int, x double, y double, z double")
    v = O.voxelize(d, "cloud", "idx", (0.0, 4.0), (0.0, 4.0), (-1.0, 3.0))
    counts = sorted((r["cloud"], r["n"]) for r in O.pillar_counts(v, "cloud").collect())
    assert counts == [(0, 1), (0, 2), (1, 2)]
    assert v.agg(F.max("z")).first()[0] == pytest.approx(2.999)


def sphere(n=8, m=12):
    verts, faces = [(0.0, -1.0, 0.0)], []
    for i in range(1, n):
        for j in range(m):
            t, p = math.pi * i / n, 2 * math.pi * j / m
            verts.append((math.sin(t) * math.cos(p), -math.cos(t), math.sin(t) * math.sin(p)))
    verts.append((0.0, 1.0, 0.0))

    def at(i, j):
        return 1 + (i - 1) * m + j % m

    for j in range(m):
        faces.append((0, at(1, j), at(1, j + 1)))
        faces.append((len(verts) - 1, at(n - 1, j + 1), at(n - 1, j)))
        for i in range(1, n - 1):
            faces.append((at(i, j), at(i + 1, j), at(i + 1, j + 1)))
            faces.append((at(i, j), at(i + 1, j + 1), at(i, j + 1)))
    v = np.array(verts)
    out = []
    for f in faces:
        a, b, c = v[list(f)]
        out.append(f if np.dot(np.cross(b - a, c - a), (a + b + c)) > 0 else f[::-1])
    return verts, out


@pytest.fixture(scope="module")
def ball(spark):
    verts, faces = sphere()
    row = (0, [list(map(float, v)) for v in verts], [list(f) for f in faces], [0.0, 0.0, -10.0])
    return spark.createDataFrame(
        [row], "mesh int, verts array<array<double>>, faces array<array<int>>, origin array<double>"
    )


def test_facing_half(ball):
    verts, _ = sphere()
    seen = {r["vertex"] for r in M.facing_vertices(ball, "mesh").collect()}
    assert all(i in seen for i, v in enumerate(verts) if v[2] < -0.5)
    assert all(i not in seen for i, v in enumerate(verts) if v[2] > 0.6)


def test_normals_point_outwards(ball):
    verts, _ = sphere()
    for r in M.offset(ball, "mesh", 0.1).collect():
        p = np.array([r["x"], r["y"], r["z"]])
        assert np.linalg.norm(p) == pytest.approx(1.1, abs=0.01)
        assert np.dot(p, verts[r["vertex"]]) > 0


def test_mesh_terms(spark, ball):
    grown = F.transform("verts", lambda p: F.array(p[0] * 1.1, p[1] * 1.1, p[2] * 1.1))
    zero = vec(0.0, 0.0, 0.0)
    d = ball.select("verts", grown.alias("big"), "faces")
    v = F.col("verts")
    same = d.select(M.mesh_diff(v, v, F.col("faces"), zero, zero).alias("d")).first()["d"]
    assert same["vertex"] == 0 and same["edge"] == 0 and same["normal"] == pytest.approx(0, abs=1e-9)
    more = d.select(M.mesh_diff(v, F.col("big"), F.col("faces"), zero, zero).alias("d")).first()["d"]
    assert more["vertex"] > 0.01 and more["edge"] > 0.01 and more["normal"] == pytest.approx(0, abs=1e-9)


def test_icp_finds_a_shift(spark):
    rng = np.random.default_rng(0)
    verts = rng.uniform(-1, 1, (80, 3))
    pts = verts + [0.05, -0.02, 0.03]
    v = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(verts)], "rec int, v int, x double, y double, z double")
    p = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(pts)], "rec int, p int, x double, y double, z double")
    moved = M.icp_residual(p, v, "rec", ("p", "v"), 4).first()["moved_m"]
    assert moved == pytest.approx(np.linalg.norm([0.05, -0.02, 0.03]), abs=0.005)


def test_robust_registration_equals_numpy(spark):
    rng = np.random.default_rng(4)
    points, verts, facing, want = [], [], [], {}
    for rec in range(20):
        v = rng.uniform(-1, 1, (60, 3))
        seen = np.sort(rng.choice(60, 40, replace=False))
        a = rng.uniform(-0.1, 0.1)
        turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        p = v[seen] @ turn.T + rng.uniform(-0.05, 0.05, 3)
        p[:6] += rng.uniform(1, 3, (6, 3))  # outliers
        points += [(rec, i, *map(float, x)) for i, x in enumerate(p)]
        verts += [(rec, i, *map(float, x)) for i, x in enumerate(v)]
        facing += [(rec, int(i)) for i in seen]
        r, t, s = np.eye(3), np.zeros(3), v[seen]
        for _ in range(4):
            d = np.linalg.norm((s @ r.T + t)[None] - p[:, None], axis=2)
            src, w = s[d.argmin(1)], np.minimum(1, 0.05 / np.maximum(d.min(1), 1e-12))[:, None]
            ms, mp = (w * src).sum(0) / w.sum(), (w * p).sum(0) / w.sum()
            u, _, vt = np.linalg.svd((w * (p - mp)).T @ (src - ms) / w.sum() + 1e-8 * np.eye(3))
            r = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
            t = mp - r @ ms
        want[rec] = (r, t, np.linalg.norm(s @ r.T + t - s, axis=1).mean(), turn)
    p = spark.createDataFrame(points, "rec int, p int, x double, y double, z double")
    v = spark.createDataFrame([*verts, (99, 0, 0.0, 0.0, 0.0)], "rec int, v int, x double, y double, z double")
    f = spark.createDataFrame([*facing, (99, 0)], "rec int, v int")
    pose = {r["rec"]: r for r in M.registered(p, v, "rec", ("p", "v"), 4, f, 0.05).collect()}
    moved = {r["rec"]: r["moved_m"] for r in M.icp_residual(p, v, "rec", ("p", "v"), 4, f, 0.05).collect()}
    assert moved.pop(99) == 0 and set(moved) == set(want)
    for rec, (r, t, way, turn) in want.items():
        assert np.allclose(np.reshape(pose[rec]["r"], (3, 3)), r, atol=1e-6) and np.allclose(pose[rec]["t"], t, atol=1e-6)
        assert moved[rec] == pytest.approx(way, abs=1e-6)
    # outliers are a sixth of the returns and hardly turn the result
    assert np.median([np.abs(w[0] - w[3]).max() for w in want.values()]) < 0.03


def test_rotation_prior(spark):
    data = [(0, float(a)) for a in (-0.2, -0.1, 0.0, 0.1, 0.2)]
    d = spark.createDataFrame(data, "joint int, a double").select("joint", V.yaw_matrix(F.col("a")).alias("r"))
    r = M.rotation_prior(d, "joint", "r").first()
    assert np.allclose(np.array(r["mean"]).reshape(3, 3), np.eye(3), atol=1e-9)
    assert r["sigma"] == pytest.approx(math.sqrt(0.02))


def test_weak_perspective_and_raw_position(one):
    k = C.camera(F.lit(300.0), F.lit(300.0), F.lit(128.0), F.lit(128.0))
    t = one(C.weak_persp_to_transl(vec(1.0, 0.1, 0.2), vec(128.0, 128.0), F.lit(200.0), k))
    assert t == pytest.approx([0.1, 0.2, 3.0], abs=1e-6)
    assert one(C.raw_to_transl(vec(0.0, 0.0, math.log(4.0)), k, 256.0)) == pytest.approx([0.0, 0.0, 4.0])


@pytest.mark.parametrize("query", ["azimuth_windows", "turned_overlap", "best_cameras", "box_overlap"])
def test_costly_rows_of_one_file_are_spread(spark, tmp_path, query):
    from tallyfield.plans import load_all

    parts = spark.range(200).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    found = load_all()[0][query](spark, str(tmp_path))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_planar_registration_runs_once(spark, tmp_path, monkeypatch):
    from tallyfield.plans import geometry

    calls = []
    real = geometry.M.registered
    monkeypatch.setattr(geometry.M, "registered", lambda *a: calls.append(1) or real(*a))
    geometry.icp_planar(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
