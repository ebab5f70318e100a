"""Geometry queries: cameras, rotations, frames, sweeps, meshes, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import boxes as B
from tallyfield.functions import camera as C
from tallyfield.functions import pose as P
from tallyfield.functions import scan as S
from tallyfield.functions import vectors as V
from tallyfield.functions.vectors import vec
from tallyfield.operators import mesh as M
from tallyfield.operators import points as O
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query
from tallyfield.session import spread


def _r(col, n=5):
    return F.round(col, n)


def _xyz(df):
    return vec(F.col("x"), F.col("y"), F.col("z"))


@query(
    "points_projected",
    """SELECT idx, round(300*(xn*g + 2*0.001*xn*yn + 0.002*(r2+2*xn*xn)) + 128, 4) AS u,
  round(280*(yn*g + 0.001*(r2+2*yn*yn) + 2*0.002*xn*yn) + 120, 4) AS v FROM (
 SELECT *, 1 + 0.01*r2 + 0.002*r2*r2 + 0.0003*r2*r2*r2 AS g FROM (SELECT idx, x/z AS xn, y/z AS yn, (x/z)*(x/z)+(y/z)*(y/z) AS r2
 FROM fx_points WHERE z > 5))""",
    views=("fx_points",),
)
def points_projected(spark, sf):
    d = fx.points(spark, sf)
    cam = C.camera(F.lit(300.0), F.lit(280.0), F.lit(128.0), F.lit(120.0))
    uv = C.project(_xyz(d), cam, 5.0, (0.01, 0.002, 0.001, 0.002, 0.0003))
    d = d.select("idx", uv.alias("uv")).where(F.col("uv").isNotNull())
    return d.select("idx", _r(F.col("uv")[0], 4).alias("u"), _r(F.col("uv")[1], 4).alias("v"))


@query(
    "pixels_unprojected",
    "SELECT idx, round((col - 128)/300.0*z, 5) AS x, round((channel*30 - 120)/280.0*z, 5) AS y FROM fx_points",
    views=("fx_points",),
)
def pixels_unprojected(spark, sf):
    d = fx.points(spark, sf)
    cam = C.camera(F.lit(300.0), F.lit(280.0), F.lit(128.0), F.lit(120.0))
    p = C.unproject(F.col("col"), F.col("channel") * 30, F.col("z"), cam)
    return d.select("idx", _r(p[0]).alias("x"), _r(p[1]).alias("y"))


@query(
    "cameras_from_fov",
    """SELECT rec, round((320/tan(radians(40 + rec % 60)/2) )*s, 4) AS fx, round((319.5 - x0)*s, 4) AS cx, round(239.5 - y0, 4) AS cy FROM (
 SELECT rec, cx*10 - side/2 AS x0, cy*10 - side/2 AS y0, 256/side AS s FROM (SELECT *, greatest(dx, dz)*10*1.2 AS side FROM fx_boxes))""",
    views=("fx_boxes",),
)
def cameras_from_fov(spark, sf):
    d = fx.boxes(spark, sf)
    b = C.centre_to_corners(F.col("cx") * 10, F.col("cy") * 10, F.col("dx") * 10, F.col("dz") * 10)
    cam = C.camera_from_hfov(40 + F.col("rec") % 60, F.lit(640), F.lit(480))
    d = d.select("rec", cam.alias("cam"), C.square_crop(b).alias("crop"))
    d = d.select("rec", "cam", "crop", C.crop_camera(F.col("cam"), F.col("crop")).alias("k"))
    shifted = C.shift_camera(F.col("cam"), F.col("crop.x0"), F.col("crop.y0"))
    return d.select(
        "rec", _r("k.fx", 4).alias("fx"), _r("k.cx", 4).alias("cx"), _r(shifted["cy"], 4).alias("cy")
    )


@query(
    "pixels_in_crop",
    """SELECT rec, round((cx*10 - (cx*10 - side/2))*256/side, 4) AS u, round(dx*10, 5) AS w, false AS portrait FROM
 (SELECT *, greatest(dx, dz)*10*1.2 AS side FROM fx_boxes)""",
    views=("fx_boxes",),
)
def pixels_in_crop(spark, sf):
    d = fx.boxes(spark, sf)
    b = C.centre_to_corners(F.col("cx") * 10, F.col("cy") * 10, F.col("dx") * 10, F.col("dz") * 10)
    d = d.select("rec", "cx", "cy", b.alias("b")).withColumn("crop", C.square_crop(F.col("b")))
    uv = C.to_crop(F.array(F.col("cx") * 10, F.col("cy") * 10), F.col("crop"))
    back = C.corners_to_centre(F.col("b"))
    cam = C.camera(F.lit(1.0), F.lit(1.0), F.lit(320.0), F.lit(240.0))
    return d.select(
        "rec", _r(uv[0], 4).alias("u"), _r(back[2]).alias("w"), C.is_portrait(cam).alias("portrait")
    )


@query(
    "camera_translations",
    """SELECT rec, round(score + 2*(cx*10 - 128)/(200*(1+score)+1e-9), 5) AS wx, round(2*300/(200*(1+score)+1e-9), 5) AS wz,
  round((score*128)/300*exp(2+score), 4) AS rx, round(exp(2+score), 4) AS rz FROM fx_boxes""",
    views=("fx_boxes",),
)
def camera_translations(spark, sf):
    d = fx.boxes(spark, sf)
    k = C.camera(F.lit(300.0), F.lit(300.0), F.lit(128.0), F.lit(120.0))
    s = F.col("score")
    w = C.weak_persp_to_transl(vec(1 + s, s, s), vec(F.col("cx") * 10, 5.0), F.lit(200.0), k)
    t = C.raw_to_transl(vec(s, s, 2 + s), k, 256.0)
    return d.select(
        "rec", _r(w[0]).alias("wx"), _r(w[2]).alias("wz"), _r(t[0], 4).alias("rx"), _r(t[2], 4).alias("rz")
    )


@query(
    "frames_composed",
    """SELECT idx, round(cos(a)*x - sin(a)*z + 3, 5) AS x1, round(sin(a)*x + cos(a)*z - 1, 5) AS z1, round(x, 5) AS back
 FROM (SELECT *, (channel)/5.0E0 AS a FROM fx_points)""",
    views=("fx_points",),
)
def frames_composed(spark, sf):
    d = fx.points(spark, sf)
    m = V.se3(V.yaw_matrix(F.col("channel") / F.lit(5.0)), vec(3.0, 0.0, -1.0))
    d = d.select("idx", _xyz(d).alias("p"), m.alias("m"))
    d = d.withColumn("q", V.se3_apply(F.col("m"), F.col("p")))
    d = d.withColumn("same", V.se3_mul(V.se3_inv(F.col("m")), F.col("m")))
    back = V.se3_apply(V.se3_inv(F.col("m")), V.se3_apply(F.col("same"), F.col("q")))
    return d.select(
        "idx", _r(F.col("q")[0]).alias("x1"), _r(F.col("q")[2]).alias("z1"), _r(back[0]).alias("back")
    )


@query(
    "rigid_poses",
    "SELECT rec, rec % 4 IN (0, 1) AS rigid FROM fx_boxes",
    views=("fx_boxes",),
)
def rigid_poses(spark, sf):
    d = fx.boxes(spark, sf)
    k = F.col("rec") % 4
    a = F.col("score")
    scale = F.when(k == 2, 1.01).otherwise(1.0)
    flip = F.when(k == 3, -1.0).otherwise(1.0)
    r = vec(F.cos(a) * scale, 0.0, -F.sin(a), 0.0, flip, 0.0, F.sin(a), 0.0, F.cos(a))
    return d.select("rec", V.check_rigid(V.se3(r, vec(a, a, a))).alias("rigid"))


@query(
    "quaternion_frames",
    """SELECT rec, round(1 - 2*(y*y + z*z), 5) AS r00, round(2*(x*y - z*w), 5) AS r01, round(2*(y*z + x*w), 5) AS r21 FROM (
 SELECT rec, 1/n AS w, a/n AS x, b/n AS y, 2*a/n AS z FROM (SELECT rec, score AS a, cx/10 AS b, sqrt(1+5*score*score+cx*cx/100) AS n FROM fx_boxes))""",
    views=("fx_boxes",),
)
def quaternion_frames(spark, sf):
    a, b = F.col("score"), F.col("cx") / 10
    m = V.quat_to_matrix(vec(1.0, a, b, 2 * a))
    last = V.quat_to_matrix(vec(a, b, 2 * a, 1.0), scalar_last=True)
    return fx.boxes(spark, sf).select(
        "rec", _r(m[0]).alias("r00"), _r(m[1]).alias("r01"), _r(last[7]).alias("r21")
    )


@query(
    "rotation_angles",
    """SELECT rec, round(t, 5) AS angle, round(v0, 5) AS v0, round(t/2, 5) AS half FROM (SELECT rec,
  sqrt(score*score + 0.25 + 0.09) AS t, score AS v0 FROM fx_boxes)""",
    views=("fx_boxes",),
)
def rotation_angles(spark, sf):
    s = F.col("score")
    d = fx.boxes(spark, sf).select(
        "rec",
        V.rotvec_to_matrix(vec(s, 0.5, 0.3)).alias("r"),
        V.rotvec_to_matrix(vec(s / 2, 0.25, 0.15)).alias("h"),
    )
    r = F.col("r")
    return d.select(
        "rec",
        _r(V.rotation_angle(r)).alias("angle"),
        _r(V.matrix_to_rotvec(r)[0]).alias("v0"),
        _r(V.geodesic(r, F.col("h"))).alias("half"),
    )


@query(
    "headings",
    "SELECT rec, round(atan2(cz, cx), 5) AS yaw, round(atan2(sin(score), cos(score)), 5) AS turned FROM fx_boxes",
    views=("fx_boxes",),
)
def headings(spark, sf):
    d = fx.boxes(spark, sf)
    m = V.yaw_matrix(F.col("score"))
    return d.select(
        "rec",
        _r(V.heading_yaw(vec(F.col("cx"), F.col("cy"), F.col("cz")))).alias("yaw"),
        _r(V.matrix_yaw(m)).alias("turned"),
    )


@query(
    "box_corners",
    """SELECT rec, round(cx - cos(s)*dx/2 + sin(s)*dz/2, 5) AS x0, round(cz - sin(s)*dx/2 - cos(s)*dz/2, 5) AS z0,
  round(cx - cos(s)*dx/2 + sin(s)*dz/2, 5) AS b0, 8 AS n FROM (SELECT *, score AS s FROM fx_boxes)""",
    views=("fx_boxes",),
)
def box_corners(spark, sf):
    d = fx.boxes(spark, sf)
    box = vec(*[F.col(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz", "score")])
    d = d.select("rec", B.box_corners(box).alias("c"), B.bev_corners(box).alias("b"))
    c = F.col("c")
    return d.select(
        "rec", _r(c[0][0]).alias("x0"), _r(c[0][2]).alias("z0"), _r(F.col("b")[0][0]).alias("b0"), F.size("c").alias("n")
    )


@query(
    "boxes_in_camera",
    """SELECT rec, round(-cy, 5) AS x, round(-cz, 5) AS y, round(cx, 5) AS z, round(dy, 5) AS dx, round(dz, 5) AS dy, round(dx, 5) AS dz,
  round(atan2(cos(score), -sin(score)), 5) AS yaw FROM fx_boxes""",
    views=("fx_boxes",),
)
def boxes_in_camera(spark, sf):
    d = fx.boxes(spark, sf)
    turn = vec(0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 1.0, 0.0, 0.0)
    m = V.se3(turn, vec(0.0, 0.0, 0.0))
    b = B.box_to_frame(
        vec(F.col("cx"), F.col("cy"), F.col("cz")),
        vec(F.col("dx"), F.col("dy"), F.col("dz")),
        F.col("score"),
        m,
    )
    names = ("x", "y", "z", "dx", "dy", "dz", "yaw")
    return d.select("rec", *[(_r(b[i])).alias(n) for i, n in enumerate(names)])


@query(
    "axes_remapped",
    "SELECT idx, -y AS x, -z AS y, x AS z, x AS back FROM fx_points",
    views=("fx_points",),
)
def axes_remapped(spark, sf):
    d = fx.points(spark, sf)
    p = V.remap_axes(_xyz(d), V.CAMERA_FROM_FORWARD_LEFT_UP)
    back = V.remap_axes(p, V.FORWARD_LEFT_UP_FROM_CAMERA)
    return d.select("idx", p[0].alias("x"), p[1].alias("y"), p[2].alias("z"), back[0].alias("back"))


@query(
    "bodies_in_world",
    """SELECT rec, round(0.4 + score, 5) AS angle, round(cos(0.4)*(0.1+cx) - sin(0.4)*(0.3+cz) + 1 - 0.1, 5) AS tx,
  round(sin(0.4)*(0.1+cx) + cos(0.4)*(0.3+cz) + 3 - 0.3, 5) AS tz FROM fx_boxes""",
    views=("fx_boxes",),
)
def bodies_in_world(spark, sf):
    m = V.se3(V.yaw_matrix(F.lit(0.4)), vec(1.0, 2.0, 3.0))
    d = fx.boxes(spark, sf).select(
        "rec",
        vec(0.0, -F.col("score"), 0.0).alias("global_orient"),
        vec(F.col("cx"), F.col("cy"), F.col("cz")).alias("transl"),
        vec(0.1, 0.2, 0.3).alias("pelvis"),
        m.alias("pose"),
    )
    d = M.transform_body(d, "pose")
    return d.select(
        "rec",
        _r(-F.col("global_orient")[1]).alias("angle"),
        _r(F.col("transl")[0]).alias("tx"),
        _r(F.col("transl")[2]).alias("tz"),
    )


@query(
    "mirrored_back",
    """SELECT j.rec, round(-k.x, 5) AS x, round(k.y, 5) AS y, -0.2E0 AS ry FROM fx_joints j JOIN fx_joints k ON k.rec = j.rec AND k.joint = 20 - j.joint
 WHERE j.joint = 3""",
    views=("fx_joints",),
)
def mirrored_back(spark, sf):
    d = fx.joints(spark, sf)
    partner = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: 20 - i)
    v = P.mirror_back(F.col("gt"), partner)
    turn = P.mirror_orient(vec(0.1, 0.2, 0.3))
    return d.select("rec", _r(v[3][0]).alias("x"), _r(v[3][1]).alias("y"), turn[1].alias("ry"))


@query(
    "sweep_distortion",
    """SELECT idx, round(t, 6) AS t, round(cos(-w)*(x - 10*t) - sin(-w)*z, 5) AS x1, round(sin(-w)*(x-10*t) + cos(-w)*z, 5) AS z1 FROM (
 SELECT *, radians(20*t) AS w FROM (SELECT *, ((az + 406) % 360)/360*0.1E0 - 46/360.0E0*0.1E0 AS t FROM (SELECT *, degrees(atan2(x, z)) AS az FROM fx_points)))""",
    views=("fx_points",),
)
def sweep_distortion(spark, sf):
    d = fx.points(spark, sf).withColumn("az", F.degrees(F.atan2("x", "z")))
    d = d.withColumn("t", S.column_times(F.col("az"), F.lit(-46.0), F.lit(46.0), 10.0))
    p = S.motion_distort(_xyz(d), F.col("t"), vec(10.0, 0.0, 0.0), 20.0)
    return d.select("idx", _r("t", 6).alias("t"), _r(p[0]).alias("x1"), _r(p[2]).alias("z1"))


@query(
    "azimuth_windows",
    """SELECT rec, round(h, 5) AS hfov, round(az0 + min(rel), 5) AS az_min, round(az0 + max(rel), 5) AS az_max, CAST(round_even(h/360*1024, 0) AS BIGINT) AS "columns" FROM (
 SELECT rec, h, az0, (degrees(atan2((s.side + 0.5E0/320)*tan(radians(h/2))*z - score, z)) - az0 + 540) % 360 - 180 AS rel FROM (
  SELECT rec, score, CAST(40 + rec % 60 AS DOUBLE) AS h, degrees(atan2(-score, (0.5E0*pow(150.0E0, 15/31.0E0) + 0.5E0*pow(150.0E0, 16/31.0E0))/2)) AS az0 FROM fx_boxes)
 CROSS JOIN (SELECT 0.5E0*pow(150.0E0, range/31.0E0) AS z FROM range(32)) CROSS JOIN (VALUES (-1), (1)) AS s(side)) GROUP BY rec, h, az0""",
    views=("fx_boxes",),
)
def azimuth_windows(spark, sf):
    d = spread(fx.boxes(spark, sf))
    cam = C.camera_from_hfov(40 + F.col("rec") % 60, F.lit(640), F.lit(480))
    eye = vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    d = d.select("rec", cam.alias("cam"), V.se3(eye, vec(F.col("score"), 0.0, 0.0)).alias("pose"))
    w = S.azimuth_window(
        F.col("cam"), F.lit(640.0), F.lit(480.0), F.col("pose"), F.lit(0.5), F.lit(75.0), F.lit(1024)
    )
    d = d.select("rec", w.alias("w"))
    return d.select("rec", _r("w.hfov").alias("hfov"), _r("w.az_min").alias("az_min"), _r("w.az_max").alias("az_max"), "w.columns")


@query(
    "virtual_distance",
    "SELECT idx, round((z+10)/z, 6) AS factor, round(z/(z+10), 6) AS shrink FROM fx_points",
    views=("fx_points",),
)
def virtual_distance(spark, sf):
    z = F.col("z")
    return fx.points(spark, sf).select(
        "idx", _r(S.distance_factor(z, 10.0), 6).alias("factor"), _r(S.shrink_factor(z, 10.0), 6).alias("shrink")
    )


@query(
    "fourier_features",
    "SELECT idx, x AS c0, round(sin(x*pi()), 5) AS s0, round(cos(x*2*pi()), 5) AS c1, 15 AS n FROM fx_points",
    views=("fx_points",),
)
def fourier_features(spark, sf):
    d = fx.points(spark, sf)
    f = d.select("idx", S.fourier(F.array("x", "y", "z"), 2).alias("f"))
    v = F.col("f")
    return f.select("idx", v[0].alias("c0"), _r(v[3]).alias("s0"), _r(v[6]).alias("c1"), F.size("f").alias("n"))


@query(
    "vectors_padded",
    "SELECT vec_id, 69 AS n, round(list_extract(embedding, 2)::DOUBLE, 5) AS second, 0.0E0 AS last FROM embeddings",
)
def vectors_padded(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    d = e.select("vec_id", P.pad_array(F.transform("embedding", lambda v: v.cast("double")), 69).alias("v"))
    return d.select(
        "vec_id", F.size("v").alias("n"), _r(F.col("v")[1]).alias("second"), F.element_at("v", -1).alias("last")
    )


def _mesh(spark, sf):
    faces = F.array(*[F.array(*[F.lit(i + k) for k in range(3)]) for i in range(19)])
    d = fx.joints(spark, sf)
    return d.select("rec", F.col("gt").alias("verts"), faces.alias("faces"), vec(0.0, 0.0, 0.0).alias("origin"))


_FACES = """fc AS (SELECT a.rec, a.joint AS f, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz
  FROM fx_joints a JOIN fx_joints b ON b.rec = a.rec AND b.joint = a.joint + 1 JOIN fx_joints c ON c.rec = a.rec AND c.joint = a.joint + 2),
nm AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM fc)"""


@query(
    "facing_vertices",
    """SELECT rec, count(DISTINCT f + k.k) AS n FROM nm CROSS JOIN (VALUES (0),(1),(2)) AS k(k)
 WHERE nx*(ax+bx+cx)/3 + ny*(ay+by_+cy)/3 + nz*(az+bz+cz)/3 < 0 GROUP BY rec""",
    views=("fx_joints",),
    ctes=_FACES,
)
def facing_vertices(spark, sf):
    return M.facing_vertices(_mesh(spark, sf), "rec").groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vertex_normals",
    """SELECT rec, v AS vertex, round(sx/greatest(l, 1e-12), 5) AS nx, round(sy/greatest(l, 1e-12), 5) AS ny, round(sz/greatest(l, 1e-12), 5) AS nz FROM (
 SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS l FROM (SELECT rec, f + k.k AS v, sum(nx) sx, sum(ny) sy, sum(nz) sz
 FROM nm CROSS JOIN (VALUES (0),(1),(2)) AS k(k) GROUP BY ALL))""",
    views=("fx_joints",),
    ctes=_FACES,
)
def vertex_normals(spark, sf):
    d = M.vertex_normals(_mesh(spark, sf), "rec")
    return d.select("rec", "vertex", *[_r(c).alias(c) for c in ("nx", "ny", "nz")])


@query(
    "vertices_offset",
    """SELECT j.rec, joint AS vertex, round(x + 0.02*sx/greatest(sqrt(sx*sx+sy*sy+sz*sz), 1e-12), 5) AS x FROM fx_joints j JOIN
 (SELECT rec, f + k.k AS v, sum(nx) sx, sum(ny) sy, sum(nz) sz FROM nm CROSS JOIN (VALUES (0),(1),(2)) AS k(k) GROUP BY ALL) n
 ON n.rec = j.rec AND n.v = j.joint""",
    views=("fx_joints",),
    ctes=_FACES,
)
def vertices_offset(spark, sf):
    return M.offset(_mesh(spark, sf), "rec", 0.02).select("rec", "vertex", _r("x").alias("x"))


@query(
    "mesh_differences",
    """SELECT rec, round(vertex, 5) AS vertex, round(edge, 5) AS edge FROM (SELECT rec, avg(abs((px-p0)-(gx-g0))+abs((py-p1)-(gy-g1))+abs((pz-p2)-(gz-g2)))/3 AS vertex
  FROM fx_err JOIN (SELECT rec AS r, px p0, py p1, pz p2, gx g0, gy g1, gz g2 FROM fx_err WHERE joint = 0) ON r = rec GROUP BY rec)
 JOIN (SELECT rec, avg(d) AS edge FROM (SELECT a.rec, abs(sqrt(pow(a.px-b.px,2)+pow(a.py-b.py,2)+pow(a.pz-b.pz,2))
   - sqrt(pow(a.gx-b.gx,2)+pow(a.gy-b.gy,2)+pow(a.gz-b.gz,2))) AS d FROM f JOIN fx_err a ON a.joint = f.a JOIN fx_err b ON b.rec = a.rec AND b.joint = f.b) GROUP BY rec) USING (rec)""",
    views=("fx_err",),
    ctes="""f AS (SELECT i + s.a AS a, i + s.b AS b FROM range(19) t(i) CROSS JOIN (VALUES (0,1),(0,2),(1,2)) AS s(a, b))""",
)
def mesh_differences(spark, sf):
    d = fx.scored(spark, sf).join(_mesh(spark, sf).select("rec", "faces"), "rec")
    g, p = F.col("gt"), F.col("pred")
    d = d.select("rec", M.mesh_diff(g, p, F.col("faces"), g[0], p[0]).alias("d"))
    return d.select("rec", _r("d.vertex").alias("vertex"), _r("d.edge").alias("edge"))


@query("icp_displacements")
def icp_displacements(spark, sf):
    p = fx.points(spark, sf)
    cols = ["cloud", "idx", "x", "y", "z"]
    pts = p.where(F.col("channel") <= 4).select(*cols)
    verts = p.where(F.col("channel") > 4).select("cloud", F.col("idx").alias("vertex"), "x", "y", "z")
    return M.icp_residual(pts, verts, "cloud", ("idx", "vertex"), 2)


# in a plane the closest rotation is one angle; returns beyond 0.5 weigh 0.5 / distance
_PLANE = """a AS (SELECT cloud, idx, x, y FROM fx_points WHERE channel <= 4),
v AS (SELECT cloud, idx AS vertex, x, y FROM fx_points WHERE channel > 4 AND col < 384),
m AS (SELECT cloud, idx, x AS px, y AS py, d, best.x AS vx, best.y AS vy, least(1, 0.5 / greatest(d, 1e-12)) AS w FROM (
  SELECT a.cloud, a.idx, a.x, a.y, min(sqrt((a.x-v.x)*(a.x-v.x)+(a.y-v.y)*(a.y-v.y))) AS d,
    arg_min({'x': v.x, 'y': v.y}, {'d': sqrt((a.x-v.x)*(a.x-v.x)+(a.y-v.y)*(a.y-v.y)), 'id': v.vertex}) AS best
  FROM a JOIN v ON a.cloud = v.cloud GROUP BY ALL)),
c AS (SELECT cloud, sum(w*px)/sum(w) AS px, sum(w*py)/sum(w) AS py, sum(w*vx)/sum(w) AS vx, sum(w*vy)/sum(w) AS vy FROM m GROUP BY cloud),
t AS (SELECT cloud, any_value(c.px) AS px, any_value(c.py) AS py, any_value(c.vx) AS vx, any_value(c.vy) AS vy,
  atan2(sum(w*((m.vx-c.vx)*(m.py-c.py) - (m.vy-c.vy)*(m.px-c.px))), sum(w*((m.vx-c.vx)*(m.px-c.px) + (m.vy-c.vy)*(m.py-c.py)))) AS g
  FROM m JOIN c USING (cloud) GROUP BY cloud)"""


@query(
    "icp_planar",
    """SELECT cloud, round(g, 5) AS angle, round(avg(sqrt(dx*dx + dy*dy)), 5) AS moved_m FROM (
 SELECT v.cloud, g, cos(g)*(x-vx) - sin(g)*(y-vy) + px - x AS dx, sin(g)*(x-vx) + cos(g)*(y-vy) + py - y AS dy FROM v JOIN t USING (cloud))
GROUP BY cloud, g""",
    views=("fx_points",),
    ctes=_PLANE,
)
def icp_planar(spark, sf):
    p = fx.points(spark, sf).withColumn("z", F.lit(0.0))
    pts = p.where("channel <= 4").select("cloud", "idx", "x", "y", "z")
    verts = p.where("channel > 4").select("cloud", F.col("idx").alias("vertex"), "col", "x", "y", "z")
    seen = verts.where("col < 384")
    pose = M.registered(pts, verts, "cloud", ("idx", "vertex"), 1, seen, 0.5)
    moved = M.mean_move(verts, pose, "cloud", "vertex", seen)
    angle = F.atan2(F.col("r")[3], F.col("r")[0])
    return pose.join(moved, "cloud").select("cloud", _r(angle, 5).alias("angle"), _r("moved_m", 5).alias("moved_m"))


# turns about one axis: their mean rotation is that of the mean direction
_TURNS = """turn AS (SELECT ds, 0.01E0*(rec % 50) AS a FROM fx_joints WHERE joint = 0),
mean_turn AS (SELECT ds, atan2(avg(sin(a)), avg(cos(a))) AS m FROM turn GROUP BY ds)"""


@query(
    "rotation_priors",
    """SELECT ds, round(cos(m), 5) AS c, round(1 + 2*cos(m), 5) AS trace FROM mean_turn""",
    views=("fx_joints",),
    ctes=_TURNS,
)
def rotation_priors(spark, sf):
    a = F.lit(0.01) * (F.col("rec") % 50)
    d = fx.joints(spark, sf).select("ds", "rec", V.yaw_matrix(a).alias("r"))
    m = F.col("mean")
    prior = M.rotation_prior(d, "ds", "r")
    return prior.select("ds", _r(m[0]).alias("c"), _r(m[0] + m[4] + m[8]).alias("trace"))


@query(
    "rotation_spreads",
    """SELECT ds, round(sqrt(avg((a - m)*(a - m))), 5) AS sigma, round(cos(any_value(m)), 5) AS m00 FROM turn JOIN mean_turn USING (ds) GROUP BY ds""",
    views=("fx_joints",),
    ctes=_TURNS,
)
def rotation_spreads(spark, sf):
    a = F.lit(0.01) * (F.col("rec") % 50)
    d = fx.joints(spark, sf).select("ds", "rec", V.yaw_matrix(a).alias("r"))
    return M.rotation_prior(d, "ds", "r").select("ds", _r("sigma").alias("sigma"), _r(F.col("mean")[0]).alias("m00"))


@query(
    "mask_boxes",
    "SELECT cloud, min(col) AS x0, min(channel) AS y0, max(col) AS x1, max(channel) AS y1 FROM fx_points GROUP BY cloud",
    views=("fx_points",),
)
def mask_boxes(spark, sf):
    px = fx.points(spark, sf).select("cloud", F.col("col").alias("u"), F.col("channel").alias("v"))
    return O.mask_bbox(px, ["cloud"])


@query(
    "masks_united",
    "SELECT cloud, count(*) AS n FROM (SELECT DISTINCT cloud, col, channel FROM fx_points) GROUP BY cloud",
    views=("fx_points",),
)
def masks_united(spark, sf):
    px = fx.points(spark, sf).select("cloud", F.col("col").alias("u"), F.col("channel").alias("v"))
    return O.union_masks(px, ["cloud"]).groupBy("cloud").agg(F.count(F.lit(1)).alias("n"))


@query(
    "depth_reprojected",
    """SELECT cloud, count(*) AS n, count(*) FILTER (z2 - f <= 1e-6 + 1e-5*f) AS visible FROM (SELECT *, min(z2) OVER (PARTITION BY cloud, u2, v2) AS f FROM (
 SELECT cloud, z + 5 AS z2, CAST(round_even(256 + (col - 256)*(z/(z+5)), 0) AS BIGINT) AS u2, CAST(round_even(2 + (channel - 2)*(z/(z+5)), 0) AS BIGINT) AS v2
 FROM fx_points) WHERE u2 BETWEEN 0 AND 511 AND v2 BETWEEN 0 AND 7) GROUP BY cloud""",
    views=("fx_points",),
)
def depth_reprojected(spark, sf):
    px = fx.points(spark, sf).select("cloud", F.col("col").alias("u"), F.col("channel").alias("v"), "z")
    d = O.reproject_depth(px, "cloud", 5.0, 256.0, 2.0, 512, 8)
    return d.groupBy("cloud").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("visible"), 1)).alias("visible")
    )


_PILLARS = """px AS (SELECT cloud, idx, CAST(floor((x+8)/0.5) AS BIGINT) AS ix, CAST(floor((y+2)/0.5) AS BIGINT) AS iy FROM fx_points
  WHERE x >= -8 AND x < 8 AND y >= -2 AND y < 2),
pl AS (SELECT cloud, iy, ix, least(count(*), 4) AS n FROM px GROUP BY ALL)"""


def _pillars(spark, sf):
    v = O.voxelize(
        fx.points(spark, sf), "cloud", "idx", (-8.0, 8.0), (-2.0, 2.0), (0.0, 40.0), 0.5, 4
    )
    return O.pillar_counts(v, "cloud")


@query("pillars", "SELECT cloud, iy, ix, n FROM pl", views=("fx_points",), ctes=_PILLARS)
def pillars(spark, sf):
    return _pillars(spark, sf)


@query(
    "pillar_windows",
    "SELECT cloud, iy - cloud % 4 AS ly, ix - cloud % 8 AS lx, n, 7 AS last FROM pl WHERE iy - cloud % 4 BETWEEN 0 AND 3 AND ix - cloud % 8 BETWEEN 0 AND 3",
    views=("fx_points",),
    ctes=_PILLARS,
)
def pillar_windows(spark, sf):
    w = O.cell_window(_pillars(spark, sf), F.col("cloud") % 4, F.col("cloud") % 8, 4)
    roi = O.clamped_roi(F.lit(7), 3, 8)
    return w.select("cloud", "ly", "lx", "n", F.element_at(roi, -1).alias("last"))


@query(
    "farthest_points",
    """SELECT cloud, idx, i AS rank FROM walk""",
    views=("fx_points",),
    recursive=True,
    ctes="""pt AS (SELECT cloud, list(struct_pack(idx := idx, x := x, y := y, z := z) ORDER BY idx) AS p FROM fx_points GROUP BY cloud),
walk AS (SELECT cloud, 0 AS i, p[1].idx AS idx, p, [CAST(pow(q.x-p[1].x, 2) + pow(q.y-p[1].y, 2) + pow(q.z-p[1].z, 2) AS DOUBLE) FOR q IN p] AS d FROM pt
 UNION ALL SELECT cloud, i + 1, p[b].idx, p, [least(d[j], pow(p[j].x-p[b].x, 2) + pow(p[j].y-p[b].y, 2) + pow(p[j].z-p[b].z, 2)) FOR j IN range(1, len(p) + 1)]
 FROM (SELECT *, list_position(d, list_max(d)) AS b FROM walk) WHERE i < 7)""",
)
def farthest_points(spark, sf):
    return O.farthest_points(fx.points(spark, sf), "cloud", "idx", 8).select(
        "cloud", "idx", F.col("rank").cast("int").alias("rank")
    )
