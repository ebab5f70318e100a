"""Matching and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import boxes as B
from tallyfield.functions import vectors as V
from tallyfield.functions.camera import camera, project
from tallyfield.functions.vectors import vec
from tallyfield.operators import labels as L
from tallyfield.operators import matching as M
from tallyfield.operators import sequences as S
from tallyfield.operators.spatial import nearest
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query
from tallyfield.session import spread


def _r(col, n=4):
    return F.round(col, n)


@query(
    "annotations_joined",
    """SELECT r_name AS category, c_nationkey AS instance, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE o_orderkey % 2 = 0 GROUP BY ALL""",
)
def annotations_joined(spark, sf):
    from tallyfield.sources.tokens import annotations_of

    o = fx.table(spark, sf, "orders")
    tables = {
        "sample_annotation": o.select(
            F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("instance_token"),
            (F.col("o_orderkey") % 2).alias("sample_token"),
        ),
        "instance": fx.table(spark, sf, "customer").join(
            fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("c_custkey").alias("token"), F.col("n_regionkey").alias("category_token"), "c_nationkey"),
        "category": fx.table(spark, sf, "region").select(
            F.col("r_regionkey").alias("token"), F.col("r_name").alias("name")
        ),
        "sample": spark.range(1).select(F.col("id").alias("token")),
    }
    d = annotations_of(tables)
    return d.groupBy("category", F.col("c_nationkey").alias("instance")).agg(F.count(F.lit(1)).alias("n"))


def _halves(spark, sf):
    p = fx.points(spark, sf)
    a = p.where(F.col("channel") <= 2).select("cloud", F.col("idx").alias("a"), "x", "y", "z")
    b = p.where(F.col("channel") > 2).select("cloud", F.col("idx").alias("b"), "x", "y", "z")
    return a, b


_HALVES = """a AS (SELECT cloud, idx AS a, x, y, z FROM fx_points WHERE channel <= 2),
b AS (SELECT cloud, idx AS b, x, y, z FROM fx_points WHERE channel > 2)"""


@query(
    "nearest_in_frame",
    """SELECT cloud, a, arg_min(b, struct_pack(d := d, b := b)) AS b, round(min(d), 6) AS distance FROM (
 SELECT a.cloud, a, b, sqrt((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z)) AS d FROM a JOIN b ON a.cloud = b.cloud)
 WHERE d <= 0.5 GROUP BY cloud, a""",
    views=("fx_points",),
    ctes=_HALVES,
)
def nearest_in_frame(spark, sf):
    a, b = _halves(spark, sf)
    d = M.match_nearest(a, b, on=["cloud"], coords=["x", "z"], ids=("a", "b"), max_distance=0.5)
    return d.select("cloud", "a", "b", _r("distance", 6).alias("distance"))


@query(
    "nearest_anywhere",
    """SELECT rec, arg_min(idx, struct_pack(d := d, i := idx)) AS idx, round(min(d), 6) AS distance FROM (
 SELECT b.rec, idx, sqrt((b.cx-x)*(b.cx-x)+(b.cy-y)*(b.cy-y)+(b.cz-z)*(b.cz-z)) AS d FROM fx_boxes b CROSS JOIN fx_points p)
 WHERE d <= 0.3 GROUP BY rec""",
    views=("fx_boxes", "fx_points"),
)
def nearest_anywhere(spark, sf):
    b = fx.boxes(spark, sf).select("rec", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    d = M.match_nearest(
        b, fx.points(spark, sf), on=[], coords=["x", "y", "z"], ids=("rec", "idx"), max_distance=0.3
    )
    return d.select("rec", "idx", _r("distance", 6).alias("distance"))


@query(
    "nearest_one_to_one",
    """SELECT b AS point, arg_min(a, struct_pack(d := d, a := a)) AS record, round(min(d), 6) AS distance FROM (
 SELECT a, arg_min(b, struct_pack(d := d, b := b)) AS b, min(d) AS d FROM (
  SELECT a.cloud, a, b, sqrt((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z)) AS d FROM a JOIN b ON a.cloud = b.cloud)
 WHERE d <= 0.5 GROUP BY a) GROUP BY b""",
    views=("fx_points",),
    ctes=_HALVES,
)
def nearest_one_to_one(spark, sf):
    a, b = _halves(spark, sf)
    d = M.match_nearest(
        a, b, on=["cloud"], coords=["x", "z"], ids=("a", "b"), max_distance=0.5, one_to_one=True
    )
    return d.select(F.col("b").alias("point"), F.col("a").alias("record"), _r("distance", 6).alias("distance"))


@query(
    "k_nearest",
    """SELECT a, b, rank, round(d, 6) AS distance FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank
 FROM (SELECT a, b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM a JOIN b ON a.cloud = b.cloud)) WHERE rank <= 4""",
    views=("fx_points",),
    ctes=_HALVES,
)
def k_nearest(spark, sf):
    a, b = _halves(spark, sf)
    d = nearest(a, b, by=["cloud"], coords=["x", "y", "z"], query_id="a", point_id="b", k=4)
    return d.select("a", "b", "rank", _r("distance", 6).alias("distance"))


@query(
    "return_to_mesh",
    """SELECT cloud, round(median(d), 6) AS median_m FROM (SELECT a.cloud, a, min(sqrt((a.x-b.x)*(a.x-b.x)
 +(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS d FROM a JOIN b ON a.cloud = b.cloud GROUP BY a.cloud, a) GROUP BY cloud""",
    views=("fx_points",),
    ctes=_HALVES,
)
def return_to_mesh(spark, sf):
    a, b = _halves(spark, sf)
    d = L.point_to_mesh(a, b, "cloud", ("a", "b"))
    return d.select("cloud", _r("median_m", 6).alias("median_m"))


_MASKS = """px AS (SELECT cloud AS frame, channel AS label, row_number() OVER (PARTITION BY cloud, channel ORDER BY idx) - 1 AS i,
  CAST(round_even(4*x, 0) AS BIGINT) AS u, CAST(round_even(4*y, 0) AS BIGINT) AS v FROM fx_points),
mk AS (SELECT DISTINCT cloud AS frame, rec % 5 AS mask, CAST(round_even(4*x, 0) AS BIGINT) AS u, CAST(round_even(4*y, 0) AS BIGINT) AS v
  FROM fx_points WHERE col < 256),
sc AS (SELECT h.frame, h.label, h.mask, n / t AS score FROM (SELECT p.frame, p.label, m.mask, count(*) AS n FROM px p JOIN mk m
   USING (frame, u, v) WHERE i % 4 = 0 GROUP BY ALL) h JOIN (SELECT frame, label, count(*) AS t FROM px WHERE i % 4 = 0
   GROUP BY ALL) t USING (frame, label))"""


def _mask_scores(spark, sf):
    p = fx.points(spark, sf).withColumn("frame", F.col("cloud"))
    labelled = S.track_order(p.withColumn("label", F.col("channel")), ["frame", "label"], "idx", "rec")
    px = labelled.select(
        "frame", "label", F.col("pos").alias("idx"), (F.col("x") * 4).alias("u"), (F.col("y") * 4).alias("v")
    )
    masks = p.where(F.col("col") < 256).select(
        "frame",
        (F.col("rec") % 5).alias("mask"),
        F.rint(F.col("x") * 4).cast("long").alias("u"),
        F.rint(F.col("y") * 4).cast("long").alias("v"),
    )
    return M.overlap_scores(px, masks)


@query(
    "mask_overlap",
    "SELECT frame, label, mask, round(score, 6) AS score FROM sc",
    views=("fx_points",),
    ctes=_MASKS,
)
def mask_overlap(spark, sf):
    return _mask_scores(spark, sf).select("frame", "label", "mask", _r("score", 6).alias("score"))


@query(
    "mask_assignment",
    """SELECT frame, l AS label, m AS mask, round(s, 6) AS score FROM walk WHERE hit""",
    views=("fx_points",),
    recursive=True,
    ctes=_MASKS
    + """, so AS (SELECT frame, label, mask, score, row_number() OVER (PARTITION BY frame ORDER BY score DESC, label, mask) AS rn
  FROM sc WHERE score >= 0.15),
walk AS (SELECT frame, label AS l, mask AS m, score AS s, rn, true AS hit, [label] AS ul, [mask] AS um FROM so WHERE rn = 1
 UNION ALL SELECT o.frame, o.label, o.mask, o.score, o.rn, NOT (list_contains(w.ul, o.label) OR list_contains(w.um, o.mask)),
  CASE WHEN list_contains(w.ul, o.label) OR list_contains(w.um, o.mask) THEN w.ul ELSE list_append(w.ul, o.label) END,
  CASE WHEN list_contains(w.ul, o.label) OR list_contains(w.um, o.mask) THEN w.um ELSE list_append(w.um, o.mask) END
  FROM walk w JOIN so o ON o.frame = w.frame AND o.rn = w.rn + 1)""",
)
def mask_assignment(spark, sf):
    d = M.greedy_match(_mask_scores(spark, sf), ["frame"], "label", "mask")
    return d.select("frame", "label", "mask", _r("score", 6).alias("score"))


@query(
    "points_in_masks",
    "SELECT p.frame, count(*) AS n FROM px p SEMI JOIN mk USING (frame, u, v) GROUP BY p.frame",
    views=("fx_points",),
    ctes=_MASKS,
)
def points_in_masks(spark, sf):
    p = fx.points(spark, sf).withColumn("frame", F.col("cloud"))
    px = p.select("frame", (F.col("x") * 4).alias("u"), (F.col("y") * 4).alias("v"), "col")
    masks = px.where(F.col("col") < 256).select(
        "frame", F.rint("u").cast("long").alias("u"), F.rint("v").cast("long").alias("v")
    )
    return M.points_in_mask(px, masks, ["frame"]).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query(
    "relabelled",
    """SELECT ds, count(*) FILTER (l.rec IS NOT NULL) AS labelled, round(sum(l.conf), 4) AS conf FROM fx_records r LEFT JOIN
 (SELECT rec, label_conf * 2 AS conf FROM fx_records WHERE rec % 5 = 1) l USING (rec) GROUP BY ds""",
    views=("fx_records",),
)
def relabelled(spark, sf):
    d = fx.records(spark, sf)
    labels = d.where("rec % 5 = 1").select("rec", (F.col("label_conf") * 2).alias("label_conf"))
    out = L.relabel(d, labels, ["label_conf"], "rec")
    return out.groupBy("ds").agg(
        F.count(F.when(F.col("has_smpl"), 1)).alias("labelled"), _r(F.sum("label_conf")).alias("conf")
    )


@query(
    "smooth_pairs",
    """SELECT track, before, after, dt FROM (SELECT track, rec AS after, lag(rec) OVER w AS before, us - lag(us) OVER w AS dt
 FROM fx_tracks WINDOW w AS (PARTITION BY track ORDER BY us, rec)) WHERE dt < 600000000""",
    views=("fx_tracks",),
)
def smooth_pairs(spark, sf):
    return S.smooth_pairs(fx.tracks(spark, sf), ["track"], "us", "rec", 600_000_000)


@query(
    "track_positions",
    "SELECT rec, row_number() OVER (PARTITION BY track ORDER BY us, rec) - 1 AS pos FROM fx_tracks",
    views=("fx_tracks",),
)
def track_positions(spark, sf):
    return S.track_order(fx.tracks(spark, sf), ["track"], "us", "rec").select("rec", "pos")


_CAMS = ((0.0, 120.0, 256), (3.0, 200.0, 256), (-6.0, 90.0, 300))


def _camera_array():
    out = []
    for i, (dx, f, size) in enumerate(_CAMS):
        pose = vec(1.0, 0.0, 0.0, -dx, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
        half = F.lit(size / 2)
        out.append(
            F.struct(
                F.lit(f"cam{i}").alias("channel"), pose.alias("pose"), F.lit(f).alias("fx"),
                F.lit(f).alias("fy"), half.alias("cx"), half.alias("cy"),
                F.lit(float(size)).alias("width"), F.lit(float(size)).alias("height"),
            )
        )
    return F.array(*out)


_CAM_SQL = """cam AS (SELECT * FROM (VALUES (0, 'cam0', 0.0E0, 120.0E0, 256), (1, 'cam1', 3.0E0, 200.0E0, 256),
 (2, 'cam2', -6.0E0, 90.0E0, 300)) AS t(i, channel, tx, f, size)),
sg AS (SELECT * FROM (VALUES (-0.5),(0.5)) a(sx) CROSS JOIN (VALUES (-0.5),(0.5)) b(sy) CROSS JOIN (VALUES (-0.5),(0.5)) c(sz)),
seen AS (SELECT rec, i, channel, min(v) AS v0, max(v) AS v1, min(u) AS u0, max(u) AS u1 FROM (SELECT rec, i, channel, size,
  f*(cx+sx*dx-tx)/(cz+sz*dz)+size/2.0E0 AS u, f*(cy+sy*dy)/(cz+sz*dz)+size/2.0E0 AS v, cz+sz*dz AS z FROM fx_boxes CROSS JOIN cam CROSS JOIN sg)
 GROUP BY rec, i, channel, size HAVING bool_and(u >= 0 AND u < size AND v >= 0 AND v < size AND z > 0.5))"""


def _box(df):
    return vec(*[F.col(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz", "yaw")])


@query(
    "best_cameras",
    "SELECT rec, arg_max(channel, v1 - v0 - i*1e-12) AS channel, round(max(v1 - v0), 5) AS height FROM seen GROUP BY rec",
    views=("fx_boxes",),
    ctes=_CAM_SQL,
)
def best_cameras(spark, sf):
    d = spread(fx.boxes(spark, sf))
    best = M.best_camera(B.box_corners(_box(d)), _camera_array(), 0.5)
    d = d.select("rec", best.alias("b")).where(F.col("b").isNotNull())
    return d.select("rec", F.col("b.channel").alias("channel"), _r("b.height", 5).alias("height"))


@query(
    "frame_candidates",
    "SELECT rec, channel, round(u0, 5) AS u0, round(v1, 5) AS v1 FROM seen WHERE v1 - v0 >= 15",
    views=("fx_boxes",),
    ctes=_CAM_SQL,
)
def frame_candidates(spark, sf):
    d = fx.boxes(spark, sf).withColumn("rig", F.lit("car"))
    d = d.select("rec", "rig", B.box_corners(_box(d)).alias("corners"))
    cams = spark.range(1).select(F.lit("car").alias("rig"), F.explode(_camera_array()).alias("c"))
    cams = cams.select("rig", "c.*")

    def accept(corners, c):
        px = F.transform(
            corners,
            lambda p: F.array(
                c["fx"] * (p[0] + c["pose"][3]) / p[2] + c["cx"], c["fy"] * p[1] / p[2] + c["cy"], p[2]
            ),
        )
        ok = F.forall(
            px,
            lambda q: (q[2] > 0.5) & (q[0] >= 0) & (q[0] < c["width"]) & (q[1] >= 0) & (q[1] < c["height"]),
        )
        us, vs = F.transform(px, lambda q: q[0]), F.transform(px, lambda q: q[1])
        return F.when(ok, F.array(F.array_min(us), F.array_min(vs), F.array_max(us), F.array_max(vs)))

    out = M.frame_candidates(d, cams, "rig", accept, 15.0)
    return out.select(
        "rec", "channel", _r(F.col("bbox")[0], 5).alias("u0"), _r(F.col("bbox")[3], 5).alias("v1")
    )


@query(
    "initial_values",
    """SELECT rec, CASE WHEN rec % 3 = 0 THEN 'first' WHEN rec % 3 = 1 THEN 'second' ELSE 'none' END AS init,
  CASE WHEN rec % 3 = 0 THEN rec / 10.0E0 WHEN rec % 3 = 1 THEN round(coalesce(c, box_h), 5) END AS x
 FROM fx_records LEFT JOIN (SELECT rec, avg(x) AS c FROM fx_points GROUP BY rec) USING (rec)""",
    views=("fx_records", "fx_points"),
)
def initial_values(spark, sf):
    r = fx.records(spark, sf).select("rec", vec(F.col("box_h"), 0.0, 0.0).alias("box_centre"))
    one = F.array(F.lit(0.0))
    first = r.where("rec % 3 = 0").select("rec", one.alias("pose"), vec(F.col("rec") / 10.0, 0.0, 0.0).alias("transl"))
    second = r.where("rec % 3 <> 2").select("rec", one.alias("pose"))
    c = fx.points(spark, sf).groupBy("rec").agg(vec(F.avg("x"), F.avg("y"), F.avg("z")).alias("centroid"))
    out = L.init_with_fallback(r, first, second, c, "rec")
    return out.select("rec", "init", _r(F.col("transl")[0], 5).alias("x"))


@query("accepted_keys", "SELECT DISTINCT key FROM fx_records WHERE has_smpl", views=("fx_records",))
def accepted_keys(spark, sf):
    return M.accepted_keys(fx.records(spark, sf))


@query(
    "pending_work",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def pending_work(spark, sf):
    work = fx.table(spark, sf, "documents").select("doc_id")
    return M.pending(work, fx.table(spark, sf, "labels"), ["doc_id"])


@query(
    "ego_residuals",
    """SELECT track, round(max(greatest(abs(z), abs(x), abs(y))), 5) AS residual FROM (
 SELECT p.track, p.e - (p.us - f.us) / 1e9 AS z, 0.0E0 AS x, 0.0E0 AS y FROM (SELECT *, (us - min(us) OVER (PARTITION BY track)) / 1e9
   + CASE WHEN track % 3 = 0 THEN value / 1000 ELSE 0 END AS e, row_number() OVER (PARTITION BY track ORDER BY us) - 1 AS i,
   count(*) OVER (PARTITION BY track) AS n FROM u) p JOIN (SELECT track, min(us) AS us FROM u GROUP BY track) f USING (track)
 WHERE n <= 12 OR i IN (SELECT CAST(floor(j * ((n - 1) / 11.0E0)) AS BIGINT) FROM range(12) t(j))) GROUP BY track HAVING residual >= 0""",
    views=("fx_tracks",),
    ctes="u AS (SELECT track, us, max(value) AS value FROM fx_tracks GROUP BY track, us)",
)
def ego_residuals(spark, sf):
    t = fx.tracks(spark, sf).groupBy("track", "us").agg(F.max("value").alias("value"))
    start = t.groupBy("track").agg(F.min("us").alias("us0"))
    d = t.join(start, "track").withColumn("scene", F.col("track"))
    ahead = (F.col("us") - F.col("us0")) / F.lit(1e9)
    noise = F.when(F.col("track") % 3 == 0, F.col("value") / 1000).otherwise(0.0)
    tracks = d.select("track", "scene", F.col("us").alias("frame"), vec(0.0, 0.0, ahead + noise).alias("ego"))
    eye = vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    poses = d.select("scene", F.col("us").alias("frame"), V.se3(eye, vec(F.col("us") / 1e9, 0.0, 0.0)).alias("pose"))
    out = M.ego_residual(tracks, poses)
    return out.select("track", _r("residual", 5).alias("residual"))


@query(
    "methods_side_by_side",
    """SELECT run, max(mpjpe) FILTER (split = 'click') AS click_mpjpe, max(mpjpe) FILTER (split = 'view') AS view_mpjpe
 FROM fx_metrics GROUP BY run""",
    views=("fx_metrics",),
)
def methods_side_by_side(spark, sf):
    m = fx.metrics(spark, sf).select("run", F.col("split").alias("method"), "mpjpe")
    return M.side_by_side(m, "run", ["click", "view"], ["mpjpe"])


@query(
    "record_index",
    """SELECT rec, round(cx + 1, 5) AS vx, round(cos(0.5)*(cx+1) - sin(0.5)*cz + rec, 4) AS wx, round(cx + 1 + 2, 4) AS back
 FROM fx_boxes WHERE rec % 3 <> 0""",
    views=("fx_boxes",),
)
def record_index(spark, sf):
    b = fx.boxes(spark, sf)
    turn = V.yaw_matrix(F.lit(0.5))
    world = V.se3(turn, vec(F.col("rec"), 0.0, 0.0))
    eye = vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    cam = V.se3(eye, vec(2.0, 0.0, 0.0))
    labels = b.select(
        "rec", vec(F.col("cx") + 1, F.col("cy"), F.col("cz")).alias("centre"),
        world.alias("to_world"), cam.alias("to_camera"),
    )
    idx = M.build_index(labels, b.where("rec % 3 <> 0"), "rec")
    back = V.se3_apply(F.col("world_to_camera"), F.col("world"))
    return idx.select(
        "rec", _r(F.col("vehicle")[0], 5).alias("vx"), _r(F.col("world")[0]).alias("wx"), _r(back[0]).alias("back")
    )


@query(
    "derived_filled",
    "SELECT doc_id, coalesce(quality, n_chars % 7) AS quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)",
)
def derived_filled(spark, sf):
    docs = fx.table(spark, sf, "documents")
    d = docs.select("doc_id").join(fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    derived = docs.select("doc_id", (F.col("n_chars") % 7).alias("quality"), "n_chars")
    return L.fill_derived(d, derived, "doc_id")


_GATE = """g AS (SELECT rec, ds, CASE WHEN rec % 31 = 0 THEN NULL ELSE (rec % 97) / 1000.0E0 END AS kp,
  CASE WHEN rec % 37 = 0 THEN NULL ELSE (rec % 89) / 1000.0E0 END AS ch, (rec % 80) / 10.0E0 AS en FROM fx_records),
c AS (SELECT *, coalesce(kp <= 0.08 AND ch <= 0.06 AND en <= 6.0, false) AS ok,
  CASE WHEN coalesce(kp <= 0.08 AND ch <= 0.06 AND en <= 6.0, false) THEN exp(-pow(kp/0.05, 2))*exp(-pow(least(ch,1)/0.04, 2)) ELSE 0 END AS conf FROM g)"""


def _gated(spark, sf):
    r = F.col("rec")
    d = fx.records(spark, sf).select(
        "rec",
        "ds",
        F.when(r % 31 == 0, F.lit(float("nan"))).otherwise((r % 97) / F.lit(1000.0)).alias("kp_error_m"),
        F.when(r % 37 != 0, (r % 89) / F.lit(1000.0)).alias("chamfer_m"),
        ((r % 80) / F.lit(10.0)).alias("prior_energy"),
    )
    return L.label_confidence(d)


@query(
    "label_confidence",
    "SELECT rec, ok AS accepted, round(conf, 6) AS confidence FROM c",
    views=("fx_records",),
    ctes=_GATE,
)
def label_confidence(spark, sf):
    return _gated(spark, sf).select("rec", "accepted", _r("confidence", 6).alias("confidence"))


@query(
    "acceptance_summary",
    """SELECT ds, count(*) AS records, count(*) FILTER (ok) AS accepted, round(avg(ok::INT), 6) AS acceptance_rate,
  round(1000*avg(kp), 4) AS keypoint_error_mm, round(1000*avg(kp) FILTER (ok), 4) AS keypoint_error_accepted_mm,
  round(median(ch*1000), 4) AS chamfer_median_mm, round(avg(en), 5) AS prior_energy_mean,
  round(avg(conf) FILTER (ok), 5) AS confidence_mean_accepted, count(*) FILTER (kp > 0.08) AS rejected_by_keypoints,
  count(*) FILTER (ch > 0.06) AS rejected_by_chamfer, count(*) FILTER (en > 6) AS rejected_by_prior FROM c GROUP BY ds""",
    views=("fx_records",),
    ctes=_GATE,
)
def acceptance_summary(spark, sf):
    d = L.acceptance_summary(_gated(spark, sf), ["ds"])
    digits = {
        "acceptance_rate": 6, "keypoint_error_mm": 4, "keypoint_error_accepted_mm": 4,
        "chamfer_median_mm": 4, "prior_energy_mean": 5, "confidence_mean_accepted": 5,
    }
    return d.select(*[_r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in d.columns])


@query(
    "error_by_band",
    """SELECT band, count(*) AS n, round(avg(y), 5) AS mean, round(median(y), 5) AS median, round(quantile_cont(y, 0.9), 5) AS p90
 FROM (SELECT 'all' AS band, y, z FROM fx_points UNION ALL SELECT CASE WHEN z < 10 THEN '0-10m' WHEN z < 20 THEN '10-20m'
  ELSE '20-40m' END, y, z FROM fx_points WHERE z < 40) GROUP BY band""",
    views=("fx_points",),
)
def error_by_band(spark, sf):
    d = L.band_report(fx.points(spark, sf), F.col("y"), F.col("z"))
    return d.select("band", "n", *[_r(c, 5).alias(c) for c in ("mean", "median", "p90")])


@query(
    "label_sets_compared",
    """SELECT source, count(*) AS n, round(median(value), 5) AS kp, round(median(CASE WHEN rec % 5 <> 0 THEN value*2 END), 5) AS mesh
 FROM fx_tracks GROUP BY source""",
    views=("fx_tracks",),
)
def label_sets_compared(spark, sf):
    d = fx.tracks(spark, sf).select(
        "source", F.col("value").alias("kp"),
        F.when(F.col("rec") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 2).alias("mesh"),
    )
    out = L.label_set_report(d, ["source"], ["kp", "mesh"])
    return out.select("source", "n", _r("kp", 5).alias("kp"), _r("mesh", 5).alias("mesh"))


@query(
    "track_shared_shape",
    """SELECT ds, round(avg(x) FILTER (joint = 0), 5) AS b0, round(avg(x) FILTER (joint = 9), 5) AS b9 FROM fx_joints GROUP BY ds""",
    views=("fx_joints",),
)
def track_shared_shape(spark, sf):
    d = fx.joints(spark, sf).select("ds", F.transform("gt", lambda p: p[0]).alias("betas"))
    m = L.mean_vector(d, ["ds"], "betas")
    return m.select("ds", _r(F.col("betas")[0], 5).alias("b0"), _r(F.col("betas")[9], 5).alias("b9"))


@query(
    "weighted_error",
    "SELECT ds, round(sum(box_h*w)/greatest(sum(w), 1), 5) AS error FROM (SELECT *, has_smpl::INT * label_conf AS w FROM fx_records) GROUP BY ds",
    views=("fx_records",),
)
def weighted_error(spark, sf):
    w = F.col("has_smpl").cast("int") * F.col("label_conf")
    d = L.weighted_mean(fx.records(spark, sf), ["ds"], F.col("box_h"), w, "error")
    return d.select("ds", _r("error", 5).alias("error"))


@query(
    "scan_statistics",
    """SELECT ds, count(n) AS simulated, count(*) - count(n) AS missing, round(median(n), 4) AS median, round(quantile_cont(n, 0.1), 4) AS p10
 FROM fx_records LEFT JOIN (SELECT rec, count(*)::DOUBLE AS n FROM fx_points GROUP BY rec) USING (rec) GROUP BY ds""",
    views=("fx_records", "fx_points"),
)
def scan_statistics(spark, sf):
    n = fx.points(spark, sf).groupBy("rec").agg(F.count(F.lit(1)).alias("returns"))
    d = L.scan_stats(fx.records(spark, sf).join(n, "rec", "left"), ["ds"], "returns")
    return d.select("ds", "simulated", "missing", _r("median").alias("median"), _r("p10").alias("p10"))


@query(
    "work_by_parent",
    """SELECT track, (rn - 1) // 16 AS part, string_agg(rec::VARCHAR, ',' ORDER BY rec) AS items FROM (SELECT track, rec,
  row_number() OVER (PARTITION BY track ORDER BY rec) AS rn FROM fx_tracks) GROUP BY ALL""",
    views=("fx_tracks",),
)
def work_by_parent(spark, sf):
    d = L.work_groups(fx.tracks(spark, sf), ["track"], "rec", chunk=16)
    return d.select("track", "part", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(
    "label_counts",
    "SELECT seq, count(*) FILTER (has_smpl) AS labelled, count(*) AS total FROM fx_records GROUP BY ROLLUP (seq)",
    views=("fx_records",),
)
def label_counts(spark, sf):
    return L.label_counts(fx.records(spark, sf), "seq")


@query(
    "lifted_along_up",
    """SELECT rec, round(-avg(gy - py) FILTER (valid), 6) AS lift FROM fx_err GROUP BY rec""",
    views=("fx_err",),
)
def lifted_along_up(spark, sf):
    d = fx.scored(spark, sf).withColumn("up", vec(0.0, -1.0, 0.0))
    lift = L.lift_along_up(d, "gt", "pred", "valid", "up")
    return d.select("rec", _r(-lift[1], 6).alias("lift"))


@query(
    "ground_levels",
    """SELECT rec, round(greatest(low - g, 0), 5) AS sink, round(greatest(g - low - 0.05, 0), 5) AS hover FROM (
 SELECT b.rec, cy + dy/2 AS g, max(y) AS low FROM fx_boxes b JOIN fx_points p ON p.cloud = b.rec GROUP BY b.rec, cy, dy)""",
    views=("fx_boxes", "fx_points"),
)
def ground_levels(spark, sf):
    b = fx.boxes(spark, sf)
    d = L.ground_check(
        fx.points(spark, sf).drop("rec").withColumnRenamed("cloud", "rec"), b.select("rec", _box(b).alias("box")), "rec"
    )
    return d.select("rec", _r("sink", 5).alias("sink"), _r("hover", 5).alias("hover"))


@query(
    "check_samples",
    """SELECT seq, count(*) AS n, round(avg(label_conf), 6) AS mean_error, max(label_conf) AS max_error FROM (SELECT *,
  row_number() OVER (PARTITION BY seq ORDER BY rec) AS rn FROM fx_records WHERE has_smpl) WHERE rn <= 8 GROUP BY seq""",
    views=("fx_records",),
)
def check_samples(spark, sf):
    d = L.check_sample(fx.records(spark, sf), ["seq"], ["rec"], "label_conf")
    return d.select("seq", "n", _r("mean_error", 6).alias("mean_error"), "max_error")
