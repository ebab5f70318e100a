"""Evaluation queries: joint errors, placement, overlap, precision, summaries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyfield.functions import boxes as B
from tallyfield.functions import pose as P
from tallyfield.functions.camera import camera, project
from tallyfield.functions.vectors import vec
from tallyfield.operators import evaluation as E
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query
from tallyfield.session import spread


def _r(col, n=4):
    return F.round(col, n)


def _joint_metrics(spark, sf):
    d = fx.scored(spark, sf)
    g, p, v = F.col("gt"), F.col("pred"), F.col("valid")
    centred = P.mpjpe(P.centre_joints(g, v), P.centre_joints(p, v), v)
    return d.select(
        "rec",
        "ds",
        P.mpjpe(g, p, v).alias("abs_mpjpe"),
        centred.alias("mpjpe"),
        F.sqrt(
            sum([(p[0][i] - g[0][i]) * (p[0][i] - g[0][i]) for i in (1, 2)],
                (p[0][0] - g[0][0]) * (p[0][0] - g[0][0]))
        ).alias("transl_err_m"),
        g[0][2].alias("gt_depth_m"),
    )


_CENTRED = """means AS (SELECT rec, avg(gx) mx, avg(gy) my, avg(gz) mz, avg(px) nx, avg(py) ny,
    avg(pz) nz FROM fx_err WHERE valid GROUP BY rec),
per AS (SELECT e.rec, e.ds, 1000*avg(err) FILTER (valid) AS abs_mpjpe,
    1000*avg(sqrt(pow(px-nx-gx+mx,2)+pow(py-ny-gy+my,2)+pow(pz-nz-gz+mz,2))) FILTER (valid) AS mpjpe,
    max(err) FILTER (joint = 0) AS transl_err_m, max(gz) FILTER (joint = 0) AS gt_depth_m
  FROM fx_err e LEFT JOIN means m ON m.rec = e.rec GROUP BY e.rec, e.ds)"""


@query(
    "mpjpe_by_record",
    "SELECT rec, round(abs_mpjpe, 3) AS abs_mpjpe, round(mpjpe, 3) AS mpjpe FROM per",
    views=("fx_err",),
    ctes=_CENTRED,
)
def mpjpe_by_record(spark, sf):
    return _joint_metrics(spark, sf).select(
        "rec", _r("abs_mpjpe", 3).alias("abs_mpjpe"), _r("mpjpe", 3).alias("mpjpe")
    )


@query(
    "summary_by_dataset",
    """SELECT ds, count(*) AS n, round(avg(mpjpe), 3) AS mpjpe, round(avg(abs_mpjpe), 3) AS abs_mpjpe,
 round(avg(transl_err_m), 4) AS transl_err_m FROM per GROUP BY ds""",
    views=("fx_err",),
    ctes=_CENTRED,
)
def summary_by_dataset(spark, sf):
    s = E.summarize(_joint_metrics(spark, sf), ["ds"], ["mpjpe", "abs_mpjpe", "transl_err_m"])
    return s.select(
        "ds",
        "n",
        _r("mpjpe", 3).alias("mpjpe"),
        _r("abs_mpjpe", 3).alias("abs_mpjpe"),
        _r("transl_err_m").alias("transl_err_m"),
    )


@query(
    "error_by_distance_bins",
    """SELECT d.ds, b.bin, round(avg(p.transl_err_m), 4) AS error, count(p.rec) AS n
 FROM (SELECT DISTINCT ds FROM per) d CROSS JOIN bins b
 LEFT JOIN per p ON p.ds = d.ds AND p.gt_depth_m >= b.lo AND p.gt_depth_m < b.hi GROUP BY d.ds, b.bin""",
    views=("fx_err",),
    ctes=_CENTRED
    + """, bins AS (SELECT * FROM (VALUES ('0-10m', 0.0, 10.0), ('10-20m', 10.0, 20.0),
 ('20-30m', 20.0, 30.0), ('>30m', 30.0, 1e300)) AS t(bin, lo, hi))""",
)
def error_by_distance_bins(spark, sf):
    d = E.error_by_distance(
        _joint_metrics(spark, sf), ["ds"], F.col("transl_err_m"), F.col("gt_depth_m")
    )
    return d.select("ds", "bin", _r("error").alias("error"), "n")


@query("pa_mpjpe_by_record")
def pa_mpjpe_by_record(spark, sf):
    d = fx.scored(spark, sf)
    return d.select("rec", "ds", _r(P.pa_mpjpe("gt", "pred", "valid"), 3).alias("pa_mpjpe"))


# in a plane the best rotation in space is a turn or a mirror image, whichever agrees more
_FLAT = """j AS (SELECT rec, joint, g.x AS gx, g.y AS gy, p.x AS px, p.y AS py FROM fx_joints g JOIN fx_pred p USING (rec, joint) WHERE valid),
c AS (SELECT *, gx - avg(gx) OVER r AS ax, gy - avg(gy) OVER r AS ay, px - avg(px) OVER r AS qx, py - avg(py) OVER r AS qy FROM j WINDOW r AS (PARTITION BY rec)),
h AS (SELECT rec, sum(qx*ax) AS xx, sum(qx*ay) AS xy, sum(qy*ax) AS yx, sum(qy*ay) AS yy, sum(qx*qx + qy*qy) AS spread FROM c GROUP BY rec),
t AS (SELECT rec, spread, CASE WHEN turn >= mirror THEN 1 ELSE -1 END AS way, greatest(turn, mirror) AS size,
  CASE WHEN turn >= mirror THEN atan2(xy - yx, xx + yy) ELSE atan2(xy + yx, xx - yy) END AS a
 FROM (SELECT *, sqrt((xx+yy)*(xx+yy) + (xy-yx)*(xy-yx)) AS turn, sqrt((xx-yy)*(xx-yy) + (xy+yx)*(xy+yx)) AS mirror FROM h))"""


@query(
    "pa_mpjpe_planar",
    """SELECT rec, round(1000 * avg(sqrt(dx*dx + dy*dy)), 3) AS pa_mpjpe FROM (
 SELECT rec, size/spread*(cos(a)*qx - sin(a)*way*qy) - ax AS dx, size/spread*(sin(a)*qx + cos(a)*way*qy) - ay AS dy FROM c JOIN t USING (rec))
GROUP BY rec""",
    views=("fx_joints", "fx_pred"),
    ctes=_FLAT,
)
def pa_mpjpe_planar(spark, sf):
    flat = [F.transform(c, lambda p: F.array(p[0], p[1], F.lit(0.0))) for c in ("gt", "pred")]
    d = fx.scored(spark, sf).select("rec", P.pa_mpjpe(*flat, "valid").alias("e"))
    return d.where("e is not null").select("rec", _r("e", 3).alias("pa_mpjpe"))


@query(
    "centred_joints",
    """SELECT rec, round(x - mx, 5) AS x0, round(y - my, 5) AS y0, round(z - mz, 5) AS z0
 FROM fx_joints j LEFT JOIN (SELECT rec AS r, avg(x) mx, avg(y) my, avg(z) mz FROM fx_joints
   WHERE valid GROUP BY rec) m ON m.r = j.rec WHERE joint = 0""",
    views=("fx_joints",),
)
def centred_joints(spark, sf):
    d = fx.joints(spark, sf).select("rec", P.centre_joints(F.col("gt"), F.col("valid")).alias("c"))
    first = F.col("c")[0]
    return d.select("rec", *[_r(first[i], 5).alias(n) for i, n in enumerate(("x0", "y0", "z0"))])


@query(
    "vertex_error",
    """SELECT rec, round(1000*avg(sqrt(pow((px-p0)-(gx-g0),2)+pow((py-p1)-(gy-g1),2)
   +pow((pz-p2)-(gz-g2),2))), 3) AS pve
 FROM fx_err e JOIN (SELECT rec AS r, px p0, py p1, pz p2, gx g0, gy g1, gz g2 FROM fx_err
   WHERE joint = 0) o ON o.r = e.rec GROUP BY rec""",
    views=("fx_err",),
)
def vertex_error(spark, sf):
    d = fx.scored(spark, sf)
    g, p = F.col("gt"), F.col("pred")
    return d.select("rec", _r(P.pve(g, p, g[0], p[0]), 3).alias("pve"))


@query(
    "joints_by_convention",
    """SELECT rec, round(1000*avg(sqrt(pow(p.x-g.x,2)+pow(p.y-g.y,2)+pow(p.z-g.z,2)))
     FILTER (g.valid), 3) AS mpjpe
 FROM fx_joints g LEFT JOIN m ON m.src = g.joint JOIN fx_pred p USING (rec)
 WHERE p.joint = CASE WHEN g.ds % 2 = 0 THEN m.dst ELSE g.joint END GROUP BY rec""",
    views=("fx_joints", "fx_pred"),
    ctes="""m AS (SELECT * FROM (VALUES (0,0),(1,5),(2,7),(3,9),(4,11),(5,13),(6,15),(7,6),(8,8),
 (9,10),(10,12),(11,14),(12,16)) AS t(src, dst))""",
)
def joints_by_convention(spark, sf):
    d = fx.scored(spark, sf)
    conv = F.when(F.col("ds") % 2 == 0, "waymo15").otherwise("smpl24")
    g, p, v = P.comparable(F.col("gt"), F.col("valid"), F.col("pred"), F.col("pred"), conv)
    return d.select("rec", _r(P.mpjpe(g, p, v), 3).alias("mpjpe"))


@query(
    "mapped_keypoints",
    """SELECT g.rec, round(sum(p.x - g.x), 5) AS dx, count(p.x) AS n FROM fx_joints g
 JOIN m ON m.src = g.joint LEFT JOIN fx_joints p ON p.rec = g.rec AND p.joint = m.dst
 GROUP BY g.rec""",
    views=("fx_joints",),
    ctes="""m AS (SELECT * FROM (VALUES (0,-1),(1,5),(2,7),(3,9),(4,11),(5,13),(6,15),(7,6),(8,8),
 (9,10),(10,12),(11,14),(12,16),(13,-1)) AS t(src, dst))""",
)
def mapped_keypoints(spark, sf):
    d = fx.joints(spark, sf).withColumn("to", P.map_joints(F.col("gt"), P.KEYPOINTS14_TO_COCO17))
    gaps = F.zip_with(F.slice("gt", 1, 14), F.col("to"), lambda a, b: b[0] - a[0])
    kept = F.filter(gaps, lambda x: x.isNotNull())
    return d.select(
        "rec",
        _r(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), 5).alias("dx"),
        F.size(kept).cast("long").alias("n"),
    )


@query(
    "keypoint_placement",
    """SELECT rec, round(CASE WHEN bool_and(g.valid) FILTER (g.joint IN (4, 10)) THEN
   sqrt(pow(avg(p.x) FILTER (p.joint IN (11,12)) - avg(g.x) FILTER (g.joint IN (4,10)), 2)
      + pow(avg(p.y) FILTER (p.joint IN (11,12)) - avg(g.y) FILTER (g.joint IN (4,10)), 2)
      + pow(avg(p.z) FILTER (p.joint IN (11,12)) - avg(g.z) FILTER (g.joint IN (4,10)), 2)) END, 5)
   AS transl_err_m
 FROM fx_joints g JOIN fx_pred p USING (rec, joint) GROUP BY rec""",
    views=("fx_joints", "fx_pred"),
)
def keypoint_placement(spark, sf):
    d = fx.scored(spark, sf)
    err = P.keypoint_placement(F.col("gt"), F.col("valid"), F.col("pred"))
    return d.select("rec", _r(err, 5).alias("transl_err_m"))


@query(
    "keypoint_boxes",
    """SELECT rec, CASE WHEN n < 2 THEN 128.0 ELSE round((x0+x1)/2, 4) END AS cx,
  CASE WHEN n < 2 THEN 128.0 ELSE round((y0+y1)/2, 4) END AS cy,
  CASE WHEN n < 2 THEN 256.0 ELSE round(greatest(64, 1.2*greatest(x1-x0, y1-y0)), 4) END AS side
 FROM (SELECT rec, count(*) FILTER (valid) n, min(x) FILTER (valid)*300 x0, max(x) FILTER (valid)*300 x1,
   min(y) FILTER (valid)*300 y0, max(y) FILTER (valid)*300 y1 FROM fx_joints GROUP BY rec)""",
    views=("fx_joints",),
)
def keypoint_boxes(spark, sf):
    d = fx.joints(spark, sf)
    kp = F.zip_with(
        "gt",
        "valid",
        lambda p, v: F.array(p[0] * 300, p[1] * 300, v.cast("double")),
    )
    d = d.select("rec", P.keypoint_box(kp).alias("b"))
    return d.select("rec", *[_r(F.col("b")[i]).alias(n) for i, n in enumerate(("cx", "cy", "side"))])


def _with_duplicates(spark, sf):
    p = fx.predicted(spark, sf).select("rec", F.col("pred")[0][2].alias("z"), F.lit(0).alias("pos"))
    again = p.where(F.col("rec") % 5 == 0).select("rec", (F.col("z") + 1).alias("z"), F.lit(1).alias("pos"))
    return p.unionByName(again)


@query(
    "predictions_attached",
    """SELECT g.ds, count(*) AS n, count(*) FILTER (p.rec IS NULL) AS missing,
  round(avg(p.z + CASE WHEN p.rec % 5 = 0 THEN 1 ELSE 0 END), 5) AS mean_z
 FROM fx_joints g LEFT JOIN fx_pred p USING (rec, joint) WHERE joint = 0 GROUP BY g.ds""",
    views=("fx_joints", "fx_pred"),
)
def predictions_attached(spark, sf):
    gt = fx.joints(spark, sf).select("rec", "ds")
    out = E.attach_predictions(gt, _with_duplicates(spark, sf), "rec")
    return out.groupBy("ds").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("missing"), 1)).alias("missing"),
        _r(F.avg("z"), 5).alias("mean_z"),
    )


@query(
    "missing_predictions",
    """SELECT DISTINCT rec FROM fx_joints WHERE rec NOT IN (SELECT rec FROM fx_pred)""",
    views=("fx_joints", "fx_pred"),
)
def missing_predictions(spark, sf):
    return E.missing_keys(fx.joints(spark, sf), fx.predicted(spark, sf), "rec")


def _box(df):
    return df.withColumn("box", vec(*[F.col(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz", "yaw")]))


def _pred_box(df):
    """The same box moved by its score and a little smaller: a prediction for AP."""
    b = F.col("box")
    return df.withColumn("pred", vec(b[0] + F.col("score") / 2, b[1], b[2], b[3] * 0.9, b[4], b[5], b[6]))


_PRED_IOU = """m AS (SELECT *, (least(cx+dx/2, cx+score/2+dx*0.45) - greatest(cx-dx/2, cx+score/2-dx*0.45))*dy*dz AS inter
  FROM fx_boxes),
iou AS (SELECT *, CASE WHEN inter > 0 THEN inter/(dx*dy*dz*1.9 - inter) ELSE 0 END AS iou FROM m)"""


@query(
    "box_overlap",
    "SELECT rec, round(iou, 5) AS iou FROM iou",
    views=("fx_boxes",),
    ctes=_PRED_IOU,
)
def box_overlap(spark, sf):
    d = _pred_box(_box(spread(fx.boxes(spark, sf))))
    return d.select("rec", _r(B.iou3d("box", "pred"), 5).alias("iou"))


@query(
    "turned_overlap",
    """SELECT rec, round(inter / (a*a + b*b - inter), 6) AS iou FROM (SELECT *, CASE
  WHEN h <= a/2 THEN b*b WHEN h >= a THEN a*a ELSE a*a - 2*(a - h)*(a - h) END AS inter
 FROM (SELECT rec, dx AS a, dz AS b, dz / sqrt(2.0) AS h FROM fx_boxes))""",
    views=("fx_boxes",),
)
def turned_overlap(spark, sf):
    # a square and one around the same middle, an eighth turn on: they share an octagon at most
    d = spread(fx.boxes(spark, sf))
    at = [F.col("cx"), F.col("cy"), F.col("cz")]
    one = F.array(*at, "dx", "dy", "dx", F.col("rec") * 0.37)
    two = F.array(*at, "dz", "dy", "dz", F.col("rec") * 0.37 + math.pi / 4)
    return d.select("rec", _r(B.iou3d(one, two), 6).alias("iou"))


_AP = (
    _PRED_IOU
    + """, t AS (SELECT b.frame, b.rec, b.score, t.thr, CAST(b.iou >= t.thr AS INT) AS tp FROM iou b
  CROSS JOIN (VALUES (0.25), (0.5), (0.7)) AS t(thr)),
r AS (SELECT *, row_number() OVER w AS rn, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS cum,
   count(*) OVER (PARTITION BY frame, thr) AS n FROM t WINDOW w AS (PARTITION BY frame, thr ORDER BY score DESC, rec)),
e AS (SELECT *, max(cum/rn) OVER (PARTITION BY frame, thr ORDER BY score DESC, rec
   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r),
ap AS (SELECT frame, thr, max(n) AS n, sum(tp*env)/max(n) AS ap FROM e GROUP BY frame, thr)"""
)


@query(
    "average_precision",
    """SELECT frame, max(n) AS n, round(max(ap) FILTER (thr = 0.25), 5) AS ap_25,
  round(max(ap) FILTER (thr = 0.5), 5) AS ap_50, round(max(ap) FILTER (thr = 0.7), 5) AS ap_70
 FROM ap GROUP BY frame""",
    views=("fx_boxes",),
    ctes=_AP,
)
def average_precision(spark, sf):
    d = _pred_box(_box(fx.boxes(spark, sf)))
    d = d.withColumn("iou", B.iou3d_aligned(F.col("box"), F.col("pred")))
    ap = E.average_precision(d, ["frame"], "iou", "score", "rec")
    return ap.select("frame", "n", *[_r(c, 5).alias(c) for c in ("ap_25", "ap_50", "ap_70")])


_SUMMARY = (
    _CENTRED
    + ", "
    + _PRED_IOU
    + """, s AS (SELECT per.*, iou.iou, iou.score FROM per LEFT JOIN iou USING (rec)),
t AS (SELECT ds, rec, score, thr, CAST(coalesce(iou, 0) >= thr AS INT) AS tp FROM s CROSS JOIN (VALUES (0.25), (0.5), (0.7)) AS t(thr)),
r AS (SELECT *, row_number() OVER w AS rn, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS cum,
   count(*) OVER (PARTITION BY ds, thr) AS n FROM t WINDOW w AS (PARTITION BY ds, thr ORDER BY score DESC NULLS LAST, rec)),
e AS (SELECT *, max(cum/rn) OVER (PARTITION BY ds, thr ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r),
ap AS (SELECT ds, thr, sum(tp*env)/max(n) AS ap FROM e GROUP BY ds, thr),
wide AS (SELECT ds, max(ap) FILTER (thr = 0.25) AS ap_25, max(ap) FILTER (thr = 0.5) AS ap_50, max(ap) FILTER (thr = 0.7) AS ap_70,
  avg(ap) AS map FROM ap GROUP BY ds)"""
)


@query(
    "metric_summary",
    """SELECT ds, count(*) AS n, round(avg(mpjpe), 3) AS mpjpe, round(avg(abs_mpjpe), 3) AS abs_mpjpe,
  round(avg(transl_err_m), 4) AS transl_err_m, round(avg(iou), 5) AS mean_iou, round(max(ap_25), 5) AS ap_25,
  round(max(ap_50), 5) AS ap_50, round(max(ap_70), 5) AS ap_70, round(max(map), 5) AS map,
  round(avg(transl_err_m) FILTER (gt_depth_m >= 0 AND gt_depth_m < 10), 4) AS err_0_10,
  round(avg(transl_err_m) FILTER (gt_depth_m >= 10 AND gt_depth_m < 20), 4) AS err_10_20,
  round(avg(transl_err_m) FILTER (gt_depth_m >= 20 AND gt_depth_m < 30), 4) AS err_20_30,
  round(avg(transl_err_m) FILTER (gt_depth_m >= 30), 4) AS err_30 FROM s JOIN wide USING (ds) GROUP BY ds""",
    views=("fx_err", "fx_boxes"),
    ctes=_SUMMARY,
)
def metric_summary(spark, sf):
    b = _pred_box(_box(fx.boxes(spark, sf)))
    b = b.select("rec", "score", B.iou3d_aligned(F.col("box"), F.col("pred")).alias("iou"))
    d = _joint_metrics(spark, sf).join(b, "rec", "left")
    s = E.metric_summary(
        d, ["ds"], ["mpjpe", "abs_mpjpe", "transl_err_m"], iou="iou", score="score", key="rec",
        error="transl_err_m", depth="gt_depth_m",
    )
    bins = [_r(F.col("by_distance")[i]["error"]).alias(n) for i, n in enumerate(("err_0_10", "err_10_20", "err_20_30", "err_30"))]
    return s.select(
        "ds", "n", _r("mpjpe", 3).alias("mpjpe"), _r("abs_mpjpe", 3).alias("abs_mpjpe"),
        _r("transl_err_m").alias("transl_err_m"),
        *[_r(c, 5).alias(c) for c in ("mean_iou", "ap_25", "ap_50", "ap_70", "map")], *bins,
    )


@query(
    "mean_average_precision",
    "SELECT round(avg(m), 5) AS mean_map, count(*) AS frames FROM (SELECT frame, avg(ap) AS m FROM ap GROUP BY frame)",
    views=("fx_boxes",),
    ctes=_AP,
)
def mean_average_precision(spark, sf):
    d = _pred_box(_box(fx.boxes(spark, sf)))
    d = d.withColumn("iou", B.iou3d_aligned(F.col("box"), F.col("pred")))
    ap = E.average_precision(d, ["frame"], "iou", "score", "rec")
    return ap.agg(_r(F.avg("map"), 5).alias("mean_map"), F.count(F.lit(1)).alias("frames"))


@query(
    "pairwise_overlap",
    """SELECT frame, a AS rec_a, b AS rec_b, round(inter/(va+vb-inter), 5) AS iou FROM pairs WHERE inter > 0""",
    views=("fx_boxes",),
    ctes="""pairs AS (SELECT a.frame, a.rec AS a, b.rec AS b, a.dx*a.dy*a.dz AS va, b.dx*b.dy*b.dz AS vb,
  greatest(0, least(a.cx+a.dx/2,b.cx+b.dx/2)-greatest(a.cx-a.dx/2,b.cx-b.dx/2))
  *greatest(0, least(a.cy+a.dy/2,b.cy+b.dy/2)-greatest(a.cy-a.dy/2,b.cy-b.dy/2))
  *greatest(0, least(a.cz+a.dz/2,b.cz+b.dz/2)-greatest(a.cz-a.dz/2,b.cz-b.dz/2)) AS inter
 FROM (SELECT * REPLACE (rec // 400 AS frame) FROM fx_boxes) a
 JOIN (SELECT * REPLACE (rec // 400 AS frame) FROM fx_boxes) b ON a.frame = b.frame AND a.rec < b.rec)""",
)
def pairwise_overlap(spark, sf):
    # frames of a size, so that their number grows with the table
    d = _box(fx.boxes(spark, sf)).withColumn("frame", F.floor(F.col("rec") / 400))
    pairs = E.pairwise_iou(d, d, "frame", ("rec", "rec"), aligned=True, once=True)
    return pairs.select("frame", "rec_a", "rec_b", _r("iou", 5).alias("iou"))


@query(
    "box_error_terms",
    """SELECT rec, round(score/2, 5) AS centre, round(dx*0.1, 5) AS size, 0.0E0 AS yaw FROM fx_boxes""",
    views=("fx_boxes",),
)
def box_error_terms(spark, sf):
    d = _pred_box(_box(fx.boxes(spark, sf)))
    d = d.select("rec", B.box_terms(F.col("box"), F.col("pred")).alias("t"))
    return d.select(
        "rec", _r("t.centre", 5).alias("centre"), _r("t.size", 5).alias("size"), "t.yaw"
    )


@query(
    "box_choice_and_scale",
    """SELECT rec, CASE WHEN frame % 2 = 0 THEN round(dx*1.39, 5) ELSE round(dx, 5) END AS dx,
  CASE WHEN frame % 2 = 0 THEN round(dy*1.05, 5) ELSE round(dy, 5) END AS dy,
  CASE WHEN frame % 2 = 0 THEN round(dz*1.45, 5) ELSE round(dz, 5) END AS dz FROM fx_boxes""",
    views=("fx_boxes",),
)
def box_choice_and_scale(spark, sf):
    d = _box(fx.boxes(spark, sf))
    conv = F.when(F.col("frame") % 2 == 0, "waymo15").otherwise("smpl24")
    padded = B.scale_sizes(F.col("box"), conv, {"waymo": B.PADDED_LABEL_SCALE})
    d = d.select("rec", B.select_box(F.col("box"), padded, conv).alias("b"))
    return d.select("rec", *[_r(F.col("b")[3 + i], 5).alias(n) for i, n in enumerate(("dx", "dy", "dz"))])


@query(
    "placed_at_centroid",
    """SELECT p.rec, round(p.x + c.x - r.x, 4) AS x, round(p.y + c.y - r.y, 4) AS y,
  round(p.z + c.z - r.z, 4) AS z
 FROM fx_pred p JOIN fx_pred r ON r.rec = p.rec AND r.joint = 0
 JOIN (SELECT rec, avg(x) x, avg(y) y, avg(z) z FROM fx_points GROUP BY rec) c ON c.rec = p.rec
 WHERE p.joint = 1
 UNION ALL SELECT p.rec, round(p.x, 4), round(p.y, 4), round(p.z, 4) FROM fx_pred p
 WHERE p.joint = 1 AND p.rec NOT IN (SELECT rec FROM fx_points)""",
    views=("fx_pred", "fx_points"),
)
def placed_at_centroid(spark, sf):
    from tallyfield.operators.labels import place_at_centroid

    p = fx.predicted(spark, sf)
    c = E.centroid(fx.points(spark, sf), ["rec"])
    out = place_at_centroid(p, c, "rec", "pred")
    j = F.col("pred")[1]
    return out.select("rec", *[_r(j[i]).alias(n) for i, n in enumerate("xyz")])


@query(
    "cloud_centroids",
    """SELECT cloud, round(avg(x) FILTER (channel <> 3), 5) AS x, round(avg(y) FILTER (channel <> 3), 5) AS y,
  round(avg(z) FILTER (channel <> 3), 5) AS z, bool_or(channel <> 3) AS any_valid FROM fx_points GROUP BY cloud""",
    views=("fx_points",),
)
def cloud_centroids(spark, sf):
    c = E.centroid(fx.points(spark, sf), ["cloud"], F.col("channel") != 3)
    return c.select("cloud", *[_r(n, 5).alias(n) for n in "xyz"], "any_valid")


@query(
    "cloud_boxes",
    """SELECT cloud, round((min(x)+max(x))/2, 5) AS cx, round((min(y)+max(y))/2, 5) AS cy,
  round((min(z)+max(z))/2, 5) AS cz, round(max(x)-min(x), 5) AS dx, round(max(y)-min(y), 5) AS dy,
  round(max(z)-min(z), 5) AS dz FROM fx_points GROUP BY cloud""",
    views=("fx_points",),
)
def cloud_boxes(spark, sf):
    b = E.aabb(fx.points(spark, sf), ["cloud"])
    return b.select("cloud", *[_r(c, 5).alias(c) for c in b.columns if c != "cloud"])


@query(
    "oriented_cloud_boxes",
    """SELECT cloud, round(cos(yaw)*ma - sin(yaw)*mb, 4) AS cx, round(sin(yaw)*ma + cos(yaw)*mb, 4) AS cz,
  round(da, 4) AS dx, round(db, 4) AS dz FROM (
 SELECT cloud, yaw, (min(a)+max(a))/2 ma, (min(b)+max(b))/2 mb, max(a)-min(a) da, max(b)-min(b) db FROM (
  SELECT cloud, yaw, cos(yaw)*x + sin(yaw)*z AS a, cos(yaw)*z - sin(yaw)*x AS b FROM (
   SELECT *, (cloud % 7) / 10.0E0 AS yaw FROM fx_points)) GROUP BY cloud, yaw)""",
    views=("fx_points",),
)
def oriented_cloud_boxes(spark, sf):
    yaw = (F.col("cloud") % 7) / F.lit(10.0)
    b = E.oriented_box(fx.points(spark, sf), ["cloud"], yaw)
    return b.select("cloud", *[_r(c).alias(c) for c in ("cx", "cz", "dx", "dz")])


@query(
    "cloud_pixel_boxes",
    """SELECT cloud, CASE WHEN ok THEN round(x0, 4) END AS x0, CASE WHEN ok THEN round(y0, 4) END AS y0,
  CASE WHEN ok THEN round(x1, 4) END AS x1, CASE WHEN ok THEN round(y1, 4) END AS y1 FROM (
 SELECT *, x1 > x0 AND y1 > y0 AS ok FROM (SELECT cloud, least(greatest(min(u),0),255) x0,
  least(greatest(min(v),0),255) y0, least(greatest(max(u),0),255) x1, least(greatest(max(v),0),255) y1
 FROM (SELECT cloud, 200*x/z + 128 AS u, 200*y/z + 128 AS v FROM fx_points WHERE z > 3) GROUP BY cloud))
""",
    views=("fx_points",),
)
def cloud_pixel_boxes(spark, sf):
    d = fx.points(spark, sf)
    cam = camera(F.lit(200.0), F.lit(200.0), F.lit(128.0), F.lit(128.0))
    uv = project(vec(F.col("x"), F.col("y"), F.col("z")), cam, z_min=3.0)
    px = d.select("cloud", uv.alias("uv")).select(
        "cloud", F.col("uv")[0].alias("u"), F.col("uv")[1].alias("v")
    )
    b = E.bbox2d(px, ["cloud"], 256, 256)
    return b.select("cloud", *[_r(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
