"""Source and collection-statistics queries; files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import text as X
from tallyfield.functions import vectors as V
from tallyfield.functions.vectors import vec
from tallyfield.operators import collections as C
from tallyfield.operators import labels as L
from tallyfield.operators import sequences as S
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query
from tallyfield.session import scratch_path
from tallyfield.sources import readers as R
from tallyfield.sources import tokens as K


def _r(col, n=4):
    return F.round(col, n)


@query(
    "token_tables_read",
    """SELECT r_name AS category, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS ridden FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def token_tables_read(spark, sf):
    root = scratch_path(spark, "tokens")
    t = lambda c: c.cast("string").alias
    o, c = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer")
    n, r = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    tables = {
        "sample_annotation": o.select(
            t(F.col("o_orderkey"))("token"), F.lit("s").alias("sample_token"), t(F.col("o_custkey"))("instance_token"),
            F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a0"))).otherwise(F.array(F.lit("a1"))).alias("attribute_tokens"),
        ),
        "instance": c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
            t(F.col("c_custkey"))("token"), t(F.col("n_regionkey"))("category_token")
        ),
        "category": r.select(t(F.col("r_regionkey"))("token"), F.col("r_name").alias("name")),
        "sample": spark.range(1).select(F.lit("s").alias("token"), F.lit("x").alias("scene_token")),
    }
    for version in ("v1.9-mini", "v1.10-mini"):
        for name in K.TOKEN_TABLES:
            if name in tables:
                tables[name].write.json(f"{root}/{version}/{name}.json")
            else:
                r.where(F.lit(False)).select(F.lit("x").alias("token")).write.json(f"{root}/{version}/{name}.json")
    got = K.read_nusc(spark, root, lines=True)
    d = K.annotations_of(got)
    riders = F.array(F.lit("a0"))
    return d.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.arrays_overlap("attribute_tokens", riders), 1)).alias("ridden"),
    )


@query(
    "rig_from_tokens",
    """SELECT 'ch' || (s_suppkey % 6) AS channel, min(s_suppkey) AS first, true AS rigid, min(s_suppkey) + 100 AS width FROM supplier GROUP BY 1""",
)
def rig_from_tokens(spark, sf):
    s = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    token = F.format_string("%08d", k)
    calib = s.select(
        token.alias("token"), F.concat(F.lit("t"), (k % 6).cast("string")).alias("sensor_token"),
        vec(k, 0.0, 1.0).alias("translation"), vec(1.0, 0.1, 0.2, 0.3).alias("rotation"),
        F.array(vec(1.0, 0.0, 0.0)).alias("camera_intrinsic"),
    )
    sensor = s.select(
        F.concat(F.lit("t"), (k % 6).cast("string")).alias("token"),
        F.concat(F.lit("ch"), (k % 6).cast("string")).alias("channel"), F.lit("camera").alias("modality"),
    ).distinct()
    data = s.select(
        token.alias("token"), token.alias("calibrated_sensor_token"), (k + 100).cast("int").alias("width"),
        F.lit(10).alias("height"),
    )
    rig = K.rig_sensors({"calibrated_sensor": calib, "sensor": sensor, "sample_data": data})
    return rig.select("channel", F.col("pose")[3].cast("long").alias("first"), "rigid", F.col("width").cast("long").alias("width"))


@query(
    "first_per_key",
    """SELECT c_nationkey AS nation, min(c_custkey) AS cust, arg_min(c_acctbal, c_custkey) AS acctbal FROM customer WHERE c_acctbal > 0 GROUP BY 1""",
)
def first_per_key(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("acctbal")
    )
    return C.first_per(c, ["nation"], ["cust"], F.col("acctbal") > 0)


@query(
    "camera_tables_read",
    "SELECT source, count(*) AS n, round(sum(value), 4) AS hfov FROM fx_tracks GROUP BY source",
    views=("fx_tracks",),
)
def camera_tables_read(spark, sf):
    path = scratch_path(spark, "camera")
    d = _cameras(spark, sf)
    d.select("name", "x", "y", "z", "pitch", "hfov", "source").write.partitionBy("source").option("header", "true").csv(path)
    got = R.read_camera_csv(spark, path)
    got = got.withColumn("source", F.regexp_extract("file", r"source=([^/]*)/", 1))
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("hfov")).alias("hfov"))


def _cameras(spark, sf):
    t = fx.tracks(spark, sf)
    return t.select(
        F.format_string("img_%08d.png", "rec").alias("name"),
        (F.col("value") * 10).alias("x"), (F.col("rec") % 50).cast("double").alias("y"),
        (F.col("value") * 3).alias("z"), (F.col("rec") % 31 - 15).cast("double").alias("pitch"),
        F.col("value").alias("hfov"), "source", F.col("track").alias("file"), "rec",
    )


@query(
    "camera_statistics",
    """SELECT source, count(*) AS frames, round(median(value*3/100), 5) AS height_median, round(quantile_cont(value*3/100, 0.1), 5) AS height_p10,
  round(quantile_cont(rec % 31 - 15, 0.9), 4) AS pitch_p90, round(median(value), 4) AS hfov_median, round(median(sp), 4) AS speed_median FROM (SELECT *,
  sqrt(pow(value/10 - lag(value/10) OVER w, 2) + pow((rec % 50)/100.0 - lag((rec % 50)/100.0) OVER w, 2) + pow(value*3/100 - lag(value*3/100) OVER w, 2))*30 AS sp
  FROM fx_tracks WINDOW w AS (PARTITION BY source, track ORDER BY rec)) GROUP BY source""",
    views=("fx_tracks",),
)
def camera_statistics(spark, sf):
    d = C.camera_stats(_cameras(spark, sf), "source")
    return d.select(
        "source", "frames", _r("height_median", 5).alias("height_median"), _r("height_p10", 5).alias("height_p10"),
        _r("pitch_p90").alias("pitch_p90"), _r("hfov_median").alias("hfov_median"), _r("speed_median").alias("speed_median"),
    )


@query(
    "camera_speeds",
    """SELECT rec, round(abs(value - lag(value) OVER (PARTITION BY track ORDER BY us, rec))*30, 4) AS speed FROM fx_tracks""",
    views=("fx_tracks",),
)
def camera_speeds(spark, sf):
    d = S.speed(fx.tracks(spark, sf), ["track"], ["us", "rec"], ["value"])
    return d.select("rec", _r("speed").alias("speed"))


@query(
    "cuboid_documents_read",
    """SELECT rec, cx AS x, CAST(rec % 60 AS INT) AS num_points, CASE WHEN rec % 3 = 0 THEN 'PEDESTRIAN' ELSE 'CAR' END AS type FROM fx_boxes""",
    views=("fx_boxes",),
)
def cuboid_documents_read(spark, sf):
    path = scratch_path(spark, "cuboids")
    b = fx.boxes(spark, sf)
    num = F.array(F.struct(F.lit("num_points").alias("name"), (F.col("rec") % 60).cast("double").alias("val")))
    cuboid = F.struct(
        vec(F.col("cx"), F.col("cy"), F.col("cz")).alias("val"), F.struct(num.alias("num")).alias("attributes")
    )
    kind = F.when(F.col("rec") % 3 == 0, "PEDESTRIAN").otherwise("CAR")
    obj = F.struct(F.struct(kind.alias("type"), cuboid.alias("cuboid")).alias("object_data"))
    one = F.create_map(F.col("rec").cast("string"), obj)
    frames = F.create_map(F.col("frame").cast("string"), F.struct(one.alias("objects")))
    b.select(F.struct(frames.alias("frames")).alias("openlabel")).write.json(path)
    got = R.read_openlabel(spark, path, lines=True)
    return got.select(F.col("object").cast("long").alias("rec"), F.col("cuboid")[0].alias("x"), "num_points", "type")


@query(
    "calibration_read",
    """SELECT name, kind, count(*) AS n, round(max(deg), 4) AS max_deg, max(f) AS f_u FROM (
 SELECT 'CAM_' || CASE s_suppkey % 5 + 1 WHEN 1 THEN 'FRONT' WHEN 2 THEN 'FRONT_LEFT' WHEN 3 THEN 'FRONT_RIGHT' WHEN 4 THEN 'SIDE_LEFT' ELSE 'SIDE_RIGHT' END AS name,
   'camera' AS kind, NULL::DOUBLE AS deg, s_suppkey::DOUBLE AS f FROM supplier
 UNION ALL SELECT 'LIDAR_' || CASE s_suppkey % 5 + 1 WHEN 1 THEN 'TOP' WHEN 2 THEN 'FRONT' WHEN 3 THEN 'SIDE_LEFT' WHEN 4 THEN 'SIDE_RIGHT' ELSE 'REAR' END, 'lidar', degrees(s_suppkey / 1000.0E0), NULL FROM supplier) GROUP BY ALL""",
)
def calibration_read(spark, sf):
    root = scratch_path(spark, "calibration")
    s = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    eye = V.se3(vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), vec(0.0, 0.0, 0.0))
    cam, lid = "[CameraCalibrationComponent]", "[LiDARCalibrationComponent]"
    names = ("f_u", "f_v", "c_u", "c_v", "k1", "k2", "p1", "p2", "k3")
    s.select(
        (k % 5 + 1).alias("key.camera_name"), eye.alias(f"{cam}.extrinsic.transform"),
        *[k.cast("double").alias(f"{cam}.intrinsic.{n}") for n in names],
        F.lit(1920).alias(f"{cam}.width"), F.lit(1280).alias(f"{cam}.height"),
    ).write.parquet(f"{root}/val/camera_calibration/seg1.parquet")
    s.select(
        (k % 5 + 1).alias("key.laser_name"), eye.alias(f"{lid}.extrinsic.transform"),
        (-k / 1000.0).alias(f"{lid}.beam_inclination.min"), (k / 1000.0).alias(f"{lid}.beam_inclination.max"),
    ).write.parquet(f"{root}/val/lidar_calibration/seg1.parquet")
    d = R.read_calibration(spark, root, "val")
    return d.groupBy("name", "kind").agg(
        F.count(F.lit(1)).alias("n"), _r(F.max("beam.max_deg")).alias("max_deg"), F.max("intrinsics.f_u").alias("f_u")
    )


@query(
    "track_frames_sampled",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
 WHERE n <= 3 OR i IN (SELECT CAST(round_even(j * ((n - 1) / 2.0E0), 0) AS BIGINT) FROM range(3) t(j))""",
)
def track_frames_sampled(spark, sf):
    path = scratch_path(spark, "tracks")
    c = fx.table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("f"))
    # a track document holds its frames by nature
    c.groupBy("conv_id").agg(F.array_sort(F.collect_list("f")).alias("frames")).write.json(path)
    # the heavy field is left out of the schema, so it is never parsed into memory
    docs = spark.read.schema("conv_id long, frames array<struct<turn: long, role: string>>").json(path)
    return R.sample_track_frames(docs, 3, keep=("conv_id",)).select("conv_id", "turn")


@query(
    "motion_configs",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '?' ELSE lang END AS config_type, CASE WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'no' END AS follows,
  CASE WHEN doc_id % 3 = 0 THEN source ELSE 'none' END AS shake, n_chars || '..? cm' AS height, '20-' || (30 + doc_id % 7) || ', 50-60' AS hfov FROM documents""",
)
def motion_configs(spark, sf):
    d = fx.table(spark, sf, "documents")
    cfg = F.struct(
        (F.col("n_chars") % 2 == 0).alias("follow"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("camera_shake"),
        F.col("n_chars").alias("camera_height_min"),
        F.array(F.array(F.lit(20.0), F.lit(30.0) + F.col("doc_id") % 7), F.array(F.lit(50.0), F.lit(60.0))).alias("hfov_ranges"),
    )
    info = F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("config_type"), cfg.alias("config"))
    d = d.select("doc_id", F.to_json(F.struct(info.alias("info"))).alias("json"))
    return R.motion_configs(d, "doc_id", "json")


@query(
    "file_inventory",
    """SELECT source, count(DISTINCT doc_id % 20) AS sequences, count(*) FILTER (lang = 'en') AS en_files, coalesce(sum(n_chars) FILTER (lang = 'en'), 0)::BIGINT AS en_bytes,
  bool_or(lang = 'en') AS has_en, count(*) FILTER (lang = 'xx') AS xx_files, 0::BIGINT AS xx_bytes, false AS has_xx FROM documents GROUP BY source""",
)
def file_inventory(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        "source", (F.col("doc_id") % 20).alias("sequence"), F.col("lang").alias("kind"), F.col("n_chars").alias("length")
    )
    return C.inventory(d, "source", ["en", "xx"])


def _placements(spark, sf):
    t = fx.tracks(spark, sf)
    r = F.col("rec")
    comment = F.when(r % 5 == 0, F.concat(F.lit("seq_"), r.cast("string"), F.lit(";cam=a"))).otherwise(
        F.concat(
            F.when(r % 3 == 0, F.concat(F.lit("texture_clothing=c"), (r % 7).cast("string"), F.lit(";"))).otherwise(""),
            F.lit("junk;hair=h=x"), (r % 4).cast("string"),
            F.when(r % 2 == 0, F.concat(F.lit(";shoe=s"), (r % 6).cast("string"))).otherwise(""),
        )
    )
    return t.select(
        "source", "rec", F.when(r % 5 == 0, "Group").otherwise("Body").alias("type"), comment.alias("comment"),
        F.concat(F.lit("b"), F.col("track").cast("string")).alias("body"),
    )


@query(
    "placement_statistics",
    """SELECT source, count(DISTINCT g) AS sequences, count(*) AS bodies, count(DISTINCT track) AS subjects, count(DISTINCT CASE WHEN rec % 3 = 0 THEN rec % 7 ELSE -1 END) AS clothing,
  count(DISTINCT rec % 4) AS hair, count(DISTINCT CASE WHEN rec % 2 = 0 THEN rec % 6 END) AS shoes, max(med) AS bodies_per_sequence FROM (
 SELECT *, coalesce(last_value(CASE WHEN rec % 5 = 0 THEN rec END IGNORE NULLS) OVER (PARTITION BY source ORDER BY rec ROWS UNBOUNDED PRECEDING), -1) AS g FROM fx_tracks) JOIN (
  SELECT source AS s, median(n) AS med FROM (SELECT source, g, count(*) FILTER (rec % 5 <> 0) AS n FROM (SELECT *, coalesce(last_value(CASE WHEN rec % 5 = 0 THEN rec END IGNORE NULLS)
  OVER (PARTITION BY source ORDER BY rec ROWS UNBOUNDED PRECEDING), -1) AS g FROM fx_tracks) GROUP BY ALL) WHERE n > 0 GROUP BY 1) ON s = source WHERE rec % 5 <> 0 GROUP BY source""",
    views=("fx_tracks",),
)
def placement_statistics(spark, sf):
    return C.placement_stats(_placements(spark, sf), "source", ["rec"])


@query(
    "groups_filled",
    """SELECT rec, CAST(last_value(CASE WHEN rec % 5 = 0 THEN rec END IGNORE NULLS) OVER (PARTITION BY source ORDER BY rec ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS group_name FROM fx_tracks""",
    views=("fx_tracks",),
)
def groups_filled(spark, sf):
    t = fx.tracks(spark, sf)
    d = S.fill_group(t, ["source"], ["rec"], F.col("rec") % 5 == 0, F.col("rec").cast("string"))
    return d.select("rec", "group_name")


@query(
    "label_statistics",
    """SELECT ds, count(*) AS rows, round(stddev_pop(x), 5) AS beta0_std, round(median(z), 5) AS depth_median, round(quantile_cont(z, 0.1), 5) AS depth_p10,
  round(quantile_cont(z, 0.9), 5) AS depth_p90, round(median(200*(1 + rec % 7)), 4) AS side_median FROM fx_joints WHERE joint = 0 GROUP BY ds""",
    views=("fx_joints",),
)
def label_statistics(spark, sf):
    d = fx.joints(spark, sf).select("ds", "rec", F.col("gt")[0].alias("p"))
    out = C.label_stats(d, ["ds"], F.col("p")[2], 200.0 * (1 + F.col("rec") % 7), F.col("p")[0])
    digits = [c for c in out.columns if c not in ("ds", "rows")]
    return out.select("ds", "rows", *[_r(c, 5).alias(c) for c in digits])


@query(
    "feature_means",
    "SELECT label, round(avg(list_extract(embedding, 1)::DOUBLE), 5) AS f0, round(avg(list_extract(embedding, 64)::DOUBLE), 5) AS f63 FROM embeddings GROUP BY label",
)
def feature_means(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    d = L.mean_vector(e.select("label", F.transform("embedding", lambda v: v.cast("double")).alias("e")), ["label"], "e")
    return d.select("label", _r(F.col("e")[0], 5).alias("f0"), _r(F.col("e")[63], 5).alias("f63"))


@query(
    "comments_parsed",
    """SELECT page_id, 'p' || page_id || '=x' AS a, CASE WHEN page_id % 2 = 0 THEN url END AS b FROM pages""",
)
def comments_parsed(spark, sf):
    p = fx.table(spark, sf, "pages")
    text = F.concat(
        F.lit("a=p"), F.col("page_id").cast("string"), F.lit("=x;noise;"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("b="), "url")).otherwise(""),
    )
    kv = X.parse_kv(text)
    return p.select(
        "page_id", F.try_element_at(kv, F.lit("a")).alias("a"), F.try_element_at(kv, F.lit("b")).alias("b")
    )


@query(
    "ids_decoded",
    """SELECT doc_id, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS uuid FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)""",
)
def ids_decoded(spark, sf):
    raw = F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))
    b64 = F.regexp_replace(F.translate(F.base64(raw), "+/", "-_"), "=+$", "")
    return fx.table(spark, sf, "documents").select("doc_id", X.b64url_to_uuid(b64).alias("uuid"))


@query(
    "predictions_scored",
    "SELECT rec, round(2*x + z, 5) AS depth FROM fx_joints WHERE joint = 0",
    views=("fx_joints",),
)
def predictions_scored(spark, sf):
    d = fx.joints(spark, sf).select("rec", F.col("gt")[0][0].alias("x"), F.col("gt")[0][2].alias("z"))

    def predict(batch):
        return batch[["rec"]].assign(depth=2 * batch["x"] + batch["z"])

    return R.score_batches(d, predict, "rec long, depth double").select("rec", _r("depth", 5).alias("depth"))


@query(
    "rig_lidar_poses",
    "SELECT s_suppkey AS rig, 0.0E0 AS x, -1.5E0 AS y, s_suppkey - 1.0E0 AS z, 1.0E0 AS right, 1.0E0 AS down, 1.0E0 AS forward FROM supplier",
)
def rig_lidar_poses(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rig"))
    eye = vec(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    cam = s.select("rig", F.lit("cam").alias("name"), V.se3(eye, vec(1.0, 0.0, 0.0)).alias("pose"))
    lid = s.select("rig", F.lit("lidar").alias("name"), V.se3(eye, vec(F.col("rig"), 0.0, 1.5)).alias("pose"))
    optical = vec(0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 1.0, 0.0, 0.0)
    d = R.rig_pose(cam.unionByName(lid), "cam", "lidar", optical)
    d = d.withColumn("pose", V.remap_pose_axes(F.col("pose"), V.CAMERA_FROM_FORWARD_LEFT_UP))
    t = V.parts_of(V.translation_of(F.col("pose")))
    facing = [F.col("pose")[5 * i].alias(n) for i, n in enumerate(("right", "down", "forward"))]
    return d.select("rig", *[(t[i] + 0.0).alias(n) for i, n in enumerate("xyz")], *facing)
