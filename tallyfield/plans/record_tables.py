"""Record queries: keys, filters, gates, checks, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import pose as P
from tallyfield.functions.boxes import box_corners
from tallyfield.functions.vectors import vec
from tallyfield.operators import records as R
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query
from tallyfield.session import scratch_path
from tallyfield.sources import tables as T


def _r(col, n=4):
    return F.round(col, n)


@query(
    "records_read_back",
    "SELECT ds, count(*) AS n, sum(rec)::BIGINT AS rec_sum FROM fx_records GROUP BY ds",
    views=("fx_records",),
)
def records_read_back(spark, sf):
    base = scratch_path(spark, "records")
    d = fx.records(spark, sf)
    for ds in range(4):
        T.write_records(d.where(F.col("ds") == ds), f"{base}/part{ds}")
    d.groupBy("ds").count().write.parquet(f"{base}/part0/job_stats.parquet")
    got = T.read_records(spark, [f"{base}/part{i}" for i in range(4)], schema=d.schema)
    return got.groupBy("ds").agg(F.count(F.lit(1)).alias("n"), F.sum("rec").alias("rec_sum"))


@query(
    "records_of_first_files",
    "SELECT count(*) AS n, min(ds) AS lo, max(ds) AS hi FROM fx_records WHERE ds < 2",
    views=("fx_records",),
)
def records_of_first_files(spark, sf):
    base = scratch_path(spark, "records")
    d = fx.records(spark, sf).repartition("ds")
    d.withColumn("shard", F.col("ds")).write.partitionBy("shard").parquet(base)
    return T.limit_files(spark.read.parquet(base), 2, r"shard=\d+").agg(
        F.count(F.lit(1)).alias("n"), F.min("ds").alias("lo"), F.max("ds").alias("hi")
    )


@query(
    "records_in_blocks",
    "SELECT count(*) AS n, true AS bounded FROM fx_records",
    views=("fx_records",),
)
def records_in_blocks(spark, sf):
    path = scratch_path(spark, "blocks")
    T.write_records(fx.records(spark, sf), path, 512)
    per = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).count()
    return per.agg(F.sum("count").alias("n"), (F.max("count") <= 512).alias("bounded"))


@query(
    "columns_updated",
    """SELECT rec, CASE WHEN rec % 7 = 0 THEN box_h + 1 ELSE box_h END AS box_h,
  CASE WHEN rec % 7 = 0 THEN label_conf END AS conf2 FROM fx_records""",
    views=("fx_records",),
)
def columns_updated(spark, sf):
    d = fx.records(spark, sf)
    new = d.where(F.col("rec") % 7 == 0).select(
        "key", (F.col("box_h") + 1).alias("box_h"), F.col("label_conf").alias("conf2")
    )
    return R.update_columns(d, new).select("rec", "box_h", "conf2")


@query(
    "points_capped",
    """SELECT cloud, count(*) AS n, sum(idx % 1000003)::BIGINT AS idx_sum FROM (SELECT *, row_number() OVER
  (PARTITION BY cloud ORDER BY idx) AS rn FROM fx_points) WHERE rn <= 256 GROUP BY cloud""",
    views=("fx_points",),
)
def points_capped(spark, sf):
    from tallyfield.operators.points import cap_points

    kept = cap_points(fx.points(spark, sf), 256)
    return kept.groupBy("cloud").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("idx") % 1000003).alias("idx_sum")
    )


@query(
    "latest_version",
    """SELECT arg_max('v' || CAST(size // 10 AS VARCHAR) || '.' || CAST(size % 10 AS VARCHAR) || '-mini', size)
  AS version FROM (SELECT p_size AS size FROM part)""",
)
def latest_version(spark, sf):
    size = F.col("p_size").cast("long")
    name = F.format_string("v%d.%d-mini", F.floor(size / 10), size % 10)
    return T.latest_version(fx.table(spark, sf, "part").select(name.alias("version")))


@query(
    "archive_members",
    """SELECT member FROM m WHERE member LIKE '%.csv' OR (seq % 3 = 0 AND seq < 10 AND frame % 6 = 0)""",
    ctes="""m AS (SELECT page_id % 20 AS seq, page_id % 1000 AS frame, CASE WHEN page_id % 50 = 7 THEN 'gt/camera_' || page_id || '.csv'
  ELSE 'png/seq_' || lpad(CAST(page_id % 20 AS VARCHAR), 6, '0') || '_' || lpad(CAST(page_id % 1000 AS VARCHAR), 4, '0') || '.png' END
  AS member FROM pages)""",
)
def archive_members(spark, sf):
    i = F.col("page_id")
    name = F.when(i % 50 == 7, F.concat(F.lit("gt/camera_"), i.cast("string"), F.lit(".csv"))).otherwise(
        F.format_string("png/seq_%06d_%04d.png", i % 20, i % 1000)
    )
    return T.select_members(fx.table(spark, sf, "pages").select(name.alias("member")), [0, 3, 6, 9], 6)


@query(
    "record_keys",
    """SELECT key, rec // 100 AS grp, 'ds' || ds || '/seq' || seq || '/0' AS track, rec / 1e6 AS time_s FROM fx_records""",
    views=("fx_records",),
)
def record_keys(spark, sf):
    d = fx.records(spark, sf).select("rec", "ds", "seq")
    d = d.withColumn("a", F.concat(F.lit("ds"), "ds")).withColumn("b", F.concat(F.lit("seq"), "seq"))
    d = R.with_track(R.with_key(d.withColumn("p", F.lit("0")), ["a", "b", "rec", "p"]))
    return d.select("key", F.floor(F.col("rec") / 100).alias("grp"), "track", "time_s")


@query(
    "image_ids",
    """SELECT id, string_split(id, '_')[1] AS frame, string_split(id, '_')[2] AS camera,
  substr(id, length(string_split(id, '_')[1]) + length(string_split(id, '_')[2]) + 3) AS object
 FROM (SELECT rec || '_' || ds || '_obj_' || seq AS id FROM fx_records)""",
    views=("fx_records",),
)
def image_ids(spark, sf):
    d = fx.records(spark, sf)
    d = d.select(F.concat_ws("_", "rec", "ds", F.lit("obj"), "seq").alias("id"))
    return d.select("id", R.parse_image_id(F.col("id")).alias("p")).select("id", "p.*")


_SCANS = """scans AS (SELECT rec, count(*) AS points FROM fx_points GROUP BY rec)"""


def _counts(spark, sf):
    return fx.points(spark, sf).groupBy("rec").agg(F.count(F.lit(1)).alias("points"))


@query(
    "records_with_box",
    "SELECT ds, count(*) AS n FROM fx_records WHERE box_h >= 90 AND box_w >= 35 GROUP BY ds",
    views=("fx_records",),
)
def records_with_box(spark, sf):
    d = R.filter_box(fx.records(spark, sf))
    return d.groupBy("ds").agg(F.count(F.lit(1)).alias("n"))


@query(
    "records_with_points",
    "SELECT rec, ds FROM fx_records WHERE rec IN (SELECT rec FROM scans WHERE points >= 5)",
    views=("fx_records", "fx_points"),
    ctes=_SCANS,
)
def records_with_points(spark, sf):
    scans = _counts(spark, sf).select("rec", F.lit("check").alias("variant"), F.col("points").alias("count"))
    return R.filter_points(fx.records(spark, sf), scans, 5, on="rec").select("rec", "ds")


@query(
    "gate_reasons",
    """SELECT ds, CASE WHEN box_h < 90 OR box_w < 35 THEN 'rejected_box' WHEN coalesce(points, 0) < 4
  THEN 'rejected_points' ELSE 'accepted' END AS status, count(*) AS n FROM fx_records LEFT JOIN scans USING (rec)
 GROUP BY ALL""",
    views=("fx_records", "fx_points"),
    ctes=_SCANS,
)
def gate_reasons(spark, sf):
    d = fx.records(spark, sf).join(_counts(spark, sf), "rec", "left")
    return R.gate_records(d, n=4).groupBy("ds", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "worker_stats",
    """SELECT ds, sum(n)::BIGINT AS samples, sum(k)::BIGINT AS records FROM (SELECT ds, seq, count(*) n,
  count(*) FILTER (has_smpl) k FROM fx_records GROUP BY ds, seq) GROUP BY ROLLUP (ds)""",
    views=("fx_records",),
)
def worker_stats(spark, sf):
    per_worker = fx.records(spark, sf).groupBy("ds", "seq").agg(
        F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("has_smpl"), 1)).alias("records")
    )
    return R.merge_stats(per_worker, "ds", ["samples", "records"])


@query(
    "masked_points",
    """SELECT cloud, count(*) AS n FROM (SELECT cloud, col < 64 AS m, count(*) FILTER (col < 64)
  OVER (PARTITION BY cloud) AS k FROM fx_points) WHERE m OR k < 80 GROUP BY cloud""",
    views=("fx_points",),
)
def masked_points(spark, sf):
    d = R.masked_or_all(fx.points(spark, sf), F.col("col") < 64, ["cloud"], 80)
    return d.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"))


@query(
    "frame_strides",
    """SELECT rec, 'number' AS rule FROM fx_records WHERE rec % 6 = 0 UNION ALL
 SELECT rec, 'position' FROM (SELECT rec, row_number() OVER (PARTITION BY ds ORDER BY rec) AS rn FROM fx_records)
 WHERE (rn - 1) % 5 = 0""",
    views=("fx_records",),
)
def frame_strides(spark, sf):
    d = fx.records(spark, sf)
    a = R.stride_by_number(d, 6, "rec").select("rec", F.lit("number").alias("rule"))
    b = R.stride_by_position(d, 5, ["ds"], ["rec"]).select("rec", F.lit("position").alias("rule"))
    return a.unionByName(b)


@query(
    "complete_frames",
    """SELECT complete, count(*) AS n FROM (SELECT l_orderkey, bool_or(l_linenumber % 3 = 0) AND
  bool_or(l_linenumber % 3 = 1) AS complete FROM lineitem GROUP BY l_orderkey) GROUP BY complete""",
)
def complete_frames(spark, sf):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "png").when(F.col("l_linenumber") % 3 == 1, "depth").otherwise("mask")
    files = fx.table(spark, sf, "lineitem").select("l_orderkey", kind.alias("kind"))
    out = R.complete_frames(files, ["l_orderkey"])
    return out.groupBy("complete").agg(F.count(F.lit(1)).alias("n"))


@query(
    "frames_all_valid",
    "SELECT l_orderkey AS frame FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity < 40)",
)
def frames_all_valid(spark, sf):
    d = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame"), (F.col("l_quantity") < 40).alias("ok")
    )
    return R.all_valid(d, ["frame"], "ok")


@query(
    "joint_flags",
    """SELECT rec, count(*) FILTER (NOT (joint IN (2, 5) OR (x = 0 AND y = 0 AND z = 0)))
  AS n FROM fx_joints GROUP BY rec""",
    views=("fx_joints",),
)
def joint_flags(spark, sf):
    d = fx.joints(spark, sf).select("rec", P.joint_valid(F.col("gt"), F.array(F.lit(2), F.lit(5))).alias("v"))
    return d.select("rec", F.size(F.filter("v", lambda v: v)).cast("long").alias("n"))


@query(
    "records_in_split",
    "SELECT rec FROM fx_records WHERE seq IN (SELECT c_custkey % 20 FROM customer WHERE c_nationkey = 3)",
    views=("fx_records",),
)
def records_in_split(spark, sf):
    ids = fx.table(spark, sf, "customer").where(F.col("c_nationkey") == 3)
    ids = ids.select((F.col("c_custkey") % 20).alias("seq")).distinct()
    return R.in_split(fx.records(spark, sf), ids, "seq").select("rec")


_PIN = """((200*({x})/({z})+128) BETWEEN 0 AND 255.999999 AND (200*({y})/({z})+128) BETWEEN 0 AND 255.999999 AND ({z}) > 0.5)"""
_ALL_IN = " AND ".join(
    _PIN.format(x=f"cx{a}dx/2", y=f"cy{b}dy/2", z=f"cz{c}dz/2") for a in "+-" for b in "+-" for c in "+-"
)


@query(
    "boxes_in_view",
    f"SELECT rec FROM fx_boxes WHERE {_ALL_IN}",
    views=("fx_boxes",),
)
def boxes_in_view(spark, sf):
    d = fx.boxes(spark, sf)
    box = vec(*[F.col(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz", "yaw")])
    uvz = F.transform(
        box_corners(box),
        lambda p: F.array(p[0] / p[2] * 200 + 128, p[1] / p[2] * 200 + 128, p[2]),
    )
    return d.where(R.all_inside(uvz, F.lit(256), F.lit(256), 0.5)).select("rec")


@query(
    "points_in_boxes",
    """SELECT b.rec AS box, count(*) AS n FROM fx_points p JOIN fx_boxes b ON p.cloud % 50 = b.frame
 AND abs(p.x - b.cx) <= b.dx/2 + 0.1 AND abs(p.y - b.cy) <= b.dy/2 + 0.1 AND abs(p.z - b.cz) <= b.dz/2 + 0.1 GROUP BY b.rec""",
    views=("fx_points", "fx_boxes"),
)
def points_in_boxes(spark, sf):
    p = fx.points(spark, sf).withColumn("frame", F.col("cloud") % 50)
    box = vec(*[F.col(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz", "yaw")])
    b = fx.boxes(spark, sf).select("frame", F.col("rec").alias("box_rec"), box.alias("box"))
    held = R.count_in_boxes(p.select("frame", "x", "y", "z"), b, "frame", "box_rec", 0.1)
    return held.select(F.col("box_rec").alias("box"), "n")


@query(
    "points_in_radius",
    "SELECT cloud, count(*) AS n FROM fx_points WHERE sqrt((x-1)*(x-1)+y*y+(z-9)*(z-9)) <= 1.5 GROUP BY cloud",
    views=("fx_points",),
)
def points_in_radius(spark, sf):
    d = R.within_radius(fx.points(spark, sf), vec(1.0, 0.0, 9.0))
    return d.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_sources",
    """SELECT run, string_agg(DISTINCT tag, '+' ORDER BY tag) AS labels FROM (SELECT run, CASE (run * step) % 9
  WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' WHEN 2 THEN 'lhmr' WHEN 3 THEN '?' ELSE 'v2' END AS tag FROM fx_metrics) GROUP BY run""",
    views=("fx_metrics",),
)
def label_sources(spark, sf):
    m = fx.metrics(spark, sf)
    s = (F.col("run") * F.col("step")) % 9
    folder = (
        F.when(s == 0, "data/v1_pseudo2").when(s == 1, "data/v1_pseudo").when(s == 2, "data/v1_lidarhmr")
        .when(s == 3, "data/other").otherwise("data/v1_simlidar")
    )
    return R.label_source(m, ["run"], folder)


@query(
    "convention_ids",
    "SELECT rec, CASE WHEN ds % 3 = 1 THEN 1 ELSE 0 END AS id FROM fx_records",
    views=("fx_records",),
)
def convention_ids(spark, sf):
    name = F.when(F.col("ds") % 3 == 0, "smpl24").when(F.col("ds") % 3 == 1, "waymo15").otherwise("else")
    return fx.records(spark, sf).select("rec", P.convention_id(name).alias("id"))


@query(
    "missing_sidecars",
    "SELECT count(*) AS missing, min(doc_id) AS example FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def missing_sidecars(spark, sf):
    return R.without_sidecar(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), "doc_id")


@query(
    "key_differences",
    """SELECT rec, 'left' AS side FROM fx_joints WHERE joint = 0 AND rec NOT IN (SELECT rec FROM fx_pred)""",
    views=("fx_joints", "fx_pred"),
)
def key_differences(spark, sf):
    return R.key_differences(fx.joints(spark, sf), fx.predicted(spark, sf), "rec")


@query(
    "usable_labels",
    """SELECT rec, (CASE WHEN seq = 5 THEN 3 ELSE 4 END) = 4 AND coalesce(points, 0) > 0 AS usable
 FROM fx_records LEFT JOIN scans USING (rec)""",
    views=("fx_records", "fx_points"),
    ctes=_SCANS,
)
def usable_labels(spark, sf):
    d = fx.records(spark, sf).join(_counts(spark, sf), "rec", "left")
    bbox = F.array_repeat(F.lit(1.0), F.when(F.col("seq") == 5, 3).otherwise(4))
    pts = F.array_repeat(F.lit(0.0), F.coalesce(F.col("points"), F.lit(0)).cast("int"))
    return d.select("rec", R.has_label(bbox, pts).alias("usable"))


@query(
    "keypoint_shapes",
    """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(CAST(list_extract(embedding, 8) AS DOUBLE), 5) END AS x2,
  CASE WHEN vec_id % 2 = 0 THEN 17 ELSE -1 END AS joints FROM embeddings""",
)
def keypoint_shapes(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    flat = F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 51)).otherwise(F.slice("embedding", 1, 50))
    kp = P.reshape_keypoints(flat)
    return e.select(
        "vec_id",
        _r(kp[2][1].cast("double"), 5).alias("x2"),
        F.coalesce(F.size(kp), F.lit(-1)).alias("joints"),
    )


@query(
    "first_person_per_frame",
    "SELECT ds, seq, min(rec) AS rec, arg_min(box_h, rec) AS box_h FROM fx_records GROUP BY ds, seq",
    views=("fx_records",),
)
def first_person_per_frame(spark, sf):
    d = fx.records(spark, sf).select("ds", "seq", "rec", "box_h")
    return R.first_per_frame(d, ["ds", "seq"], "rec")


@query(
    "sources_concatenated",
    """SELECT source, count(*) AS n, count(label_conf) AS with_conf FROM (
 SELECT 'real' AS source, label_conf FROM fx_records WHERE ds = 0 UNION ALL
 SELECT 'synthetic', NULL FROM fx_joints WHERE joint = 0) GROUP BY source""",
    views=("fx_records", "fx_joints"),
)
def sources_concatenated(spark, sf):
    a = fx.records(spark, sf).where("ds = 0").select("rec", "label_conf")
    b = fx.joints(spark, sf).select("rec")
    out = R.concat_sources({"real": a, "synthetic": b})
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("label_conf").alias("with_conf"))


@query(
    "key_union",
    "SELECT rec FROM fx_records WHERE rec % 2 = 0 UNION SELECT rec FROM fx_records WHERE rec % 3 = 0",
    views=("fx_records",),
)
def key_union(spark, sf):
    d = fx.records(spark, sf)
    return R.union_keys(d.where("rec % 2 = 0"), d.where("rec % 3 = 0"), on="rec")


@query(
    "attribute_overlap",
    """SELECT p_partkey AS rec FROM part WHERE p_size >= 10 AND (p_partkey % 4 <> 0 OR p_partkey % 7 IN (1, 2))""",
)
def attribute_overlap(spark, sf):
    k = F.col("p_partkey")
    category = F.when(k % 4 == 0, "vehicle.bicycle").otherwise("human.pedestrian.adult")
    tokens = F.array(F.concat(F.lit("a"), (k % 7).cast("string")), F.lit("other"))
    riders = F.array(F.lit("a1"), F.lit("a2"))
    ok = R.keep_annotation(category, F.col("p_size"), tokens, riders, 10)
    return fx.table(spark, sf, "part").where(ok).select(k.alias("rec"))


@query(
    "labels_normalised",
    """SELECT vec_id, round(list_extract(embedding, 1)::DOUBLE + 2.5, 5) AS tz, round(100*vec_id::DOUBLE - 100*(1+vec_id%7), 4) AS x0,
  10 AS betas FROM embeddings""",
)
def labels_normalised(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    d = F.transform("embedding", lambda v: v.cast("double"))
    zero = F.lit(0.0)
    raw = e.select(
        "vec_id",
        F.format_string("seq/%d.png", "vec_id").alias("imgname"),
        F.concat(d, F.slice(d, 1, 8)).alias("pose_cam"),
        F.slice(d, 1, 11).alias("shape"),
        F.array(zero, zero, d[0]).alias("trans_cam"),
        F.array(*[F.array(zero, zero, zero, F.lit(2.5)) for _ in range(3)]).alias("cam_ext"),
        F.array(F.col("vec_id") * 100.0, zero).alias("center"),
        (1 + F.col("vec_id") % 7).alias("scale"),
        F.lit("neutral").alias("gender"),
    )
    out = T.normalise_labels(raw)
    return out.select(
        F.regexp_extract("frame", r"(\d+)", 1).cast("long").alias("vec_id"),
        _r(F.col("transl")[2], 5).alias("tz"),
        _r(F.col("bbox")[0]).alias("x0"),
        F.size("betas").alias("betas"),
    )


@query(
    "stats_written",
    "SELECT ds, count(*) AS samples FROM fx_records GROUP BY ds",
    views=("fx_records",),
)
def stats_written(spark, sf):
    path = scratch_path(spark, "stats")
    T.write_stats(fx.records(spark, sf).groupBy("ds").agg(F.count(F.lit(1)).alias("samples")), path)
    return spark.read.schema("ds long, samples long").json(path)


@query(
    "predictions_written",
    "SELECT split, method, count(*) AS n FROM (SELECT rec, 'val' AS split, 'ours' AS method FROM fx_pred WHERE joint = 0) GROUP BY ALL",
    views=("fx_pred",),
)
def predictions_written(spark, sf):
    path = scratch_path(spark, "predictions")
    p = fx.predicted(spark, sf)
    for half in (0, 1):
        T.write_predictions(p.where(F.col("rec") % 2 == half), path, "ours", "val")
    return spark.read.parquet(path).groupBy("split", "method").agg(F.count(F.lit(1)).alias("n"))


@query(
    "metrics_appended",
    "SELECT run, count(*) AS n, count(mpjpe) FILTER (NOT missing) AS with_value FROM fx_metrics GROUP BY run",
    views=("fx_metrics",),
)
def metrics_appended(spark, sf):
    path = scratch_path(spark, "log")
    m = fx.metrics(spark, sf)
    rows = m.select("run", "step", F.when(~F.col("missing"), F.col("mpjpe")).alias("mpjpe"))
    T.append_metrics(rows.where(F.col("step") % 2 == 0), path)
    T.append_metrics(rows.where(F.col("step") % 2 == 1), path)
    got = spark.read.schema("run long, step long, mpjpe double").json(path)
    return got.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("mpjpe").alias("with_value"))


@query(
    "registry_loaded",
    "SELECT 'a' AS rig, count(*) AS n FROM region UNION ALL SELECT 'c', count(*) FROM nation UNION ALL SELECT 'skipped', 1",
)
def registry_loaded(spark, sf):
    def broken():
        raise FileNotFoundError("no calibration")

    rigs, skipped = T.load_all(
        {
            "a": lambda: fx.table(spark, sf, "region").select(F.col("r_name").alias("name")),
            "b": broken,
            "c": lambda: fx.table(spark, sf, "nation").select(F.col("n_name").alias("name")),
        }
    )
    out = rigs.groupBy("rig").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(
        spark.range(1).select(F.lit("skipped").alias("rig"), F.lit(len(skipped)).cast("long").alias("n"))
    )


@query(
    "records_generated",
    """SELECT ds, count(*) AS n, count(points) AS with_points, count(*) FILTER (status = 'accepted') AS accepted, sum(rec)::BIGINT AS rec_sum
 FROM (SELECT r.*, points, CASE WHEN box_h < 90 OR box_w < 35 THEN 'rejected_box' WHEN coalesce(points, 0) < 4
  THEN 'rejected_points' ELSE 'accepted' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY ds, seq ORDER BY rec) AS rn FROM fx_records WHERE rec % 5 <> 0) r
  LEFT JOIN scans USING (rec) WHERE (rn - 1) % 3 = 0) GROUP BY ds""",
    views=("fx_records", "fx_points"),
    ctes=_SCANS,
)
def records_generated(spark, sf):
    from tallyfield.operators.generate import generate_records

    d = fx.records(spark, sf)
    # each frame has its image; the depth file of every fifth is missing
    kinds = F.explode(F.when(F.col("rec") % 5 == 0, F.array(F.lit("png"))).otherwise(F.array(F.lit("png"), F.lit("depth"))))
    files = d.select("ds", "seq", "rec", kinds.alias("kind"))
    path = scratch_path(spark, "generated")
    made = generate_records(
        d, files, _counts(spark, sf), path, frame=["ds", "seq", "rec"], sequence=["ds", "seq"], label_on="rec", stride=3, n=4
    )
    got = spark.read.parquet(path)
    per = got.groupBy("ds").agg(
        F.count(F.lit(1)).alias("n"), F.count("points").alias("with_points"),
        F.count(F.when(F.col("status") == "accepted", 1)).alias("accepted"), F.sum("rec").alias("rec_sum"),
    )
    total = F.lit(made["records"]) == F.lit(made["accepted"] + made["rejected_box"] + made["rejected_points"])
    return per.where(total)
