"""Mixture and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import vectors as V
from tallyfield.functions.rand import hashed, linear, linear_sql, normal
from tallyfield.functions.vectors import vec
from tallyfield.operators import augment as A
from tallyfield.operators import mixture as M
from tallyfield.plans import fixtures as fx
from tallyfield.plans.registry import query


def _r(col, n=5):
    return F.round(col, n)


def _normal_sql(name, key, seed=0):
    u, a = linear_sql(f"{name}.r", key, seed), linear_sql(f"{name}.a", key, seed)
    return f"(sqrt(-2*ln(1-({u})))*cos(({a})*2*pi()))"


@query(
    "batch_counts",
    """SELECT source, CAST(n + CASE WHEN rk = 1 THEN 512 - sum(n) OVER () ELSE 0 END AS BIGINT) AS count FROM (
 SELECT source, floor(weight / sum(weight) OVER () * 512) AS n, row_number() OVER (ORDER BY weight DESC, source) AS rk
 FROM (SELECT event_type AS source, round(sum(value), 2) AS weight FROM events GROUP BY 1))""",
)
def batch_counts(spark, sf):
    w = fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(
        F.round(F.sum("value"), 2).alias("weight")
    )
    return M.batch_count_table(w, 1024, 2).select("source", "count")


@query(
    "mixture_batches",
    f"""SELECT batch, CAST(ds AS BIGINT) AS ds, slot, place, rec FROM (SELECT b.batch, s.ds, t.slot, CAST(floor(({linear_sql('mixture', '(b.batch * 100003 + t.slot)', 3)}) * z.n) AS BIGINT) AS row,
  row_number() OVER (PARTITION BY b.batch ORDER BY {linear_sql('mixture.place', '(b.batch * 100003 + t.slot)', 3)}, s.ds, t.slot) - 1 AS place
 FROM (SELECT range AS batch FROM range(40)) b CROSS JOIN (VALUES (0, 32), (1, 20), (2, 12)) AS s(ds, k) CROSS JOIN (SELECT range AS slot FROM range(32)) t
 JOIN (SELECT ds, count(*) AS n FROM fx_records GROUP BY ds) z ON z.ds = s.ds WHERE t.slot < s.k) d
 JOIN (SELECT ds, rec, row_number() OVER (PARTITION BY ds ORDER BY rec) - 1 AS row FROM fx_records) r USING (ds, row)""",
    views=("fx_records",),
)
def mixture_batches(spark, sf):
    counts = {"0": 32, "1": 20, "2": 12, "9": 5}
    d = M.mixture(
        fx.records(spark, sf), counts, 40, source="ds", order=["rec"], draw=linear(3)
    )
    return d.select("batch", "ds", F.col("slot").cast("long").alias("slot"), "place", "rec")


@query(
    "mixture_shares",
    """SELECT ds, CAST(25 * k AS BIGINT) AS n, round(25 * k / 4000.0E0, 6) AS share FROM (SELECT ds, count(*) AS n FROM fx_records GROUP BY ds)
 JOIN (VALUES (0, 80), (1, 50), (2, 30)) AS t(ds, k) USING (ds)""",
    views=("fx_records",),
)
def mixture_shares(spark, sf):
    counts = dict(zip(("0", "1", "2"), M.batch_counts([0.5, 0.3125, 0.1875], 160)))
    d = M.mixture(fx.records(spark, sf), counts, 25, source="ds", order=["rec"], draw=hashed(1))
    n = d.groupBy("ds").agg(F.count(F.lit(1)).alias("n"))
    return n.select("ds", "n", _r(F.col("n") / 4000, 6).alias("share"))


@query(
    "pool_shares",
    """SELECT source, round(weight / sum(weight) OVER (), 6) AS mixture_share, round(records / sum(records) OVER (), 6) AS size_share FROM (
 SELECT ds AS source, 1.0E0 + ds AS weight, count(*) AS records FROM fx_records GROUP BY ds)""",
    views=("fx_records",),
)
def pool_shares(spark, sf):
    d = fx.records(spark, sf).groupBy(F.col("ds").alias("source")).agg(F.count(F.lit(1)).alias("records"))
    d = M.pool_shares(d.withColumn("weight", 1.0 + F.col("source")))
    return d.select("source", _r("mixture_share", 6).alias("mixture_share"), _r("size_share", 6).alias("size_share"))


@query(
    "training_schedule",
    """SELECT ds, CAST(ceil(n / 512.0) AS BIGINT) AS steps_per_epoch, CAST(ceil(2.5 * ceil(n / 512.0)) AS BIGINT) AS max_steps FROM (SELECT ds, count(*) AS n FROM fx_records GROUP BY ds)""",
    views=("fx_records",),
)
def training_schedule(spark, sf):
    d = fx.records(spark, sf).groupBy("ds").agg(F.count(F.lit(1)).alias("n"))
    return d.select("ds", M.schedule(F.col("n"), 512, 2.5).alias("s")).select("ds", "s.*")


def _scans(spark, sf):
    d = fx.points(spark, sf).groupBy("cloud", "channel").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.when(F.col("channel") < 4, "main_").otherwise("rig_"), F.col("channel").cast("string"))
    return d.select("cloud", name.alias("variant"), "n")


@query(
    "scan_variants",
    """SELECT cloud, variant, n FROM (SELECT cloud, variant, n, row_number() OVER (PARTITION BY cloud ORDER BY variant <> 'rig_5', variant) AS rn FROM (
 SELECT cloud, CASE WHEN channel < 4 THEN 'main_' ELSE 'rig_' END || channel AS variant, count(*) AS n FROM fx_points WHERE cloud % 3 <> 0 OR channel <> 5 GROUP BY ALL)) WHERE rn = 1""",
    views=("fx_points",),
)
def scan_variants(spark, sf):
    s = _scans(spark, sf).where("cloud % 3 <> 0 OR variant <> 'rig_5'")
    return M.pick_variant(s, "cloud", "rig_5")


@query(
    "random_main_scans",
    """SELECT cloud, count(*) AS picked, true AS main FROM (SELECT DISTINCT cloud FROM fx_points WHERE channel < 4) GROUP BY cloud""",
    views=("fx_points",),
)
def random_main_scans(spark, sf):
    d = M.pick_variant(_scans(spark, sf), "cloud", "random_main", hashed(7))
    return d.groupBy("cloud").agg(
        F.count(F.lit(1)).alias("picked"), F.bool_and(F.col("variant").startswith("main_")).alias("main")
    )


@query(
    "clouds_resampled",
    f"""SELECT cloud, slot, idx, slot < m AS point_valid FROM (SELECT cloud, idx, rn, least(n, 700) AS m FROM (
  SELECT cloud, idx, row_number() OVER (PARTITION BY cloud ORDER BY {linear_sql('sample', 'idx', 2)}, idx) AS rn, count(*) OVER (PARTITION BY cloud) AS n FROM fx_points) WHERE rn <= 700) p
 JOIN (SELECT range AS slot, {linear_sql('repeat', 'range', 2)} AS u FROM range(700)) s
 ON CASE WHEN s.slot < p.m THEN s.slot + 1 ELSE floor(s.u * p.m)::BIGINT + 1 END = p.rn""",
    views=("fx_points",),
)
def clouds_resampled(spark, sf):
    # what is sorted and written is only what the result has
    d = A.sample_points(fx.points(spark, sf).select("cloud", "idx"), "cloud", "idx", 700, linear(2))
    return d.select("cloud", "slot", "idx", "point_valid")


_FLAGS = "fl AS (SELECT rec, rec % 5 <> 0 AS has_image, rec % 7 <> 0 AS has_points FROM fx_records)"


def _flags(spark, sf):
    return fx.records(spark, sf).select(
        "rec", (F.col("rec") % 5 != 0).alias("has_image"), (F.col("rec") % 7 != 0).alias("has_points")
    )


@query(
    "modalities_dropped",
    f"""SELECT rec, has_image AND NOT (i AND NOT (p AND k)) AS has_image, has_points AND NOT (p AND NOT (i AND NOT k)) AS has_points FROM (
 SELECT *, {linear_sql('image', 'rec', 4)} < 0.3 AND has_image AND has_points AS i, {linear_sql('points', 'rec', 4)} < 0.4 AND has_image AND has_points AS p,
  {linear_sql('keep', 'rec', 4)} < 0.5 AS k FROM fl)""",
    views=("fx_records",),
    ctes=_FLAGS,
)
def modalities_dropped(spark, sf):
    return M.drop_modalities(_flags(spark, sf), "rec", 0.3, 0.4, linear(4))


@query(
    "modalities_forced",
    """SELECT rec, 'image' AS kept, has_image, has_points AND NOT has_image AS has_points FROM fl
 UNION ALL SELECT rec, 'points', has_image AND NOT has_points, has_points FROM fl""",
    views=("fx_records",),
    ctes=_FLAGS,
)
def modalities_forced(spark, sf):
    d = _flags(spark, sf)
    a = M.force_modality(d, "image").withColumn("kept", F.lit("image"))
    return a.unionByName(M.force_modality(d, "points").withColumn("kept", F.lit("points")))


@query("clouds_occluded")
def clouds_occluded(spark, sf):
    d = A.occlude(fx.points(spark, sf), "cloud", "idx", draw=hashed(5))
    # ids fill most of a long, their sum does not fit one
    whole = F.col("idx").cast("decimal(20,0)")
    return d.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("idx_sum"))


@query(
    "heights_cut",
    """SELECT idx, 'bottom' AS side FROM e WHERE y <= hy - 0.3*(hy - ly) UNION ALL SELECT idx, 'top' FROM e WHERE y >= ly + 0.3*(hy - ly)
 UNION ALL SELECT idx, 'x' FROM e WHERE x >= lx + (hx - lx)*0.25""",
    views=("fx_points",),
    ctes="""e AS (SELECT idx, x, y, min(y) OVER c AS ly, max(y) OVER c AS hy, min(x) OVER c AS lx, max(x) OVER c AS hx FROM fx_points WINDOW c AS (PARTITION BY cloud))""",
)
def heights_cut(spark, sf):
    p = fx.points(spark, sf).select("cloud", "idx", "x", "y", "z")
    parts = [
        A.height_cut(p, "cloud", 0.3).select("idx", F.lit("bottom").alias("side")),
        A.height_cut(p, "cloud", 0.3, False).select("idx", F.lit("top").alias("side")),
        A.axis_cut(p, "cloud", "x", 0.25).select("idx", F.lit("x").alias("side")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "planes_and_boxes_cut",
    """SELECT idx, 'plane' AS cut FROM fx_points WHERE (x - 1)*0.6 + (y - 0)*0 + (z - 9)*0.8 >= 0
 UNION ALL SELECT idx, 'box' FROM fx_points WHERE NOT (abs(x - 1) <= 2 AND abs(y) <= 1 AND abs(z - 9) <= 5)""",
    views=("fx_points",),
)
def planes_and_boxes_cut(spark, sf):
    p = fx.points(spark, sf).select("idx", "x", "y", "z")
    a = A.halfspace_cut(p, vec(1.0, 0.0, 9.0), vec(0.6, 0.0, 0.8))
    b = A.box_cut(p, vec(1.0, 0.0, 9.0), vec(4.0, 2.0, 10.0))
    return a.select("idx", F.lit("plane").alias("cut")).unionByName(b.select("idx", F.lit("box").alias("cut")))


@query(
    "clouds_thinned",
    f"""SELECT cloud, idx FROM (SELECT cloud, idx, row_number() OVER (PARTITION BY cloud ORDER BY {linear_sql('subsample', 'idx', 6)}, idx) AS rn,
  count(*) OVER (PARTITION BY cloud) AS n FROM fx_points) WHERE rn <= greatest(1, round_even(n * 0.15E0, 0))""",
    views=("fx_points",),
)
def clouds_thinned(spark, sf):
    return A.subsample(fx.points(spark, sf), "cloud", "idx", 0.15, linear(6)).select("cloud", "idx")


@query(
    "points_jittered",
    f"""SELECT idx, round(x + 0.02*{_normal_sql('jitter.x', 'idx', 8)}, 5) AS x FROM fx_points""",
    views=("fx_points",),
)
def points_jittered(spark, sf):
    return A.jitter(fx.points(spark, sf), "idx", 0.02, linear(8)).select("idx", _r("x").alias("x"))


@query(
    "ranges_jittered",
    f"""SELECT idx, round(z + z/sqrt(x*x+y*y+z*z)*0.05*{_normal_sql('range', 'idx', 8)}, 5) AS z FROM fx_points""",
    views=("fx_points",),
)
def ranges_jittered(spark, sf):
    d = A.range_jitter(fx.points(spark, sf), "idx", (0.0, 0.0, 0.0), 0.05, linear(8))
    return d.select("idx", _r("z").alias("z"))


def _outlier_sum(axis):
    return f"round(sum(l{axis} + {linear_sql(f'outlier.{axis}', 'i', 9)} * (h{axis} - l{axis})), 4) AS sum_{axis}"


@query(
    "outliers_added",
    f"""SELECT cloud, any_value(n) + count(*) AS n, count(*) AS outliers, {_outlier_sum("x")}, {_outlier_sum("y")}, {_outlier_sum("z")}
 FROM (SELECT *, unnest(range(1, CAST(round_even(n * 0.05E0, 0) AS BIGINT) + 1)) AS i FROM (SELECT cloud, count(*) AS n,
  min(x) - 0.3 AS lx, max(x) + 0.3 AS hx, min(y) - 0.3 AS ly, max(y) + 0.3 AS hy, min(z) - 0.3 AS lz, max(z) + 0.3 AS hz
  FROM fx_points GROUP BY cloud)) GROUP BY cloud""",
    views=("fx_points",),
)
def outliers_added(spark, sf):
    d = A.add_outliers(fx.points(spark, sf), "cloud", 0.05, 0.3, linear(9))
    out = F.col("outlier")
    found = d.groupBy("cloud").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(out, 1)).alias("outliers"),
        *[_r(F.sum(F.when(out, F.col(c))), 4).alias(f"sum_{c}") for c in "xyz"],
    )
    return found.where("outliers > 0")


_CHANNELS = " UNION ALL ".join(
    f"SELECT cloud, {i} AS channel, {linear_sql(f'channel{i}', 'cloud', 10)} AS u FROM (SELECT DISTINCT cloud FROM fx_points)"
    for i in range(8)
)


@query(
    "channels_dropped",
    f"""SELECT idx FROM (SELECT p.idx, g.rk > 3 AS keep, count(*) FILTER (g.rk > 3) OVER (PARTITION BY p.cloud) AS n FROM fx_points p JOIN (
 SELECT cloud, channel, row_number() OVER (PARTITION BY cloud ORDER BY u, channel) AS rk FROM ({_CHANNELS})) g USING (cloud, channel)) WHERE keep OR n < 300""",
    views=("fx_points",),
)
def channels_dropped(spark, sf):
    d = A.drop_channels(fx.points(spark, sf), "cloud", "channel", 8, 0.4, 300, linear(10))
    return d.select("idx")


@query(
    "sensor_covered",
    """SELECT idx FROM (SELECT idx, channel, degrees(atan2(x, z)) AS az FROM fx_points) WHERE az >= -45 + 0.1*90 AND az <= 45 - 0.2*90 AND channel >= 0.25*8 AND channel < 8 - 0.25*8""",
    views=("fx_points",),
)
def sensor_covered(spark, sf):
    d = fx.points(spark, sf).withColumn("azimuth", F.degrees(F.atan2("x", "z")))
    return A.cover(d, 8, -45.0, 45.0, 0.1, 0.2, 0.25, 0.25).select("idx")


@query("clouds_augmented")
def clouds_augmented(spark, sf):
    d = A.augment_points(fx.points(spark, sf), "cloud", "idx", "channel", 8, draw=hashed(11))
    return d.groupBy("cloud").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outlier"), 1)).alias("outliers")
    )


_TURNS = ", ".join(f"radians({_normal_sql(f'rot{i}', 'rec', 12)}) AS a{i}" for i in range(3))
_SHIFTS = [f"0.02*{_normal_sql(f'shift{i}', 'rec', 12)}" for i in range(3)]


@query(
    "poses_perturbed",
    f"""SELECT rec, round(cx + {_SHIFTS[0]}, 5) AS x, round({_SHIFTS[1]}, 5) AS y, round(cz + {_SHIFTS[2]}, 5) AS z,
  round(cos(a1)*cos(a2) + cos(a0)*cos(a2) + cos(a0)*cos(a1) + sin(a0)*sin(a1)*sin(a2), 7) AS trace, true AS rigid
 FROM (SELECT *, {_TURNS} FROM fx_boxes)""",
    views=("fx_boxes",),
)
def poses_perturbed(spark, sf):
    d = fx.boxes(spark, sf)
    pose = V.se3(V.yaw_matrix(F.col("score")), vec(F.col("cx"), 0.0, F.col("cz")))
    d = d.select("rec", pose.alias("pose"))
    d = d.withColumn("new", A.perturb_pose(F.col("pose"), linear(12), 1.0, 0.02, F.col("rec")))
    at = V.translation_of(F.col("new"))
    # the turn that was put in front: new times the transpose of old has its trace
    old, new = V.rotation_of(F.col("pose")), V.rotation_of(F.col("new"))
    d = d.select("rec", at.alias("t"), old.alias("o"), new.alias("n"), V.check_rigid(F.col("new")).alias("rigid"))
    trace = V.total([F.col("n")[i] * F.col("o")[i] for i in range(9)])
    return d.select("rec", *[_r(F.col("t")[i]).alias(c) for i, c in enumerate("xyz")], _r(trace, 7).alias("trace"), "rigid")


@query(
    "boxes_jittered",
    f"""SELECT rec, round(cx + {_normal_sql('dx', 'rec', 13)}*0.05*dx - dx*exp({_normal_sql('scale', 'rec', 13)}*0.1)/2, 5) AS x0 FROM fx_boxes""",
    views=("fx_boxes",),
)
def boxes_jittered(spark, sf):
    b = vec(F.col("cx") - F.col("dx") / 2, F.col("cy"), F.col("cx") + F.col("dx") / 2, F.col("cy") + 1)
    j = M.jitter_bbox(b, linear(13), 0.1, 0.05, F.col("rec"))
    return fx.boxes(spark, sf).select("rec", _r(j[0]).alias("x0"))


@query(
    "speeds_sampled",
    f"""SELECT rec, round(least(greatest(30 + 20*{_normal_sql('speed', 'rec', 14)}, 0), 130)/3.6, 5) AS mps FROM fx_records""",
    views=("fx_records",),
)
def speeds_sampled(spark, sf):
    v = M.sample_speed(linear(14), 30.0, 20.0, F.col("rec"))
    return fx.records(spark, sf).select("rec", _r(v).alias("mps"))


@query(
    "scan_plans",
    f"""SELECT rec, variant, CASE variant WHEN 'target_waymo' THEN 'waymo64' WHEN 'check' THEN 'OS1-64-1024' ELSE 'OS1-' || CASE CAST(floor(4*({linear_sql('channels', 'rec', 15)})) AS INT) WHEN 0 THEN 32 WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 256 END
  || '-' || CASE CAST(floor(3*({linear_sql('steps', 'rec', 15)})) AS INT) WHEN 0 THEN 512 WHEN 1 THEN 1024 ELSE 2048 END END AS sensor, true AS inside
 FROM fx_boxes CROSS JOIN (VALUES ('main_0'), ('main_1'), ('ball025'), ('target_waymo'), ('check')) AS v(variant)""",
    views=("fx_boxes",),
)
def scan_plans(spark, sf):
    d = M.scan_plan(fx.boxes(spark, sf), "rec", draw=linear(15))
    inside = V.norm(F.col("position")) <= 1.0
    return d.select("rec", "variant", "sensor", inside.alias("inside"))


@query(
    "tracks_packed",
    """SELECT track, batch, n FROM walk""",
    views=("fx_tracks",),
    recursive=True,
    ctes="""t AS (SELECT track, count(*) AS n, row_number() OVER (ORDER BY track) AS i FROM fx_tracks GROUP BY track),
walk AS (SELECT track, n, i, n AS fill, 0::BIGINT AS batch FROM t WHERE i = 1
 UNION ALL SELECT t.track, t.n, t.i, CASE WHEN w.fill + t.n > 200 THEN t.n ELSE w.fill + t.n END, w.batch + CASE WHEN w.fill + t.n > 200 THEN 1 ELSE 0 END
 FROM walk w JOIN t ON t.i = w.i + 1)""",
)
def tracks_packed(spark, sf):
    d = M.pack_tracks(fx.tracks(spark, sf), "track", 200)
    return d.groupBy("track", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "copies_chosen",
    f"""SELECT rec, {linear_sql('copy', 'rec', 16)} < 0.35 AS use_copy FROM fx_records""",
    views=("fx_records",),
)
def copies_chosen(spark, sf):
    return M.choose_copy(fx.records(spark, sf), "rec", 0.35, linear(16)).select("rec", "use_copy")
