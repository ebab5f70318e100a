"""Record-shaped views over the driver's tables, as DataFrames and as DuckDB views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOINTS = 21  # three of the 64 embedding values per joint


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joints(spark: SparkSession, sf: str) -> DataFrame:
    """True joints: one row per record, ``gt`` an array of points and ``valid`` their flags."""
    e = table(spark, sf, "embeddings")
    at = F.sequence(F.lit(0), F.lit(JOINTS - 1))
    deep = F.lit(5) + (F.col("rec") % 36)
    return (
        e.select(
            F.col("vec_id").cast("long").alias("rec"),
            F.col("label").cast("int").alias("ds"),
            F.transform("embedding", lambda v: v.cast("double")).alias("_e"),
        )
        .withColumn(
            "gt",
            F.transform(
                at,
                lambda j: F.array(
                    F.element_at("_e", 3 * j + 1),
                    F.element_at("_e", 3 * j + 2),
                    F.element_at("_e", 3 * j + 3) + deep,
                ),
            ),
        )
        .withColumn("valid", F.transform(at, lambda j: (F.col("rec") + j) % 7 != 0))
        .drop("_e")
    )


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of one method: the next record's joints; every 11th record is missing."""
    nxt = joints(spark, sf).select((F.col("rec") - 1).alias("rec"), F.col("gt").alias("_p"))
    shift = (F.col("rec") % 36) - ((F.col("rec") + 1) % 36)
    moved = F.transform("_p", lambda p: F.array(p[0], p[1], p[2] + shift))
    return nxt.where((F.col("rec") >= 0) & (F.col("rec") % 11 != 0)).select("rec", moved.alias("pred"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Truth with its prediction, where there is one."""
    return joints(spark, sf).join(predicted(spark, sf), "rec")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Record table: key, box size, label flags, time."""
    o = table(spark, sf, "orders")
    return o.select(
        F.concat_ws(
            "/",
            F.concat(F.lit("ds"), (F.col("o_custkey") % 4).cast("string")),
            F.concat(F.lit("seq"), (F.col("o_custkey") % 20).cast("string")),
            F.col("o_orderkey").cast("string"),
            F.lit("0"),
        ).alias("key"),
        F.col("o_orderkey").cast("long").alias("rec"),
        (F.col("o_custkey") % 4).cast("long").alias("ds"),
        (F.col("o_custkey") % 20).cast("long").alias("seq"),
        (20 + F.col("o_orderkey") % 200).cast("long").alias("box_h"),
        (10 + F.col("o_custkey") % 90).cast("long").alias("box_w"),
        (F.col("o_orderkey") % 3 != 0).alias("has_smpl"),
        ((F.col("o_orderkey") % 101) / F.lit(100.0)).alias("label_conf"),
        F.col("o_orderdate").alias("ts"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Point clouds: one row per return, ordered by ``idx`` inside ``cloud``."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("long").alias("cloud"),
        F.col("l_orderkey").cast("long").alias("rec"),
        F.col("l_linenumber").cast("long").alias("channel"),
        (F.col("l_partkey") % 512).cast("long").alias("col"),
        (
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * F.lit(10000000000)
            + F.round(F.col("l_extendedprice") * 100).cast("long")
        ).alias("idx"),
        ((F.col("l_partkey") % 200 - 100) / F.lit(10.0)).alias("x"),
        ((F.col("l_orderkey") % 40 - 20) / F.lit(10.0)).alias("y"),
        (1 + F.col("l_quantity")).cast("double").alias("z"),
    )


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Scored boxes without yaw, in frames."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.cast("long").alias("rec"),
        (k % 50).cast("long").alias("frame"),
        ((k % 37) / F.lit(2.0)).alias("cx"),
        ((k % 5) / F.lit(4.0)).alias("cy"),
        (5 + k % 30).cast("double").alias("cz"),
        (1 + F.col("p_size") / F.lit(25.0)).alias("dx"),
        F.lit(1.5).alias("dy"),
        (1 + (k % 3) / F.lit(2.0)).alias("dz"),
        F.lit(0.0).alias("yaw"),
        ((k * 7919 % 1000) / F.lit(1000.0)).alias("score"),
    )


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Time-ordered observations of tracks; ``us`` is the time in microseconds."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").cast("long").alias("rec"),
        F.col("user_id").cast("long").alias("track"),
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("source"),
        "value",
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows of runs: one metric value per run, split and step."""
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 12).cast("long").alias("run"),
        F.col("event_type").alias("split"),
        F.col("event_id").cast("long").alias("step"),
        F.col("value").alias("mpjpe"),
        (F.col("value") / 100).alias("transl_err"),
        (F.col("event_id") % 17 == 0).alias("missing"),
    )


_JOINT_LIST = ", ".join(f"({j})" for j in range(JOINTS))

# the same views for DuckDB; name -> (views it builds on, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_joints": (
        (),
        f"""SELECT vec_id AS rec, CAST(label AS INT) AS ds, j.joint,
  CAST(list_extract(embedding, 3*j.joint+1) AS DOUBLE) AS x,
  CAST(list_extract(embedding, 3*j.joint+2) AS DOUBLE) AS y,
  CAST(list_extract(embedding, 3*j.joint+3) AS DOUBLE) + 5 + (vec_id % 36) AS z,
  (vec_id + j.joint) % 7 <> 0 AS valid
FROM embeddings CROSS JOIN (VALUES {_JOINT_LIST}) AS j(joint)""",
    ),
    "fx_pred": (
        ("fx_joints",),
        """SELECT a.rec, a.ds, a.joint, b.x, b.y, b.z - (b.rec % 36) + (a.rec % 36) AS z
FROM fx_joints a JOIN fx_joints b ON b.rec = a.rec + 1 AND b.joint = a.joint
WHERE a.rec % 11 <> 0""",
    ),
    "fx_err": (
        ("fx_joints", "fx_pred"),
        """SELECT g.rec, g.ds, g.joint, g.valid, g.x AS gx, g.y AS gy, g.z AS gz,
  p.x AS px, p.y AS py, p.z AS pz,
  sqrt((p.x-g.x)*(p.x-g.x)+(p.y-g.y)*(p.y-g.y)+(p.z-g.z)*(p.z-g.z)) AS err
FROM fx_joints g JOIN fx_pred p ON p.rec = g.rec AND p.joint = g.joint""",
    ),
    "fx_records": (
        (),
        """SELECT concat_ws('/', 'ds' || CAST(o_custkey % 4 AS VARCHAR),
    'seq' || CAST(o_custkey % 20 AS VARCHAR), CAST(o_orderkey AS VARCHAR), '0') AS key,
  o_orderkey AS rec, o_custkey % 4 AS ds, o_custkey % 20 AS seq,
  20 + o_orderkey % 200 AS box_h, 10 + o_custkey % 90 AS box_w,
  o_orderkey % 3 <> 0 AS has_smpl, (o_orderkey % 101) / 100.0E0 AS label_conf,
  o_orderdate AS ts FROM orders""",
    ),
    "fx_points": (
        (),
        """SELECT l_suppkey AS cloud, l_orderkey AS rec, CAST(l_linenumber AS BIGINT) AS channel,
  CAST(l_partkey % 512 AS BIGINT) AS col, (l_orderkey * 10 + l_linenumber) * 10000000000
    + CAST(round(l_extendedprice * 100) AS BIGINT) AS idx,
  (l_partkey % 200 - 100) / 10.0E0 AS x, (l_orderkey % 40 - 20) / 10.0E0 AS y,
  CAST(1 + l_quantity AS DOUBLE) AS z FROM lineitem""",
    ),
    "fx_boxes": (
        (),
        """SELECT p_partkey AS rec, p_partkey % 50 AS frame, (p_partkey % 37) / 2.0E0 AS cx,
  (p_partkey % 5) / 4.0E0 AS cy, CAST(5 + p_partkey % 30 AS DOUBLE) AS cz,
  1 + p_size / 25.0E0 AS dx, 1.5E0 AS dy, 1 + (p_partkey % 3) / 2.0E0 AS dz, 0.0E0 AS yaw,
  (p_partkey * 7919 % 1000) / 1000.0E0 AS score FROM part""",
    ),
    "fx_tracks": (
        (),
        """SELECT event_id AS rec, user_id AS track, ts, epoch_us(ts) AS us,
  event_type AS source, value FROM events""",
    ),
    "fx_metrics": (
        (),
        """SELECT user_id % 12 AS run, event_type AS split, event_id AS step, value AS mpjpe,
  value / 100 AS transl_err, event_id % 17 = 0 AS missing FROM events""",
    ),
}


def with_views(names: tuple[str, ...], body: str, ctes: str = "", recursive: bool = False) -> str:
    """A query text with the views it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    if ctes:
        parts.append(ctes.strip())
    if not parts:
        return body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body.strip()
