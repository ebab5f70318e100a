"""Token-linked annotation tables (JSON arrays) and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tallyfield.functions import vectors as V


def _fields(**types) -> StructType:
    return StructType([StructField(n, t, True) for n, t in types.items()])


_S, _D, _N = StringType(), ArrayType(DoubleType()), IntegerType()

# fixed values: the columns of the token schema this library reads
TOKEN_TABLES = {
    "sensor": _fields(token=_S, channel=_S, modality=_S),
    "calibrated_sensor": _fields(
        token=_S, sensor_token=_S, translation=_D, rotation=_D, camera_intrinsic=ArrayType(_D)
    ),
    "ego_pose": _fields(token=_S, timestamp=LongType(), translation=_D, rotation=_D),
    "category": _fields(token=_S, name=_S),
    "attribute": _fields(token=_S, name=_S),
    "instance": _fields(token=_S, category_token=_S),
    "sample": _fields(token=_S, scene_token=_S, timestamp=LongType()),
    "sample_data": _fields(
        token=_S, sample_token=_S, ego_pose_token=_S, calibrated_sensor_token=_S, filename=_S,
        is_key_frame=BooleanType(), width=_N, height=_N, timestamp=LongType(),
    ),
    "sample_annotation": _fields(
        token=_S, sample_token=_S, instance_token=_S, attribute_tokens=ArrayType(_S),
        translation=_D, size=_D, rotation=_D, num_lidar_pts=_N,
    ),
}


def read_nusc(
    spark: SparkSession, root: str, version: str | None = None, lines: bool = False
) -> dict[str, DataFrame]:
    """The nine tables of one version folder; the highest version unless given.

    Each file is one JSON array, which one task has to read whole. ``lines`` reads folders of
    JSON lines of the same names instead, which split; store large collections that way.
    """
    if version is None:
        from tallyfield.sources.tables import latest_version

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        found = F.regexp_extract("path", r"/(v[^/]*)/sample\.json(/|$)", 1)
        names = files.select(found.alias("version")).where(F.col("version") != "").distinct()
        version = latest_version(names).first()[0]
    return {
        name: spark.read.option("multiLine", str(not lines).lower()).schema(schema).json(f"{root}/{version}/{name}.json")
        for name, schema in TOKEN_TABLES.items()
    }


def annotations_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Annotations of the known samples with the name of their category."""
    ann = tables["sample_annotation"]
    sample = tables["sample"].select(F.col("token").alias("sample_token"))
    instance = tables["instance"].withColumnRenamed("token", "instance_token")
    category = tables["category"].select(
        F.col("token").alias("category_token"), F.col("name").alias("category")
    )
    return (
        ann.join(sample, "sample_token", "left_semi")
        .join(instance, "instance_token")
        .join(category, "category_token")
    )


def key_frames(tables: dict[str, DataFrame]) -> DataFrame:
    """Sensor data of key frames with channel, modality and both poses."""
    data = tables["sample_data"].where(F.col("is_key_frame"))
    calib = tables["calibrated_sensor"].select(
        F.col("token").alias("calibrated_sensor_token"),
        "sensor_token",
        V.se3(V.quat_to_matrix(F.col("rotation")), F.col("translation")).alias("ego_from_sensor"),
        "camera_intrinsic",
    )
    sensor = tables["sensor"].select(F.col("token").alias("sensor_token"), "channel", "modality")
    ego = tables["ego_pose"].select(
        F.col("token").alias("ego_pose_token"),
        V.se3(V.quat_to_matrix(F.col("rotation")), F.col("translation")).alias("world_from_ego"),
    )
    return (
        data.join(calib, "calibrated_sensor_token").join(sensor, "sensor_token").join(ego, "ego_pose_token")
    )


def world_to_sensor(world_from_ego: Column, ego_from_sensor: Column) -> Column:
    """4x4 transform from the world into a sensor."""
    return V.se3_inv(V.se3_mul(world_from_ego, ego_from_sensor))


def rig_sensors(tables: dict[str, DataFrame], position: str | None = None) -> DataFrame:
    """One sensor per channel: the first calibrated entry, with the first positive image size."""
    order = F.col(position) if position else F.col("token")
    calib = tables["calibrated_sensor"].withColumn("_o", order)
    sensor = tables["sensor"].select(F.col("token").alias("sensor_token"), "channel", "modality")
    sizes = (
        tables["sample_data"]
        .where(F.col("width") > 0)
        .groupBy("calibrated_sensor_token")
        .agg(F.min_by(F.struct("width", "height"), F.col("token")).alias("size"))
        .withColumnRenamed("calibrated_sensor_token", "token")
    )
    first = calib.join(sensor, "sensor_token").groupBy("channel").agg(
        F.min_by(F.struct("token", "modality", "translation", "rotation", "camera_intrinsic"), F.col("_o")).alias("c")
    )
    flat = first.select("channel", "c.*").join(sizes, "token", "left")
    pose = V.se3(V.quat_to_matrix(F.col("rotation")), F.col("translation"))
    return flat.select(
        "channel",
        "modality",
        pose.alias("pose"),
        V.check_rigid(pose).alias("rigid"),
        "camera_intrinsic",
        F.col("size.width").alias("width"),
        F.col("size.height").alias("height"),
    )
