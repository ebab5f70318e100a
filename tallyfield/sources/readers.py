"""Readers of point files, camera tables, cuboid documents, calibration, tracks and poses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from tallyfield.functions import vectors as V
from tallyfield.operators.sequences import on_grid

# --- point files ----------------------------------------------------------------

# fixed values: numpy type by PCD type letter and size in bytes
_PCD_TYPES = {
    ("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4",
    ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4",
}


def _header(data: bytes, last: str) -> tuple[list[list[str]], int]:
    """Header lines up to the one that starts with ``last``, and where the body begins."""
    lines, at = [], 0
    while True:
        end = data.index(b"\n", at)
        words = data[at:end].decode("ascii", "ignore").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            lines.append(words)
            if words[0] == last:
                return lines, at


def decode_pcd(data: bytes) -> np.ndarray:
    """x, y, z of a PCD file, ascii or binary."""
    lines, at = _header(data, "DATA")
    head = {w[0]: w[1:] for w in lines}
    names = head["FIELDS"]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    n, kind = int(head["POINTS"][0]), head["DATA"][0]
    if kind == "ascii":
        rows = np.array(data[at:].split(), dtype=float)[: n * sum(counts)].reshape(n, sum(counts))
        first = dict(zip(names, np.cumsum([0, *counts[:-1]])))
        return np.stack([rows[:, first[c]] for c in "xyz"], 1)
    if kind != "binary":
        raise ValueError(f"unsupported PCD data kind {kind!r}")
    types = [_PCD_TYPES[(t, int(s))] for t, s in zip(head["TYPE"], head["SIZE"])]
    kinds = [(f, t, (c,)) if c > 1 else (f, t) for f, t, c in zip(names, types, counts)]
    rows = np.frombuffer(data, np.dtype(kinds), count=n, offset=at)
    return np.stack([rows[c].astype(float) for c in "xyz"], 1)


def decode_ply(data: bytes) -> np.ndarray:
    """x, y, z of a PLY file with float vertices, ascii or little endian."""
    lines, at = _header(data, "end_header")
    n = next(int(w[2]) for w in lines if w[:2] == ["element", "vertex"])
    props = [w[2] for w in lines if w[0] == "property"]
    kind = next(w[1] for w in lines if w[0] == "format")
    if kind == "ascii":
        rows = np.array(data[at:].split(), dtype=float)[: n * len(props)].reshape(n, -1)
        return np.stack([rows[:, props.index(c)] for c in "xyz"], 1)
    if kind != "binary_little_endian":
        raise ValueError(f"unsupported PLY format {kind!r}")
    rows = np.frombuffer(data, np.dtype([(p, "<f4") for p in props]), count=n, offset=at)
    return np.stack([rows[c].astype(float) for c in "xyz"], 1)


def decode_floats(data: bytes, stride: int = 5) -> np.ndarray:
    """x, y, z of raw little-endian floats, ``stride`` numbers per return."""
    return np.frombuffer(data, "<f4").reshape(-1, stride)[:, :3].astype(float)


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {
    "pcd": decode_pcd,
    "ply": decode_ply,
    "floats": decode_floats,
}


def read_points(spark: SparkSession, path: str, fmt: str, pattern: str | None = None) -> DataFrame:
    """Points of all files under ``path``: (cloud, idx, x, y, z), finite rows only.

    Files are read in parallel as bytes; each task decodes one file at a time.
    """
    decode = DECODERS[fmt]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                p = decode(bytes(content))
                idx = np.arange(len(p), dtype="int64")
                ok = np.isfinite(p).all(1)
                yield pd.DataFrame(
                    {"cloud": name, "idx": idx[ok], "x": p[ok, 0], "y": p[ok, 1], "z": p[ok, 2]}
                )

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path", "content")
    return files.mapInPandas(rows, "cloud string, idx long, x double, y double, z double")


# --- text, CSV and JSON ---------------------------------------------------------


def read_camera_csv(spark: SparkSession, path: str) -> DataFrame:
    """Camera tables: image name, position (cm), pitch and field of view, with their ``file``."""
    schema = "name string, x double, y double, z double, pitch double, hfov double"
    d = spark.read.option("header", "true").option("recursiveFileLookup", "true")
    return d.schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("file"))


def read_pose_text(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Pose files of four lines with four numbers: (file, frame, pose of 16 numbers)."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    text = reader.text(path, wholetext=True)
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    number = F.regexp_extract("_metadata.file_name", r"(\d+)\.[^.]*$", 1)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        number.try_cast("int").alias("frame"),
        F.transform(words, lambda w: w.try_cast("double")).alias("pose"),
    ).where((F.size("pose") == 16) & F.forall("pose", lambda x: x.isNotNull()))


_ATTRIBUTE = StructType([StructField("name", StringType()), StructField("val", DoubleType())])
_CUBOID = StructType(
    [
        StructField("val", ArrayType(DoubleType())),
        StructField("attributes", StructType([StructField("num", ArrayType(_ATTRIBUTE))])),
    ]
)
_OBJECT = StructType(
    [
        StructField(
            "object_data", StructType([StructField("type", StringType()), StructField("cuboid", _CUBOID)])
        )
    ]
)
_FRAME = StructType([StructField("objects", MapType(StringType(), _OBJECT))])
OPENLABEL = StructType(
    [StructField("openlabel", StructType([StructField("frames", MapType(StringType(), _FRAME))]))]
)


def read_openlabel(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cuboids of OpenLABEL documents: (file, frame, object, type, cuboid, num_points).

    ``lines`` reads one document per line instead of one per file.
    """
    docs = spark.read.schema(OPENLABEL).option("multiLine", str(not lines).lower())
    docs = docs.option("recursiveFileLookup", "true").json(path)
    frames = docs.select(
        F.col("_metadata.file_path").alias("file"), F.explode("openlabel.frames").alias("frame", "_f")
    )
    objects = frames.select("file", "frame", F.explode("_f.objects").alias("object", "_o"))
    data = F.col("_o.object_data")
    cuboid = data["cuboid"]
    counts = F.filter(cuboid["attributes"]["num"], lambda a: a["name"] == "num_points")
    return objects.select(
        "file",
        "frame",
        "object",
        data["type"].alias("type"),
        cuboid["val"].alias("cuboid"),
        F.coalesce(F.get(counts, 0)["val"], F.lit(0.0)).cast("int").alias("num_points"),
    )


# fixed values: sensor names of the calibration tables by number
CAMERA_NAMES = {1: "FRONT", 2: "FRONT_LEFT", 3: "FRONT_RIGHT", 4: "SIDE_LEFT", 5: "SIDE_RIGHT"}
LIDAR_NAMES = {1: "TOP", 2: "FRONT", 3: "SIDE_LEFT", 4: "SIDE_RIGHT", 5: "REAR"}
_CAM, _LID = "[CameraCalibrationComponent]", "[LiDARCalibrationComponent]"


def _named(number: Column, names: dict[int, str], prefix: str) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.concat(F.lit(prefix), F.try_element_at(F.create_map(*pairs), number.cast("int")))


def read_calibration(spark: SparkSession, root: str, split: str, segment: str | None = None) -> DataFrame:
    """Sensors of one segment: name, kind, pose, intrinsics, beam inclination in degrees.

    Without ``segment`` the first of the split by file name.
    """
    tables = {}
    for kind in ("camera", "lidar"):
        d = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{split}/{kind}_calibration")
        stem = F.regexp_extract("_metadata.file_path", r"_calibration/([^/]*?)(\.parquet)?(/|$)", 1)
        tables[kind] = d.select("*", stem.alias("_segment"))
    if segment is None:
        segment = tables["camera"].agg(F.min("_segment")).first()[0]
    cam = tables["camera"].where(F.col("_segment") == segment)
    lid = tables["lidar"].where(F.col("_segment") == segment)

    def c(name: str) -> Column:
        return F.col(f"`{_CAM}.{name}`")

    def li(name: str) -> Column:
        return F.col(f"`{_LID}.{name}`")

    names = ("f_u", "f_v", "c_u", "c_v", "k1", "k2", "p1", "p2", "k3")
    pose = c("extrinsic.transform")
    cameras = cam.select(
        _named(F.col("`key.camera_name`"), CAMERA_NAMES, "CAM_").alias("name"),
        F.lit("camera").alias("kind"),
        pose.alias("pose"),
        V.check_rigid(pose).alias("rigid"),
        F.struct(
            *[c(f"intrinsic.{n}").cast("double").alias(n) for n in names],
            c("width").cast("int").alias("width"),
            c("height").cast("int").alias("height"),
        ).alias("intrinsics"),
    )
    beam = F.struct(
        F.degrees(li("beam_inclination.min")).alias("min_deg"),
        F.degrees(li("beam_inclination.max")).alias("max_deg"),
    )
    pose = li("extrinsic.transform")
    lidars = lid.select(
        _named(F.col("`key.laser_name`"), LIDAR_NAMES, "LIDAR_").alias("name"),
        F.lit("lidar").alias("kind"),
        pose.alias("pose"),
        V.check_rigid(pose).alias("rigid"),
        beam.alias("beam"),
    )
    return lidars.unionByName(cameras, allowMissingColumns=True)


def rig_pose(sensors: DataFrame, camera: str, lidar: str, optical: Column, rig: str = "rig") -> DataFrame:
    """Pose of a LiDAR in the optical frame of a camera of the same rig, for every rig.

    ``optical`` is the rotation from the camera's own axes into the optical ones.
    """
    cam = sensors.where(F.col("name") == camera).select(rig, F.col("pose").alias("_cam"))
    lid = sensors.where(F.col("name") == lidar).select(rig, F.col("pose").alias("_lid"))
    zero = V.vec(0.0, 0.0, 0.0)
    d = cam.join(lid, rig)
    d = d.withColumn("_in", V.se3_mul(V.se3(optical, zero), V.se3_inv(F.col("_cam"))))
    return d.select(rig, V.se3_mul(F.col("_in"), F.col("_lid")).alias("pose"))


# --- tracks and configs -----------------------------------------------------------


def sample_track_frames(df: DataFrame, want: int, frames: str = "frames", keep: tuple[str, ...] = ()):
    """``want`` evenly spaced frames of each track, both ends included; shorter tracks whole.

    ``frames`` is an array of frame structs. Reading it with a schema without the heavy fields
    keeps those out of memory altogether.
    """
    n = F.size(frames)
    with_pos = F.transform(frames, lambda f, i: F.struct(i.alias("frame_index"), f.alias("f")))
    picked = F.filter(with_pos, lambda s: on_grid(s["frame_index"], n, want, "ends"))
    d = df.select(*keep, n.alias("n_frames"), F.explode(picked).alias("_s"))
    return d.select(*keep, "n_frames", "_s.frame_index", "_s.f.*")


_MOTION = "info struct<config_type: string, config: struct<follow: boolean, camera_shake: string, camera_height_min: string, camera_height_max: string, hfov_ranges: array<array<double>>>>"


def motion_configs(df: DataFrame, group: str, json: str) -> DataFrame:
    """Camera motion of each group from its JSON config, with ``?`` and ``none`` for gaps."""
    info = F.from_json(json, f"struct<{_MOTION.replace('info struct', 'info: struct', 1)}>")["info"]
    cfg = info["config"]
    ranges = F.transform(
        F.coalesce(cfg["hfov_ranges"], F.array().cast("array<array<double>>")),
        lambda r: F.concat(
            F.bround(F.get(r, 0)).cast("long").cast("string"),
            F.lit("-"),
            F.bround(F.get(r, 1)).cast("long").cast("string"),
        ),
    )
    unknown = F.lit("?")
    shake = F.when(F.length(cfg["camera_shake"]) > 0, cfg["camera_shake"])
    return df.select(
        group,
        F.coalesce(info["config_type"], unknown).alias("config_type"),
        F.when(cfg["follow"], "yes").otherwise("no").alias("follows"),
        F.coalesce(shake, F.lit("none")).alias("shake"),
        F.concat(
            F.coalesce(cfg["camera_height_min"], unknown),
            F.lit(".."),
            F.coalesce(cfg["camera_height_max"], unknown),
            F.lit(" cm"),
        ).alias("height"),
        F.array_join(ranges, ", ").alias("hfov"),
    )


def score_batches(
    df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Predictions of a user's model, one Arrow batch at a time (the model is the user's)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)
