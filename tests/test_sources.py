"""Readers on small files."""

import json
import struct

import numpy as np
import pytest

from tallyfield import config
from tallyfield.sources import readers as R
from tallyfield.sources import tokens as K


def points(df):
    return sorted((r["idx"], round(r["x"], 5), round(r["y"], 5), round(r["z"], 5)) for r in df.collect())


def test_pcd_binary_and_ascii(spark, tmp_path):
    head = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\n"
    body = struct.pack("<fffIfffI", 1, 2, 3, 7, 4, 5, float("nan"), 8)
    (tmp_path / "b").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "b" / "s.pcd").write_bytes((head + "DATA binary\n").encode() + body)
    (tmp_path / "a" / "s.pcd").write_text(head + "DATA ascii\n1 2 3 7\n4 5 6 8\n")
    assert points(R.read_points(spark, str(tmp_path / "b"), "pcd")) == [(0, 1.0, 2.0, 3.0)]
    assert points(R.read_points(spark, str(tmp_path / "a"), "pcd")) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]


def test_ply_and_raw_floats(spark, tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "s.ply").write_bytes(head.encode() + np.arange(9, dtype="<f4").tobytes())
    assert points(R.read_points(spark, str(tmp_path), "ply", "*.ply"))[2] == (2, 6.0, 7.0, 8.0)
    (tmp_path / "s.bin").write_bytes(np.arange(10, dtype="<f4").tobytes())
    assert points(R.read_points(spark, str(tmp_path), "floats", "*.bin")) == [(0, 0.0, 1.0, 2.0), (1, 5.0, 6.0, 7.0)]


def test_pose_text(spark, tmp_path):
    (tmp_path / "012.txt").write_text("1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n")
    (tmp_path / "013.txt").write_text("broken\n")
    rows = R.read_pose_text(spark, str(tmp_path)).collect()
    assert [(r["frame"], r["pose"][3], r["pose"][11]) for r in rows] == [(12, 5.0, 7.0)]


def test_token_tables_from_arrays(spark, tmp_path):
    root = tmp_path / "car"
    for version in ("v1.9-mini", "v2.0-mini"):
        (root / version).mkdir(parents=True)
        for name in K.TOKEN_TABLES:
            (root / version / f"{name}.json").write_text("[]")
    top = root / "v2.0-mini"
    (top / "sample.json").write_text(json.dumps([{"token": "s1", "timestamp": 1}]))
    (top / "category.json").write_text(json.dumps([{"token": "c1", "name": "human.pedestrian.adult"}]))
    (top / "instance.json").write_text(json.dumps([{"token": "i1", "category_token": "c1"}]))
    (top / "sample_annotation.json").write_text(
        json.dumps([{"token": "a1", "sample_token": "s1", "instance_token": "i1"}, {"token": "a2", "sample_token": "gone", "instance_token": "i1"}])
    )
    quarter = [0.70710678, 0.0, 0.0, 0.70710678]
    (top / "sensor.json").write_text(json.dumps([{"token": "n1", "channel": "CAM_FRONT", "modality": "camera"}]))
    (top / "calibrated_sensor.json").write_text(
        json.dumps([{"token": "k1", "sensor_token": "n1", "translation": [1, 0, 0], "rotation": quarter, "camera_intrinsic": [[1, 0, 2], [0, 1, 3], [0, 0, 1]]}])
    )
    (top / "ego_pose.json").write_text(json.dumps([{"token": "e1", "translation": [0, 0, 9], "rotation": [1, 0, 0, 0]}]))
    (top / "sample_data.json").write_text(
        json.dumps([{"token": "d1", "sample_token": "s1", "ego_pose_token": "e1", "calibrated_sensor_token": "k1", "is_key_frame": k, "width": 1600, "height": 900} for k in (True, False)])
    )
    tables = K.read_nusc(spark, str(root))
    rows = K.annotations_of(tables).collect()
    assert [(r["token"], r["category"]) for r in rows] == [("a1", "human.pedestrian.adult")]
    frames = K.key_frames(tables)
    row = frames.select("channel", K.world_to_sensor(frames["world_from_ego"], frames["ego_from_sensor"]).alias("m")).collect()
    assert len(row) == 1 and row[0]["channel"] == "CAM_FRONT"
    m = np.array(row[0]["m"]).reshape(4, 4)
    assert np.allclose(m @ [1, 0, 9, 1], [0, 0, 0, 1], atol=1e-6)
    rig = K.rig_sensors(tables).first()
    assert rig["rigid"] and rig["width"] == 1600


def test_cuboid_document(spark, tmp_path):
    doc = {"openlabel": {"frames": {"7": {"objects": {
        "u1": {"object_data": {"type": "PEDESTRIAN", "cuboid": {"val": [1, 2, 3, 0, 0, 0, 1, 4, 5, 6], "attributes": {"num": [{"name": "other", "val": 1}, {"name": "num_points", "val": 12}]}}}},
        "u2": {"object_data": {"type": "CAR", "cuboid": {"val": [0, 0, 0]}}},
    }}}}}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    rows = {r["object"]: r for r in R.read_openlabel(spark, str(tmp_path)).collect()}
    assert rows["u1"]["num_points"] == 12 and rows["u1"]["cuboid"][9] == 6.0 and rows["u1"]["frame"] == "7"
    assert rows["u2"]["num_points"] == 0 and rows["u2"]["type"] == "CAR"


def test_overrides_keep_types(monkeypatch):
    class Optim:
        lr, steps, on = 0.1, 10, True

    class Job:
        optim, name = Optim(), "x"

    job = config.apply_overrides(Job(), ["optim.lr=1", "optim.steps=20", "optim.on=false", "name=7"])
    assert (job.optim.lr, job.optim.steps, job.optim.on, job.name) == (1.0, 20, False, "7")
    with pytest.raises(AttributeError):
        config.apply_overrides(job, ["optim.nothing=1"])
    monkeypatch.setenv("DATA_HOME", "/d")
    assert config.expand({"a": ["${DATA_HOME}/x"]}) == {"a": ["/d/x"]}
