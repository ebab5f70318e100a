"""Mesh operators on rows that carry ``verts`` (points) and ``faces`` (index triples).

One mesh has a fixed, small number of vertices, so its arrays fit a row; everything that
meets per vertex is exploded and aggregated with map-side combining.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from tallyfield.functions import vectors as V
from tallyfield.operators.spatial import PointIndex
from tallyfield.session import checkpoint


def _corner(verts: Column, face: Column, k: int) -> Column:
    return F.get(verts, face[k].cast("int"))


def _faces(df: DataFrame, mesh: str, *more: str) -> DataFrame:
    """One row per face with its three corner points."""
    flat = df.select(mesh, *more, "verts", F.explode("faces").alias("face"))
    v, f = F.col("verts"), F.col("face")
    return flat.select(mesh, *more, "face", *[_corner(v, f, k).alias(f"p{k}") for k in range(3)])


def facing_vertices(df: DataFrame, mesh: str, origin: str = "origin") -> DataFrame:
    """(mesh, vertex) of all vertices on a face that looks towards the sensor at ``origin``."""
    f = _faces(df, mesh, origin)
    a, b, c, o = (F.col(n) for n in ("p0", "p1", "p2", origin))
    normal = V.cross(V.sub(b, a), V.sub(c, a))
    middle = V.array(*[(a[i] + b[i] + c[i]) / 3.0 for i in range(3)])
    facing = V.dot(normal, V.sub(middle, o)) < 0
    return f.where(facing).select(mesh, F.explode("face").alias("vertex")).distinct()


def vertex_normals(df: DataFrame, mesh: str) -> DataFrame:
    """(mesh, vertex, nx, ny, nz): area-weighted normals of unit length."""
    f = _faces(df, mesh)
    a, b, c = (F.col(n) for n in ("p0", "p1", "p2"))
    f = f.select(mesh, "face", V.cross(V.sub(b, a), V.sub(c, a)).alias("n"))
    per = f.select(mesh, F.explode("face").alias("vertex"), "n")
    sums = per.groupBy(mesh, "vertex").agg(
        *[F.sum(F.col("n")[i]).alias(c) for i, c in enumerate(("nx", "ny", "nz"))]
    )
    n = F.array("nx", "ny", "nz")
    length = F.greatest(V.norm(n), F.lit(1e-12))
    return sums.select(mesh, "vertex", *[(F.col(c) / length).alias(c) for c in ("nx", "ny", "nz")])


def offset(df: DataFrame, mesh: str, metres: float) -> DataFrame:
    """(mesh, vertex, x, y, z): vertices moved outwards along their normals."""
    pos = df.select(mesh, F.posexplode("verts").alias("vertex", "p"))
    n = vertex_normals(df, mesh)
    d = pos.join(n, [mesh, "vertex"], "left")
    return d.select(
        mesh,
        "vertex",
        *[
            (F.col("p")[i] + F.coalesce(F.col(c), F.lit(0.0)) * metres).alias(x)
            for i, (c, x) in enumerate((("nx", "x"), ("ny", "y"), ("nz", "z")))
        ],
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def mesh_diff(gt: Column, pred: Column, faces: Column, gt_root: Column, pred_root: Column) -> Column:
    """Struct of vertex L1 (root-relative), edge-length L1 and edge-normal cosine of one record."""
    vertex = _mean(
        F.zip_with(
            gt,
            pred,
            lambda g, p: V.total(
                [F.abs((p[i] - pred_root[i]) - (g[i] - gt_root[i])) for i in range(3)]
            ) / 3.0,
        )
    )
    sides = ((0, 1), (0, 2), (1, 2))

    def edge(f: Column) -> Column:
        gaps = []
        for i, j in sides:
            p = V.norm(V.sub(_corner(pred, f, i), _corner(pred, f, j)))
            g = V.norm(V.sub(_corner(gt, f, i), _corner(gt, f, j)))
            gaps.append(F.abs(p - g))
        return V.total(gaps) / 3.0

    def cosine(f: Column) -> Column:
        g0 = _corner(gt, f, 0)
        normal = V.cross(V.sub(_corner(gt, f, 1), g0), V.sub(_corner(gt, f, 2), g0))
        edges = [V.sub(_corner(pred, f, j), _corner(pred, f, i)) for i, j in sides]
        return V.let(
            F.array(normal, *edges),
            lambda m: V.total(
                [
                    F.abs(V.dot(m[0], m[k]))
                    / F.greatest(V.norm(m[0]), F.lit(1e-12))
                    / F.greatest(V.norm(m[k]), F.lit(1e-12))
                    for k in (1, 2, 3)
                ]
            )
            / 3.0,
        )

    return F.struct(
        vertex.alias("vertex"),
        _mean(F.transform(faces, edge)).alias("edge"),
        _mean(F.transform(faces, cosine)).alias("normal"),
    )


@pandas_udf(ArrayType(DoubleType()))
def nearest_rotation(h: pd.Series) -> pd.Series:
    """The rotation closest to each 3x3 matrix (row-major), by stacked SVD."""
    m = np.stack(h.to_numpy()).astype(float).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(m)
    fix = np.ones((len(m), 3))
    fix[:, 2] = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    return pd.Series(list(((u * fix[:, None]) @ vt).reshape(-1, 9)))


def rotation_prior(df: DataFrame, by: str, rotation: str) -> DataFrame:
    """Mean rotation and spread (rms angle) per joint, over all rows.

    The mean is the average matrix moved to the closest rotation; only one row per joint meets
    Python.
    """
    means = df.groupBy(by).agg(F.array(*[F.avg(F.col(rotation)[i]) for i in range(9)]).alias("_m"))
    mean = means.select(by, nearest_rotation("_m").alias("mean"))
    angle = V.geodesic(F.col("mean"), F.col(rotation))
    spread = df.join(mean, by).groupBy(by).agg(F.sqrt(F.avg(angle * angle)).alias("sigma"))
    return mean.join(spread, by)


def registered(
    points: DataFrame, verts: DataFrame, on: str, ids: tuple[str, str], iterations: int = 3,
    facing: DataFrame | None = None, huber: float | None = None,
) -> DataFrame:
    """(on, r, t): rigid motion ``r v + t`` of each record's vertices onto its returns, by closest points.

    Every round pairs each return with the nearest vertex, sums the weighted 3x3 covariance per
    record and takes the closest rotation. Only ``facing`` vertices (on, vertex id; all if None) are
    paired. With ``huber`` a return further than that from its vertex weighs ``huber / distance``,
    so outliers pull no harder than returns at that distance. Records without returns stay where
    they are.

    The vertices are indexed once: instead of moving them, each round moves the returns back.
    """
    pid, vid = ids
    src = verts.select(on, vid, "x", "y", "z")
    if facing is not None:
        src = src.join(facing.select(on, vid), [on, vid], "left_semi")
    src = checkpoint(src)
    pts = points.select(on, pid, "x", "y", "z")
    index = PointIndex(src, by=[on], coords=["x", "y", "z"], point_id=vid)
    at = src.select(on, vid, *[F.col(c).alias(f"s{c}") for c in "xyz"])
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    poses = src.select(on).distinct().select(on, eye.alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t"))
    first = True
    for _ in range(iterations):
        if first:
            q = pts
        else:
            off = [F.col(c) - F.col("t")[i] for i, c in enumerate("xyz")]
            back = [V.total([F.col("r")[3 * k + i] * off[k] for k in range(3)]) for i in range(3)]
            q = pts.join(poses, on).select(on, pid, *[e.alias(c) for e, c in zip(back, "xyz")])
        pairs = index.search(q, pid).join(pts, [on, pid]).join(at, [on, vid])
        w = F.lit(1.0) if huber is None else F.when(F.col("distance") > huber, huber / F.col("distance")).otherwise(1.0)
        d = pairs.withColumn("w", w)
        names = ("x", "y", "z", "sx", "sy", "sz")
        stats = d.groupBy(on).agg(
            F.sum("w").alias("w"),
            *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m_{c}") for c in names],
            *[(F.sum(F.col("w") * F.col(f"s{a}") * F.col(b)) / F.sum("w")).alias(f"c_{a}{b}") for a in "xyz" for b in "xyz"],
        )
        # covariance of target and source, row by row; its closest rotation moves the source
        h = F.array(
            *[
                F.col(f"c_{a}{b}") - F.col(f"m_s{a}") * F.col(f"m_{b}") + F.lit(1e-8 if a == b else 0.0)
                for b in "xyz"
                for a in "xyz"
            ]
        )
        move = stats.select(on, nearest_rotation(h).alias("r"), F.array("m_sx", "m_sy", "m_sz").alias("s"), F.array("m_x", "m_y", "m_z").alias("p"))
        shift = [F.col("p")[i] - V.total([F.col("r")[3 * i + k] * F.col("s")[k] for k in range(3)]) for i in range(3)]
        new = move.select(on, F.col("r").alias("nr"), F.array(*shift).alias("nt"))
        poses = poses.join(new, on, "left").select(on, F.coalesce("nr", "r").alias("r"), F.coalesce("nt", "t").alias("t"))
        poses = checkpoint(poses)
        first = False
    return poses


def icp_residual(
    points: DataFrame, verts: DataFrame, on: str, ids: tuple[str, str], iterations: int = 3,
    facing: DataFrame | None = None, huber: float | None = None,
) -> DataFrame:
    """How far a few closest-point rounds move the facing vertices onto the returns, per record.

    The mean way of the facing vertices under :func:`registered`'s motion.
    """
    return mean_move(verts, registered(points, verts, on, ids, iterations, facing, huber), on, ids[1], facing)


def mean_move(verts: DataFrame, poses: DataFrame, on: str, vid: str, facing: DataFrame | None = None) -> DataFrame:
    """(on, moved_m): mean way of each record's facing vertices (all if None) under its pose."""
    src = verts.select(on, vid, "x", "y", "z")
    if facing is not None:
        src = src.join(facing.select(on, vid), [on, vid], "left_semi")
    j = src.join(poses, on)
    moved = [
        V.total([F.col("r")[3 * i + k] * F.col(c) for k, c in enumerate("xyz")]) + F.col("t")[i] - F.col(d)
        for i, d in enumerate("xyz")
    ]
    return j.groupBy(on).agg(F.avg(V.norm(F.array(*moved))).alias("moved_m"))


def transform_body(df: DataFrame, pose: str, pelvis: str = "pelvis") -> DataFrame:
    """Body parameters in another frame: ``R R_go`` and ``R (J0 + t) + T - J0``.

    Changes ``global_orient`` (axis-angle) and ``transl``; done in steps so that each matrix
    is computed once.
    """
    d = df.withColumn("_go", V.rotvec_to_matrix(F.col("global_orient")))
    d = d.withColumn("_new", V.mat_mul(V.rotation_of(F.col(pose)), F.col("_go")))
    at = V.se3_apply(F.col(pose), V.plus(F.col(pelvis), F.col("transl")))
    return d.withColumn("transl", V.sub(at, F.col(pelvis))).withColumn(
        "global_orient", V.matrix_to_rotvec(F.col("_new"))
    ).drop("_go", "_new")
