"""Sensor sweep arithmetic: azimuth windows, capture times, motion, virtual distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions import vectors as V

RANGE_STEPS = 32  # fixed value: depths at which a frustum edge is looked at


def hfov_deg(width: Column, fx: Column) -> Column:
    """Horizontal field of view of a camera."""
    return F.degrees(F.atan((width / 2.0) / fx)) * 2.0


def azimuth_window(
    cam: Column,
    width: Column,
    height: Column,
    pose: Column,
    min_range: Column,
    max_range: Column,
    steps: Column,
) -> Column:
    """Azimuths of a sensor that cover a camera image: struct (hfov, az_min, az_max, columns).

    The image's side edges are followed over the sensor's range, so a sensor beside the camera
    gets the wider window it needs. Angles are taken relative to the image centre, so a window
    across +-180 degrees stays in one piece.
    """
    # what the many depths read is computed once
    known = F.array(cam["fx"], cam["fy"], cam["cx"], cam["cy"], *[pose[i] for i in range(12)])
    return V.let(known, lambda k: _window(k[0], k[1], k[2], k[3], [k[4 + i] for i in range(12)], width, height, min_range, max_range, steps))


def _window(
    fx: Column, fy: Column, cx: Column, cy: Column, pose: list[Column], width: Column, height: Column, min_range: Column,
    max_range: Column, steps: Column,
) -> Column:
    hfov = hfov_deg(width, fx)
    near = F.greatest(min_range, F.lit(0.1))
    ratio = max_range / near
    depth = F.transform(
        F.sequence(F.lit(0), F.lit(RANGE_STEPS - 1)),
        lambda j: near * F.pow(ratio, j / F.lit(float(RANGE_STEPS - 1))),
    )

    def azimuth(x: Column, y: Column, z: Column) -> Column:
        p = V.array(x - pose[3], y - pose[7], z - pose[11])
        # the transposed rotation turns camera directions into sensor directions
        side = V.total([pose[4 * i] * V.parts_of(p)[i] for i in range(3)])
        ahead = V.total([pose[4 * i + 2] * V.parts_of(p)[i] for i in range(3)])
        return F.degrees(F.atan2(side, ahead))

    half = RANGE_STEPS // 2
    zero = F.lit(0.0)

    def window(depths: Column) -> Column:
        edges = []
        for u in (zero, width):
            for v in (zero, height):
                x, y = (u - cx) / fx, (v - cy) / fy
                edges.append(V.let(F.array(x, y), _edges(azimuth, depths)))
        middle = azimuth(zero, zero, (depths[half - 1] + depths[half]) / 2.0)
        return F.struct(middle.alias("az0"), F.concat(*edges).alias("az"))

    def around(w: Column) -> Column:
        return V.let(
            F.transform(w["az"], lambda a: F.pmod(a - w["az0"] + 180.0, F.lit(360.0)) - 180.0),
            lambda rel: F.struct(
                hfov.alias("hfov"),
                (w["az0"] + F.array_min(rel)).alias("az_min"),
                (w["az0"] + F.array_max(rel)).alias("az_max"),
                F.bround(hfov / 360.0 * steps).cast("long").alias("columns"),
            ),
        )

    return V.let(V.let(depth, window), around)


def _edges(azimuth, depths: Column):
    return lambda at: F.transform(depths, lambda z: azimuth(at[0] * z, at[1] * z, z))


def column_times(
    azimuth: Column,
    az_min: Column,
    az_max: Column,
    spin_hz: float = 10.0,
    start: Column | None = None,
    reference: str = "center",
) -> Column:
    """Capture time of a return relative to the reference azimuth of the sweep, in seconds."""
    period = 1.0 / spin_hz
    begin = az_min if start is None else start
    ref = {"start": az_min, "end": az_max, "center": (az_min + az_max) / 2.0}[reference]

    def at(az: Column) -> Column:
        return F.pmod(az - begin, F.lit(360.0)) / 360.0 * period

    return at(azimuth) - at(ref)


def motion_distort(
    p: Column, t: Column, velocity: Column, yaw_rate_deg_s: float = 0.0
) -> Column:
    """A return of a static scene as a moving sensor records it: p - v t, turned by -yaw t."""
    moved = V.sub(p, V.scaled(velocity, t))
    if yaw_rate_deg_s == 0:
        return moved
    return V.mat_vec(V.yaw_matrix(F.radians(t * F.lit(-float(yaw_rate_deg_s)))), moved)


def distance_factor(z: Column, d: Column | float) -> Column:
    """How much sparser a person at depth ``z`` becomes when moved ``d`` metres back."""
    return F.try_divide(z + d, z)


def shrink_factor(z: Column, d: Column | float) -> Column:
    """Image scale of an object at depth ``z`` after the camera moved back by ``d``."""
    return F.try_divide(z, z + d)


def fourier(c: Column, bands: int) -> Column:
    """Coordinates, then per coordinate sines and cosines at doubling frequencies."""
    def waves(x: Column) -> Column:
        angle = F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: x * F.pow(F.lit(2.0), b) * F.pi()
        )
        return F.concat(
            F.transform(angle, lambda a: F.sin(a)), F.transform(angle, lambda a: F.cos(a))
        )

    return F.concat(c, F.flatten(F.transform(c, waves)))
