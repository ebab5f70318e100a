"""Shared area of turned rectangles by sorting the corners of the shared polygon, for comparison."""

import numpy as np


def ground_overlap(a, b):
    """Area shared by pairs of turned rectangles, for a whole batch at once.

    The shared polygon is spanned by the corners of each inside the other and the crossings
    of their edges; its area follows after sorting those points around their mean.
    """

    def corners(x):
        c, s = np.cos(x[:, 6]), np.sin(x[:, 6])
        sa = np.array([-0.5, 0.5, 0.5, -0.5]) * x[:, 3:4]
        sb = np.array([-0.5, -0.5, 0.5, 0.5]) * x[:, 5:6]
        u = x[:, 0:1] + c[:, None] * sa - s[:, None] * sb
        v = x[:, 2:3] + s[:, None] * sa + c[:, None] * sb
        return np.stack([u, v], -1)

    def within(p, x):
        c, s = np.cos(x[:, 6])[:, None], np.sin(x[:, 6])[:, None]
        u, v = p[..., 0] - x[:, 0:1], p[..., 1] - x[:, 2:3]
        eps = 1e-9
        return (np.abs(c * u + s * v) <= x[:, 3:4] / 2 + eps) & (
            np.abs(c * v - s * u) <= x[:, 5:6] / 2 + eps
        )

    pa, pb = corners(a), corners(b)
    da, db = np.roll(pa, -1, 1) - pa, np.roll(pb, -1, 1) - pb
    p, r = pa[:, :, None], da[:, :, None]
    q, s = pb[:, None], db[:, None]
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    off = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (off[..., 0] * s[..., 1] - off[..., 1] * s[..., 0]) / den
        u = (off[..., 0] * r[..., 1] - off[..., 1] * r[..., 0]) / den
    hit = (np.abs(den) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    cross = p + np.where(hit, t, 0.0)[..., None] * r
    n = len(a)
    pts = np.concatenate([pa, pb, cross.reshape(n, 16, 2)], 1)
    ok = np.concatenate([within(pa, b), within(pb, a), hit.reshape(n, 16)], 1)
    count = ok.sum(1)
    mean = (pts * ok[..., None]).sum(1) / np.maximum(count, 1)[:, None]
    rel = pts - mean[:, None]
    angle = np.where(ok, np.arctan2(rel[..., 1], rel[..., 0]), np.inf)
    order = np.argsort(angle, 1)
    rel = np.take_along_axis(rel, order[..., None], 1)
    # unused places repeat the first point, which adds no area
    used = np.arange(rel.shape[1])[None] < count[:, None]
    rel = np.where(used[..., None], rel, rel[:, :1])
    nxt = np.roll(rel, -1, 1)
    area = 0.5 * np.abs((rel[..., 0] * nxt[..., 1] - rel[..., 1] * nxt[..., 0]).sum(1))
    return np.where(count >= 3, area, 0.0)
