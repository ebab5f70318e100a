"""Draws that depend only on keys and a seed, so every partitioning gives the same ones.

A source of draws is a function (name, *key columns) -> uniform column in [0, 1). The default
hashes keys, name and seed; a linear generator exists for comparisons with other engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Draw = Callable[..., Column]

_BITS = 1 << 53


def hashed(seed: int = 0) -> Draw:
    """Uniform draws from a 64-bit hash of keys, draw name and seed."""

    def draw(name: str, *keys: Column) -> Column:
        h = F.xxhash64(*keys, F.lit(name), F.lit(seed))
        return F.shiftrightunsigned(h, 11) / F.lit(float(_BITS))

    return draw


def linear(seed: int = 0) -> Draw:
    """Uniform draws by integer arithmetic on the first key, the same in any SQL engine.

    Draws of neighbouring keys are related; use it to compare results, not to train.
    """

    def draw(name: str, *keys: Column) -> Column:
        salt = sum(ord(c) * (i + 1) for i, c in enumerate(name)) % 9973
        x = (keys[0].cast("long") % 1000003) * 1103515245 + F.lit(seed * 12345 + salt * 7919)
        return F.pmod(x, F.lit(2147483648)) / F.lit(2147483648.0)

    return draw


def linear_sql(name: str, key: str, seed: int = 0) -> str:
    """SQL text of the same draw as :func:`linear`."""
    salt = sum(ord(c) * (i + 1) for i, c in enumerate(name)) % 9973
    add = seed * 12345 + salt * 7919
    return f"((({key} % 1000003) * 1103515245 + {add}) % 2147483648) / 2147483648.0E0"


def normal(draw: Draw, name: str, *keys: Column) -> Column:
    """Standard normal draw from two uniform ones."""
    u = 1.0 - draw(f"{name}.r", *keys)  # in (0, 1]
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(draw(f"{name}.a", *keys) * (2 * math.pi))


def between(draw: Draw, name: str, lo: Column | float, hi: Column | float, *keys: Column) -> Column:
    """Uniform draw in [lo, hi)."""
    low = lo if isinstance(lo, Column) else F.lit(float(lo))
    high = hi if isinstance(hi, Column) else F.lit(float(hi))
    return low + draw(name, *keys) * (high - low)


def pick(draw: Draw, name: str, options: Column, *keys: Column) -> Column:
    """One element of an array."""
    return F.get(options, F.floor(draw(name, *keys) * F.size(options)).cast("int"))
