"""Random numbers that depend on seed and keys only: the same in any engine, plan and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int | str, *keys) -> Column:
    """The text ``seed:key:...`` whose md5 is drawn from; null keys are left out."""
    return F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])


def digest(seed: int | str, *keys) -> Column:
    """The md5 of ``seed:key:...`` in hex digits; eight of them are one draw."""
    return F.md5(seeded(seed, *keys))


def draw(seed: int | str, *keys) -> Column:
    """A whole number from 0 to 2**32 - 1: the first 8 hex digits of the md5 of ``seed:key:...``."""
    return F.conv(F.substring(F.md5(seeded(seed, *keys)), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *keys) -> Column:
    """Inside (0, 1)."""
    return (draw(seed, *keys) + 0.5) / float(1 << 32)


def normal(seed: int | str, *keys) -> Column:
    """Standard normal by Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.ln(uniform(seed, *keys, "r"))) * F.cos(2 * math.pi * uniform(seed, *keys, "a"))
