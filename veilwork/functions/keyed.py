"""Randomness keyed by row: the same under any partitioning, retry, stream or engine, and all within one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A draw is 13 hexadecimal digits of a digest: 52 bits, which a double holds.
DIGITS, SCALE = 13, 1 << 52


def _draw(digest: Column, at: int) -> Column:
    return (F.conv(F.substring(digest, 1 + at * DIGITS, DIGITS), 16, 10).cast("long") + 0.5) / F.lit(float(SCALE))


def _digest(key: Column, name: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(name), F.lit(str(seed))).cast("binary"))


def uniform(key: Column, name: str, seed: int) -> Column:
    """In (0, 1): the first digits of the MD5 of ``key|name|seed``."""
    return _draw(_digest(key, name, seed), 0)


def normal(key: Column, name: str, seed: int) -> Column:
    """Standard normal by the Box-Muller transform of two draws from one digest."""
    both = F.transform(F.array(_digest(key, name, seed)), lambda d: F.sqrt(-2 * F.log(_draw(d, 0))) * F.cos(2 * math.pi * _draw(d, 1)))
    return both[0]  # so that the digest is computed once
