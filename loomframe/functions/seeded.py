"""Repeatable random draws.

Every random operator derives its draws from md5 of a seed and row identity, so
a lost task recomputes the same values and no draw depends on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *ids) -> Column:
    """Hex digest used as a random but repeatable sort key."""
    parts = [F.lit(str(seed))] + [_text(i) for i in ids]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed: int, *ids) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the digest."""
    head = F.conv(F.substring(digest(seed, *ids), 1, 8), 16, 10).cast("long")
    return head / F.lit(4294967296.0)


def uniform_int(seed: int, bound, *ids) -> Column:
    """Uniform integer in [0, bound)."""
    bound = F.lit(bound) if isinstance(bound, int) else bound
    return F.floor(uniform(seed, *ids) * bound).cast("long")


def normal(seed: int, *ids) -> Column:
    """Standard normal draw (Box-Muller over two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, F.lit("r"), *ids)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, F.lit("a"), *ids))


def coin(seed: int, p: float, *ids) -> Column:
    """True with probability ``p``; exact at 0 and 1."""
    return uniform(seed, *ids) < F.lit(float(p))


def _text(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("string")
