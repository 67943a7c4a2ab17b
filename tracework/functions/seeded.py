"""Randomness from md5: the same for any partitioning, any engine and any order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(seed: int, salt: str, *ids: Column) -> Column:
    parts = [F.lit(f"{seed}:{salt}")]
    for i in ids:
        parts += [F.lit(":"), F.coalesce(i.cast("string"), F.lit(""))]
    return F.concat(*parts)


def order_key(seed: int, salt: str, *ids: Column) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(_text(seed, salt, *ids))


def uniform(seed: int, salt: str, *ids: Column) -> Column:
    """Uniform double in [0, 1)."""
    return F.conv(F.substring(order_key(seed, salt, *ids), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, salt: str, *ids: Column) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    first, second = uniform(seed, salt + "/1", *ids), uniform(seed, salt + "/2", *ids)
    return F.sqrt(-2 * F.log(F.greatest(first, F.lit(1e-12)))) * F.cos(second * 6.283185307179586)
