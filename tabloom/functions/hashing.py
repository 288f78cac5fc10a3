"""The seeded uniform number behind every draw.

It depends on (seed, salt, id) alone, so a draw survives retries and any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = float(2**52)


def never_null(value: Column, default: float | int = 0.0) -> Column:
    """Declare an expression that is never NULL as such.

    A join on a nullable expression makes Catalyst push ``IS NOT NULL`` copies of it down through every
    projection, which repeats the whole draw once per reference.
    """
    return F.coalesce(value, F.lit(default))


def uniform(seed: int, salt: str, *ids: Column) -> Column:
    """Number in [0, 1): the first 13 hex digits of ``md5('seed:salt:id…')`` over 2^52."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[i.cast("string") for i in ids])
    digits = F.substring(F.md5(text.cast("binary")), 1, 13)
    return never_null(F.conv(digits, 16, 10).cast("bigint") / F.lit(_RANGE))


def draw_index(seed: int, salt: str, size: int | Column, *ids: Column) -> Column:
    """Index in 0..size-1, uniform and with replacement."""
    n = F.lit(float(size)) if isinstance(size, int) else size.cast("double")
    return never_null(F.floor(uniform(seed, salt, *ids) * n).cast("bigint"), 0)


def standard_normal(seed: int, salt: str, *ids: Column) -> Column:
    """One standard normal number per id, by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, f"{salt}:radius", *ids)))
    angle = F.lit(6.283185307179586) * uniform(seed, f"{salt}:angle", *ids)
    return never_null(radius * F.cos(angle))
