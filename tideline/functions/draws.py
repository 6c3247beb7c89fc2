"""Reproducible random draws: a keyed hash of (seed, keys), the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline import fixed_values as fv

TWO_POW_32 = 4294967296.0


def _hex(seed: int, keys: tuple) -> Column:
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _number(digits: Column) -> Column:
    return F.coalesce(F.conv(digits, 16, 10).cast("bigint"), F.lit(0))


def uniform(seed: int, *keys) -> Column:
    """Uniform number in [0, 1). Keys are integers or text, never doubles."""
    return _number(F.substring(_hex(seed, keys), 1, 8)) / TWO_POW_32


def order_key(seed: int, *keys) -> Column:
    """60-bit integer that orders rows at random."""
    return _number(F.substring(_hex(seed, keys), 1, 15))


def standard_normal(seed: int, *keys) -> Column:
    """Standard normal draw (Box-Muller on two keyed uniforms)."""
    first, second = uniform(seed, 1, *keys), uniform(seed, 2, *keys)
    return F.sqrt(-2 * F.log(1 - first)) * F.cos(2 * F.pi() * second)


def poisson_one(u: Column) -> Column:
    """Poisson draw with mean 1 from a uniform: the number of cumulative probabilities not above it.

    The uniform is bound once, as it is a hash that would otherwise be made for every comparison.
    """
    number = F.transform(
        F.array(u), lambda x: sum((F.when(x >= c, 1).otherwise(0) for c in fv.POISSON_ONE_CUMULATIVE), F.lit(0))
    )
    return F.get(number, F.lit(0))
