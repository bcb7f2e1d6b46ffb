"""Deterministic pseudo-random ordering.

Every "random" choice (profile order, folds, samples) sorts by an arithmetic
key of the seed and the row's own ids, so a task that is run again after an
executor loss makes the same choice, and any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Moduli and multipliers of the classic 31-bit Lehmer generators.
# Products stay below 2**48, far from bigint overflow under ANSI mode.
MODULUS = 2147483647
MODULUS_2 = 2147483399
MULTIPLIER_ID = 48271
MULTIPLIER_STEP = 69621
MULTIPLIER_OTHER = 40692
MULTIPLIER_LAST = 16807


def order_key(seed: int, first: Column, second: Column | None = None) -> Column:
    """A bigint in [0, MODULUS) that shuffles ``first`` (and ``second``)."""
    m = F.lit(MODULUS)
    x = F.pmod(first.cast("bigint"), m) * F.lit(MULTIPLIER_ID) + F.lit(int(seed))
    x = F.pmod(x, m) * F.lit(MULTIPLIER_STEP)
    if second is not None:
        x = x + F.pmod(second.cast("bigint"), m) * F.lit(MULTIPLIER_OTHER)
    return F.pmod(F.pmod(x, F.lit(MODULUS_2)) * F.lit(MULTIPLIER_LAST), m)
