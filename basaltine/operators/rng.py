"""Seeded uniform draws as column arithmetic and, equal to it, on numbers.

Each draw seeds a multiplicative congruential generator anew from a seed and a
sub-seed and joins two of its values to one double. All steps fit a BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus and multiplier of the generator, spread of sub-seeds.
MODULUS = 2147483647
MULTIPLIER = 16807
SPREAD = 65535
RANGE = MODULUS - 1


def uniform(seed: Column, sub: int) -> Column:
    """A double in [0, 1] for (seed, sub)."""
    s = F.pmod(seed.cast("long") + sub * SPREAD, F.lit(MODULUS).cast("long"))
    s = F.when(s == 0, F.lit(1).cast("long")).otherwise(s)
    a = s * MULTIPLIER % MODULUS
    b = a * MULTIPLIER % MODULUS
    return ((a - 1) + (b - 1) * RANGE).cast("double") / (float(RANGE) * float(RANGE))


def uniform_size(seed: Column, sub: int, n: Column) -> Column:
    """floor(u * (n - 1))."""
    return F.floor(uniform(seed, sub) * (n - 1)).cast("long")


def uniform_between(seed: Column, sub: int, lo: int, hi: int) -> Column:
    """lo + floor(u * (hi - lo))."""
    return (F.lit(lo) + F.floor(uniform(seed, sub) * (hi - lo))).cast("long")


def uniform_number(seed: int, sub: int) -> float:
    s = (seed + sub * SPREAD) % MODULUS or 1
    a = s * MULTIPLIER % MODULUS
    b = a * MULTIPLIER % MODULUS
    return float((a - 1) + (b - 1) * RANGE) / (float(RANGE) * float(RANGE))


def uniform_sql(seed: str, sub: int) -> str:
    """The same as SQL text."""
    s = f"(CASE WHEN ({seed} + {sub * SPREAD}) % {MODULUS} = 0 THEN 1::BIGINT ELSE ({seed} + {sub * SPREAD}) % {MODULUS} END)"
    a = f"({s} * {MULTIPLIER} % {MODULUS})"
    b = f"({a} * {MULTIPLIER} % {MODULUS})"
    return f"(CAST(({a} - 1) + ({b} - 1) * {RANGE} AS DOUBLE) / ({RANGE}.0::DOUBLE * {RANGE}.0::DOUBLE))"
