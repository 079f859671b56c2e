"""Deterministic random sequences as columns.

The generator is a 64-bit linear congruential step. Spark raises on BIGINT overflow, so the wrapping
product is assembled from 16- and 32-bit limbs; every intermediate fits a BIGINT and the whole step
stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Multiplier and increment of the generator.
MULTIPLIER = 6364136223846793005
INCREMENT = 1442695040888963407

MASK64 = (1 << 64) - 1
LONG_MAX = (1 << 63) - 1


def jump(steps: int) -> tuple[int, int]:
    """Constants (a, c) with ``a * seed + c`` equal to ``steps`` applications of the generator."""
    a, c = 1, 0
    step_a, step_c = MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            a, c = (a * step_a) & MASK64, (c * step_a + step_c) & MASK64
        step_a, step_c = (step_a * step_a) & MASK64, (step_c * step_a + step_c) & MASK64
        steps >>= 1
    return a, c


def affine(seed: Column, a: int, c: int) -> Column:
    """``a * seed + c`` modulo 2^64, as a signed BIGINT."""
    if (a, c) == (1, 0):
        return seed
    a_lo, a_hi, c_lo, c_hi = a & 0xFFFFFFFF, a >> 32, c & 0xFFFFFFFF, c >> 32
    low16, low32 = F.lit(0xFFFF).cast("bigint"), F.lit(0xFFFFFFFF).cast("bigint")

    def limb(i: int) -> Column:
        return F.shiftrightunsigned(seed, 16 * i).bitwiseAND(low16)

    def times(constant: int, i: int) -> Column:
        return limb(i) * F.lit(constant).cast("bigint")

    def up16(x: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(low16), 16)

    low = times(a_lo, 0) + F.lit(c_lo).cast("bigint") + up16(times(a_lo, 1))
    high = (
        F.shiftrightunsigned(low, 32)
        + F.shiftrightunsigned(times(a_lo, 1), 16)
        + times(a_lo, 2)
        + up16(times(a_lo, 3))
        + times(a_hi, 0)
        + up16(times(a_hi, 1))
        + F.lit(c_hi).cast("bigint")
    )
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low32))


def next_seed(seed: Column) -> Column:
    return affine(seed, MULTIPLIER, INCREMENT)


def advance(seed: Column, steps: int) -> Column:
    """The seed after ``steps`` draws, in one multiplication."""
    return affine(seed, *jump(steps))


def bounded_int(seed: Column, maximum: int) -> Column:
    """``abs(seed) % (abs(maximum) + 1)``, always within 0..abs(maximum)."""
    bound = abs(maximum)
    if bound == 0:
        return F.lit(0).cast("int")
    smallest = F.lit(-(1 << 63)).cast("bigint")
    # abs() of the smallest BIGINT does not fit; its magnitude is 2^63
    edge = F.lit((1 << 63) % (bound + 1)).cast("bigint")
    value = F.when(seed == smallest, edge).otherwise(F.abs(F.greatest(seed, smallest + 1)) % (bound + 1))
    return value.cast("int")


def unit_double(seed: Column) -> Column:
    """A double in 0..1."""
    return F.abs(seed.cast("double") / F.lit(float(LONG_MAX)))


def positive(seed: Column) -> Column:
    return seed > 0


def weighted_boolean(seed: Column, share: float) -> Column:
    """True for about ``share`` of the seeds."""
    if not 0.0 <= share <= 1.0:
        raise ValueError("share has to be within 0 and 1")
    return unit_double(seed) < F.lit(share)
