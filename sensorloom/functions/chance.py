"""Seeded random numbers that depend only on their arguments.

Every draw is a hash of its labels, so a lost task that runs again gives the
same rows, and another engine can compute the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# Bits of a draw: as many as a double holds exactly.
BITS = 52
# Rounds of a shuffled number, and steps after which its walk has ended (see :func:`permuted`).
ROUNDS, WALK = 4, 24


def whole(*parts: Column | str | int) -> Column:
    """Whole number below 2^52 from the md5 of the parts joined by ``|``."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1)."""
    return whole(*parts).cast("double") / F.lit(2.0**BITS)


def permuted(i: Column, n: Column, *parts: Column | str | int) -> Column:
    """The ``i``-th of the numbers 0 .. n-1 in a random order that the parts fix.

    Numbers are pairs on a grid of about the root of ``n`` by itself; every round moves
    one half by a hash of the other, which can be undone, so all rounds together
    put the grid in another order.  The grid is less than a root larger than ``n``;
    a number from ``n`` on goes through the rounds again until it is below.  Up to n =
    576 it must get there within the steps allowed; beyond, it fails to in one of n^12
    cases, and then raises an error.
    """
    side = F.ceil(F.sqrt(n)).cast("bigint")
    other = _div(n + side - 1, side)

    def turn(x: Column, r: Column) -> Column:
        high, low = _div(x, other), x % other
        up = ((high + whole(*parts, r, low)) % side) * other + low
        along = high * other + (low + whole(*parts, r, high)) % other
        return F.when(r % 2 == 0, up).otherwise(along)

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    mixed = lambda x: F.aggregate(rounds, x.cast("bigint"), turn)
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), mixed(i), lambda x, _: F.when(x < n, x).otherwise(mixed(x))
    )
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("walk of a shuffled number did not end")).cast("bigint"))


def _div(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast("bigint")


def normal(*parts: Column | str | int) -> Column:
    """Standard normal number (Box-Muller on two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "a"))


def integer(low: Column | int, high: Column | int, *parts: Column | str | int) -> Column:
    """Whole number in [low, high)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(*parts) * (high - low))).cast("bigint")
