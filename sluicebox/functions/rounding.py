"""Decimal rounding of doubles as correct rounding does it: by the binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products with small integers are exact.
_SPLIT = 134217729.0


def round6(x: Column) -> Column:
    """x to six decimals as the exact value of the double demands, not its decimal spelling.

    Whether x lies below or above the middle between two candidates is the sign of x * 2,000,000 - (2k + 1), which is
    found without error: 2,000,000 is 128 * 15,625, a power of two changes no digits, and each half of x times 15,625 is
    exact in a double. Beyond 2^32, where six decimals are finer than the doubles themselves, x comes back as it is.
    """
    k = F.floor(F.abs(x) * 1e6)
    a = F.abs(x)
    c = a * _SPLIT
    high = c - (c - a)
    low = a - high
    middle = (2 * k + 1) / 128.0
    beyond = (high * 15625.0 - middle) + low * 15625.0
    up = (beyond > 0) | ((beyond == 0) & (k % 2 == 1))
    rounded = F.signum(x) * (k + F.when(up, F.lit(1)).otherwise(F.lit(0))) / 1e6
    return F.when(a < 2.0**32, rounded).otherwise(x)
