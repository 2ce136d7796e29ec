"""Tails of distributions as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the error function's series gives way to its continued fraction, and terms of each.
NEAR, TERMS, LEVELS = 2.5, 60, 80


def erfc(z: Column) -> Column:
    """The complementary error function: a series of positive terms for small arguments, a continued fraction for large ones."""
    x = F.abs(z)
    near = F.when(x <= NEAR, x)  # the other form is not made of what it is not for
    state = F.struct(near.alias("term"), near.alias("sum"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, lambda s, n: F.struct((s["term"] * 2 * near * near / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * near * near / (2 * n + 1)).alias("sum")), lambda s: s["sum"])
    inner = 1 - 2 / math.sqrt(math.pi) * F.exp(-near * near) * grown
    far = F.when(x > NEAR, x)
    below = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), far, lambda s, n: far + n / 2 / s)
    outer = F.exp(-far * far) / math.sqrt(math.pi) / below
    upper = F.when(x <= NEAR, inner).otherwise(outer)
    return F.when(z >= 0, upper).otherwise(2 - upper)


def normal_cdf(z: Column) -> Column:
    return erfc(-z / math.sqrt(2)) / 2


def chi2_tail(x: Column, k: Column) -> Column:
    """P(chi-squared with ``k`` degrees of freedom, a whole number, > x): a finite sum, and for odd ``k`` twice the normal tail before it."""
    half, odd = x / 2, F.pmod(k, F.lit(2)) == 1
    first = F.when(odd, F.exp(-half) * F.sqrt(half) * 2 / math.sqrt(math.pi)).otherwise(F.exp(-half))
    shift = F.when(odd, 0.5).otherwise(0.0)
    count = F.floor((k - F.when(odd, 1).otherwise(0)) / 2).cast("int")
    state = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), state, lambda s, i: F.struct((s["term"] * half / (i + shift)).alias("term"), (s["sum"] + F.when(i <= count, s["term"]).otherwise(0.0)).alias("sum")), lambda s: s["sum"])
    return F.when(x.isNull() | k.isNull(), F.lit(None)).when(x <= 0, 1.0).otherwise(F.when(odd, erfc(F.sqrt(half))).otherwise(0.0) + total)
