"""Column expressions on dense vectors; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up; what rounds to nought keeps its sign, which F.round drops."""
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def mean_pooled(tokens: Column, dim: int) -> Column:
    """The mean of token vectors; another dimension than dim raises, no tokens give null."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(tokens, zero, lambda s, t: F.when(F.size(t) == dim, F.zip_with(s, t, lambda x, y: x + y.cast("double"))).otherwise(F.raise_error(F.lit("wrong dimension"))))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda x: x / F.size(tokens)))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """The value's place between low and high; a half if they are equal."""
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((value - low) / (high - low))
