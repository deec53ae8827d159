"""Vectors as arrays: products and similarities in double precision, inside whole-stage code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, n: int = 9) -> Column:
    """``x`` rounded as SQL engines round a double: times 10^n to a whole number, halves away from zero, and divided again.

    ``F.round`` goes by the decimal digits of the double instead, which gives another last digit near halves.
    """
    return F.round(x * F.lit(10.0**n), 0) / F.lit(10.0**n)


def _rounding() -> Callable[..., np.ndarray]:
    def rounded_np(x: np.ndarray, n: int = 9) -> np.ndarray:
        y = np.abs(x) * 10.0**n
        whole = np.floor(y)
        return np.copysign((whole + (y - whole >= 0.5)) / 10.0**n, x)

    return rounded_np


#: The same in numpy, whose own ``round`` takes halves to the even side.  As a local function it travels to workers by value.
rounded_np = _rounding()


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, kept within 0 and 1; 0 if either is missing."""
    d = dot(a, b)
    return F.when(d.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))


def mean_vector(vectors: Column, size: int) -> Column:
    zero = F.array(*[F.lit(0.0)] * size)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
