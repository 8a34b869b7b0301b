"""Exact vector arithmetic as column expressions.

For pairs that already exist as rows. Searching many vectors against many
queries goes through :mod:`waymark.operators.nearest` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    def gap(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _total(F.zip_with(a, b, gap))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector has no direction (NULL)."""
    size = norm(a)
    # repeated, not captured: a lambda would work out the norm per element
    sizes = F.array_repeat(size, F.size(a))
    return F.when(size > 0, F.zip_with(a, sizes, lambda x, n: x.cast("double") / n))
