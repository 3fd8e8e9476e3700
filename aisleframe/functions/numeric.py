"""Guarded arithmetic and array-vector products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate that is null, not an error, on a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def unit_vector(v: Column) -> Column:
    """L2-normalised copy of an array column; a zero vector stays zero.

    The length is bound once by an outer one-element transform; written inside
    the inner lambda it would be computed again for every element.
    """
    lengths = F.array(F.sqrt(dot(v, v)))
    scaled = F.transform(
        lengths, lambda n: F.transform(v, lambda p: F.coalesce(F.try_divide(p.cast("double"), n), F.lit(0.0)))
    )
    return F.element_at(scaled, 1)
