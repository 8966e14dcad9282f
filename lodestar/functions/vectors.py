"""Vector expressions over array columns. Sums are taken in DOUBLE (floats) or INT (codes), in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(products: Column, kind: str = "double") -> Column:
    return F.aggregate(products, F.lit(0).cast(kind), lambda a, x: a + x)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    """Sum of a[i] * b[i]."""
    return _fold(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), kind)


def l2(a: Column, b: Column, kind: str = "double") -> Column:
    """Sum of (a[i] - b[i])^2."""
    d = lambda x, y: x.cast(kind) - y.cast(kind)
    return _fold(F.zip_with(a, b, lambda x, y: d(x, y) * d(x, y)), kind)


def sqnorm(a: Column, kind: str = "double") -> Column:
    return _fold(F.transform(a, lambda x: x.cast(kind) * x.cast(kind)), kind)


def quantise(x: Column, top: float) -> Column:
    """int8 codes under one global scale, halves away from zero."""
    return F.transform(x, lambda v: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(v.cast("double") * 127 / F.lit(top)))).cast("tinyint"))


def unit(x: Column, mean: list[float], length: float = 1.0) -> Column:
    """Centred, of the given length; the norm counts as at least 1e-9."""
    c = F.zip_with(x, F.array(*map(F.lit, mean)), lambda v, m: v.cast("double") - m)
    norm = F.greatest(F.sqrt(sqnorm(c)), F.lit(1e-9))
    return F.zip_with(c, F.array_repeat(norm, len(mean)), lambda v, n: length * (v / n))
