"""Scalar column helpers (rounding, finite-safe values, guarded division, metric terms)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite(c: Column, otherwise: Column | None = None) -> Column:
    """``c`` where it is a finite number, else ``otherwise`` (null)."""
    return F.when(is_finite(c), c).otherwise(F.lit(None).cast("double") if otherwise is None else otherwise)


def guarded_divide(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """``a / b``; ``otherwise`` where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(c, hi), lo)


def present(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over complete pairs; 0 where it is undefined."""
    both = present(x) & present(y)
    a, b = F.when(both, x), F.when(both, y)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
