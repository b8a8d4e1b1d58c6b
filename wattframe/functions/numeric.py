"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import EPS_PERCENT


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return _col(c).try_cast("double")


def clip0(c) -> Column:
    """Null stays null (``greatest`` alone would turn it into 0)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))


def pct_change(a, b) -> Column:
    """Change from ``b`` to ``a`` in percent, with a floor under the divisor."""
    a, b = _col(a), _col(b)
    return F.when(b.isNotNull(), (a - b) / F.greatest(F.lit(EPS_PERCENT), b) * 100.0)


def band(y, pct: float = 0.12) -> tuple[Column, Column]:
    """Lower and upper bound at ``pct`` around ``y``; the lower one is not negative."""
    y = _col(y)
    return clip0(y * (1.0 - pct)), y * (1.0 + pct)


def envelope(mean, std) -> tuple[Column, Column]:
    """One standard deviation around the mean; the lower bound is not negative."""
    mean, std = _col(mean), _col(std)
    return clip0(mean - std), mean + std


def min_max(y, lo, hi) -> Column:
    """Scale to 0..1; a constant series (hi = lo) gives 0."""
    y, lo, hi = _col(y), _col(lo), _col(hi)
    return (y - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)


def min_max_inverse(z, lo, hi) -> Column:
    z, lo, hi = _col(z), _col(lo), _col(hi)
    return z * F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo) + lo


def wh_to_kwh(c) -> Column:
    return _col(c) / 1000.0


def kwh_to_mwh(c) -> Column:
    return _col(c) / 1000.0
