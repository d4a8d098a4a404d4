"""Exact decimal arithmetic on columns.

Counts and sums are aggregated as integers, which stay inside generated code,
and only the aggregated value becomes a decimal. Rounding is half away from
zero. A zero or missing divisor gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COUNT = "decimal(18,0)"
_AMOUNT = "decimal(28,4)"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _divide(numerator: Column, divisor: Column) -> Column:
    return numerator / F.nullif(divisor, F.lit(0))


def rounded(value: Column | str, digits: int = 2) -> Column:
    return F.round(as_column(value), digits).cast(f"decimal(20,{digits})")


def percent(part: Column | str, whole: Column | str) -> Column:
    """Unrounded ``part`` of ``whole`` in percent; both are counts."""
    return _divide(as_column(part).cast(_COUNT) * F.lit(100), as_column(whole).cast(_COUNT))


def rate_pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return rounded(percent(part, whole), digits)


def mean(total: Column | str, count: Column | str) -> Column:
    """Unrounded mean from an already summed total."""
    return _divide(as_column(total).cast(_AMOUNT), as_column(count).cast(_COUNT))


def mean_of(value: Column | str) -> Column:
    """Unrounded aggregate mean over the non-null values."""
    value = as_column(value)
    return mean(F.sum(value), F.count(value))


def pct_gap(actual: Column | str, target: Column | str) -> Column:
    """Unrounded distance of ``actual`` from ``target`` in percent of ``target``."""
    target = as_column(target)
    distance = (as_column(actual) - target).cast("decimal(24,10)")
    return _divide(distance * F.lit(100), target.cast("decimal(12,2)"))


def per_minute(amount: Column | str, seconds: Column | str) -> Column:
    """Amount per minute of one row, kept to eight decimals."""
    scaled = as_column(amount).cast("decimal(20,4)") * F.lit(60)
    return _divide(scaled, as_column(seconds).cast("decimal(12,0)")).cast("decimal(28,8)")
