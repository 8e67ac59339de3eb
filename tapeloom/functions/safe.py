"""Arithmetic in which undefined means NULL, never an error, NaN or infinity; ``ieee_`` functions follow IEEE 754 instead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def over(column: Column, window: WindowSpec | None) -> Column:
    return column if window is None else column.over(window)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x.cast("double"), y.cast("double"))


def ieee_ratio(x: Column, y: Column) -> Column:
    """x / y as SQL engines with IEEE 754 divide: by zero it is infinite with the sign of x, and NaN for 0 / 0."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, x * F.lit(float("inf"))).otherwise(F.try_divide(x, y))


def ieee_ln(x: Column) -> Column:
    """Logarithm: minus infinity at zero, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def corr(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs without NULL; NULL where a side does not vary.

    Spark's own ``corr`` raises there under ANSI rules.
    """
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x.cast("double")), F.when(pair, y.cast("double"))
    return F.try_divide(over(F.covar_samp(a, b), window), over(F.stddev_samp(a), window) * over(F.stddev_samp(b), window))


def full(n: int, x: Column, value: Column, window: WindowSpec) -> Column:
    """``value`` where all n rows of the window have an x, else NULL."""
    return F.when(F.count(x).over(window) == n, value)


def pairs(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function; Abramowitz & Stegun 7.1.26, off by less than 1.5e-7."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1 / (1 + F.lit(0.3275911) * z)
    # Fixed values of the published approximation.
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def average_rank(x: Column, partition: Sequence[str], window: type) -> Column:
    """Rank from 1 among the partition's non-NULL values, ties averaged; NULL for NULL."""
    order = window.partitionBy(*partition).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(window.partitionBy(*partition, x)) - 1) / 2)


def total(*columns: Column) -> Column:
    """Sum across a row's columns, NULLs left out; 0 if all are."""
    return F.aggregate(F.filter(F.array(*(c.cast("double") for c in columns)), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
