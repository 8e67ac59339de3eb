"""Positions and running aggregates over the order of a whole table, without a task that holds it.

The order is cut into ranges at approximate quantiles of its first column; a value that fills more
than one range is cut further by the second column. Rows are numbered and summed within a range,
and what comes before a range is added from a table with a row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into; about twice as many at most, when values are cut further.
RANGES = 200


def number(df: DataFrame, name: str) -> Column:
    """A date, time or number as a number in the same order, NULL first."""
    kind = dict(df.dtypes)[name]
    of = {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(F.to_timestamp_ltz(c))}.get(kind, lambda c: c)
    least = F.lit(float("-inf")) if kind in ("double", "float") else F.lit(-(2**63))
    return F.coalesce(of(F.col(name)).cast("double" if kind in ("double", "float") else "long"), least)


class Ranges:
    """Ranges of the order by (first, second) of ``df``; ``second`` must be a number, date or time too."""

    def __init__(self, df: DataFrame, first: str, second: str | None = None, ranges: int = RANGES):
        self.by = [first, *([second] if second else [])]
        quantiles = [i / ranges for i in range(1, ranges)]
        found = df.agg(F.percentile_approx(number(df, first), quantiles, 100 * ranges)).first()[0] or []
        heavy = sorted({x for a, x in zip(found, found[1:], strict=False) if a == x}) if second else []
        cuts = [(x, None) for x in sorted(set(found)) if x not in set(heavy)]
        if heavy:
            at = df.select(number(df, first).alias("x"), number(df, second).alias("y")).where(F.col("x").isin(heavy))
            counts = {x: found.count(x) for x in heavy}
            for x, own in at.groupBy("x").agg(F.percentile_approx("y", quantiles, 100 * ranges)).collect():
                step = max(1, len(own) // (counts[x] + 1))
                cuts += [(x, y) for y in sorted(set(own[step - 1 :: step]))]
        self.cuts = sorted(cuts, key=lambda c: (c[0], c[1] is None, c[1] or 0))
        self.n = len(self.cuts) + 1

    def bucket(self, df: DataFrame, first: str | None = None, second: str | None = None) -> Column:
        """The range of a row of ``df``, found by halving; ``first`` and ``second`` name other columns of the same kinds."""
        x = number(df, first or self.by[0])
        y = number(df, second or self.by[1]) if len(self.by) > 1 and (first is None or second) else None

        def below(cut: tuple) -> Column:
            a, b = cut
            return x <= a if b is None or y is None else (x < a) | (x == a) & (y <= b)

        def deal(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(below(self.cuts[mid]), deal(lo, mid)).otherwise(deal(mid + 1, hi))

        return deal(0, len(self.cuts))


def _offsets(cut: DataFrame, made: Callable[[], Column], start: float | int) -> Column:
    """What the ranges before each add up to, as an expression over ``_range``."""
    sums = dict(cut.groupBy("_range").agg(made()).collect())
    upto, total = [], start
    for i in range(max(sums, default=-1) + 1):
        upto.append(total)
        total += sums.get(i) or 0
    return F.get(F.array(*map(F.lit, upto or [start])), F.col("_range"))


def numbered(df: DataFrame, first: str, second: str | None = None, name: str = "_i") -> DataFrame:
    """Adds the position of each row, from 0."""
    ranges = Ranges(df, first, second)
    cut = df.withColumn("_range", ranges.bucket(df))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*ranges.by))
    return cut.withColumn(name, (own - 1 + _offsets(cut, lambda: F.count("*"), 0)).cast("long")).drop("_range")


def running_sum(df: DataFrame, value: str, first: str, second: str | None = None, name: str = "upto") -> DataFrame:
    """Adds the sum of ``value`` over the rows up to and with each row."""
    ranges = Ranges(df, first, second)
    cut = df.withColumn("_range", ranges.bucket(df))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*ranges.by).rowsBetween(Window.unboundedPreceding, 0))
    before = _offsets(cut, lambda: F.sum(F.col(value).cast("double")), 0.0)
    return cut.withColumn(name, own + before).drop("_range")


def shuffled(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """Adds the position of each row in an order that depends on the seed and the row's unique ``key`` alone."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    return numbered(df.withColumn("_draw", draw), "_draw", key, name).drop("_draw")
