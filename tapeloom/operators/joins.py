"""Joins on time: as of, point in interval, interval overlap, with buckets or sweeps instead of products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], strict: bool = False) -> DataFrame:
    """``left`` with the last earlier (or, unless strict, equal) right row's values: one sort of the union of both.

    The right side should be unique by (by, on); of ties the greatest values win.
    """
    keys = [*by, on]
    own = left.select(*keys, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"))
    other = right.select(*keys, F.lit(None).cast(own.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    rank = F.when(F.col("_l").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    w = Window.partitionBy(*by).orderBy(on, rank, "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = own.union(other).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    return found.select("_l.*", *(F.col(f"_r.{v}").alias(v) for v in values))


def _days(a: Column, b: Column, days: int) -> Column:
    bucket = lambda c: F.floor(F.unix_date(c.cast("date")) / days)
    return F.explode(F.sequence(bucket(a), bucket(b)))


def point_in_interval(points: DataFrame, spans: DataFrame, on: str, start: str, end: str, by: Sequence[str], days: int = 31) -> DataFrame:
    """Pairs with start <= on <= end, met in buckets of days; ``days`` should be about the usual length of a span."""
    p = points.withColumn("_b", F.floor(F.unix_date(F.col(on).cast("date")) / days))
    s = spans.withColumn("_b", _days(F.col(start), F.col(end), days))
    return p.join(s, [*by, "_b"]).where(F.col(on).between(F.col(start), F.col(end))).drop("_b")


def overlaps(a: DataFrame, b: DataFrame, start: str, end: str, by: Sequence[str], days: int = 31) -> DataFrame:
    """(by, a_id, b_id) of spans (id, start, end) that overlap; each pair is kept in the first bucket that both are in."""
    left = a.select(*by, F.col("id").alias("a_id"), F.col(start).alias("a0"), F.col(end).alias("a1")).withColumn("_b", _days(F.col("a0"), F.col("a1"), days))
    right = b.select(*by, F.col("id").alias("b_id"), F.col(start).alias("b0"), F.col(end).alias("b1")).withColumn("_b", _days(F.col("b0"), F.col("b1"), days))
    both = left.join(right, [*by, "_b"]).where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    first = F.floor(F.unix_date(F.greatest("a0", "b0").cast("date")) / days)
    return both.where(F.col("_b") == first).select(*by, "a_id", "b_id")


def shifted_left(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join to the right's values of one row earlier, so that nothing is known before its time."""
    w = Window.partitionBy(*by).orderBy(on)
    late = right.select(*by, on, *(F.lag(v).over(w).alias(v) for v in values))
    return left.join(late, [*by, on], "left")


def interpolated(df: DataFrame, column: str, by: Sequence[str], order: str) -> Column:
    """Linear interpolation between the neighbours that are not NULL, by row position; NULL at the ends."""
    w = Window.partitionBy(*by).orderBy(order)
    i, x = F.row_number().over(w), F.col(column)
    here = F.when(x.isNotNull(), F.struct(i.alias("i"), x.cast("double").alias("v")))
    a = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(x.cast("double"), a["v"] + (b["v"] - a["v"]) * F.try_divide((i - a["i"]).cast("double"), (b["i"] - a["i"]).cast("double")))
