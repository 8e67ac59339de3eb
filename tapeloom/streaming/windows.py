"""Windows over event time that give the same rows in batch and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets in microseconds of a window's (start, end) against the event, by which ends belong to it.
BEHAVIOURS = {"left_open": (1, 0), "right_open": (0, -1), "closed": (0, 0), "open": (1, -1)}


def vwap() -> Column:
    """Mean price by volume; 0 for no trades."""
    return F.coalesce(F.try_divide(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")), F.lit(0.0)).alias("vwap")


def imbalance() -> Column:
    """Bought less sold over both."""
    buy, sell = (F.sum(F.when(F.col("buyer_maker") == maker, F.col("quantity")).otherwise(0.0)) for maker in (False, True))
    return F.coalesce(F.try_divide(buy - sell, buy + sell), F.lit(0.0)).alias("imbalance")


def tumbling(trades: DataFrame, interval: str, *aggregates: Column, offset: str | None = None, late: str | None = None) -> DataFrame:
    """(symbol, start, end, aggregates) of windows aligned to the epoch, or ``offset`` after it; rows ``late`` are dropped on a stream."""
    given = trades.withWatermark("ts", late) if late else trades
    made = given.groupBy("symbol", F.window("ts", interval, startTime=offset).alias("w")).agg(*aggregates)
    return made.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *made.columns[2:])


def hopping(trades: DataFrame, interval: str, slide: str, *aggregates: Column, late: str | None = None) -> DataFrame:
    given = trades.withWatermark("ts", late) if late else trades
    made = given.groupBy("symbol", F.window("ts", interval, slide).alias("w")).agg(*aggregates)
    return made.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *made.columns[2:])


def sliding(trades: DataFrame, seconds: int, behaviour: str = "right_open") -> DataFrame:
    """Each trade with vwap and imbalance of the ``seconds`` up to it; ``behaviour`` says which ends belong."""
    left, right = BEHAVIOURS[behaviour]
    w = Window.partitionBy("symbol").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000 + left, right)
    over = lambda c: F.sum(c).over(w)
    q, buy = F.col("quantity"), F.when(~F.col("buyer_maker"), F.col("quantity")).otherwise(0.0)
    total, bought = over(q), over(buy)
    return trades.select(
        "symbol", "ts", "trade_id", F.coalesce(F.try_divide(over(F.col("price") * q), total), F.lit(0.0)).alias("vwap"),
        F.coalesce(F.try_divide(2 * bought - total, total), F.lit(0.0)).alias("imbalance"),
    )


def last_trades_imbalance(trades: DataFrame, interval: str, lookback: int = 100) -> DataFrame:
    """Imbalance of each window's last ``lookback`` trades."""
    w = Window.partitionBy("symbol", "w").orderBy(F.col("ts").desc(), F.col("trade_id").desc())
    last = trades.withColumn("w", F.window("ts", interval)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= lookback)
    return last.groupBy("symbol", "w").agg(imbalance()).select("symbol", F.col("w.start").alias("start"), "imbalance")
