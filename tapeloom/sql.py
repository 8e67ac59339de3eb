"""Pieces of SQL that the comparison queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PANEL = """panel AS (
  SELECT l_suppkey AS symbol, date_trunc('month', l_shipdate)::DATE AS datetime,
    first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS "close", sum(l_quantity) AS volume,
    sum(l_extendedprice) AS money, sum(l_extendedprice) / sum(l_quantity) AS vwap, count(*)::DOUBLE AS open_interest
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY ALL)"""
TICKS = """ticks AS (
  SELECT user_id AS symbol, ts, value AS price, json_extract_string(props, '$.k')::DOUBLE + 1 AS quantity, event_id % 2 = 0 AS buyer_maker, event_id AS trade_id
  FROM events)"""


def window(n: int, name: str = "w") -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def single(x: Column) -> Column:
    """Rounded to single precision, so that the order of additions doesn't show."""
    return x.cast("float").cast("double")


def singles(df: DataFrame) -> DataFrame:
    """All DOUBLE columns rounded to single precision, timestamps without a zone."""
    kinds = {"double": single, "timestamp": lambda c: c.cast("timestamp_ntz")}
    return df.select(*(kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


def rounded(query: str, *columns: str) -> str:
    """SQL whose named columns are rounded to single precision."""
    return query if not columns else f"SELECT * REPLACE ({', '.join(f'({c})::FLOAT::DOUBLE AS {c}' for c in columns)}) FROM ({query})"
