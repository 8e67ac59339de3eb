"""Queries of scores, inverse scales, set operations and orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import sql
from tapeloom.catalog.events import frame
from tapeloom.catalog.events import oracle_sql as events_sql
from tapeloom.functions import safe
from tapeloom.operators import evaluate, events, order, signals
from tapeloom.plans.compile import evaluate as factors
from tapeloom.sources import market

_DAY = "(PARTITION BY symbol ORDER BY datetime)"


def _crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = factors(market.panel(spark, sf_dir), {"fast": "EMA($close, 3)", "slow": "EMA($close, 8)"})
    return signals.crossovers(means, "fast", "slow", 12)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = market.table(spark, sf_dir, "orders")
    p, y = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000, (F.col("o_orderstatus") == "F").cast("int")
    return sql.singles(o.groupBy("o_orderpriority").agg(events.log_loss(p, y).alias("log_loss"), events.accuracy(p, y).alias("accuracy")))


def _unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.panel(spark, sf_dir).select("symbol", "datetime", "volume", "money")
    there = events.scaled(events.scaled(rows, ["volume"], "minmax"), ["money"], "standard")
    return sql.singles(events.unscaled(events.unscaled(there, rows, ["volume"], "minmax"), rows, ["money"], "standard"))


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.table(spark, sf_dir, "customer").select("c_custkey").intersect(market.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    odd = F.when(F.col("open_interest") % 2 == 1, F.col("volume"))
    return sql.singles(p.select("symbol", "datetime", safe.total(F.col("open"), odd, F.col("close")).alias("total")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "sig_ema_crossover": _crossover, "ev_scores": _scores, "ev_unscaled": _unscaled, "sort_intersect": _bought, "agg_horizontal_sum": _totals,
        "sort_shuffled": lambda s, d: order.shuffled(market.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7),
        "eval_by_name": lambda s, d: sql.singles(evaluate.analysis("autocorrelation")(frame(s, d), "f1", "label_1")),
        "eval_ic_decay": lambda s, d: sql.singles(evaluate.ic_decay(frame(s, d), "f1", 1, 4)),
    }


def _ema(n: int) -> str:
    keep = f"{1 - 2 / (n + 1)!r}::DOUBLE"
    return f'(SELECT sum(b."close" * pow({keep}, a.i - b.i)) / sum(pow({keep}, a.i - b.i)) FROM n b WHERE b.symbol = a.symbol AND b.i <= a.i)'


def oracle_sql() -> dict[str, str]:
    p = f"WITH {sql.PANEL}"
    crossed = f"""{p}, n AS (SELECT *, row_number() OVER {_DAY} AS i FROM panel), m AS MATERIALIZED (SELECT symbol, datetime, i, {_ema(3)} AS f, {_ema(8)} AS s FROM n a),
k AS (SELECT *, lag(f) OVER {_DAY} AS f1, lag(s) OVER {_DAY} AS s1 FROM m) SELECT symbol, datetime, CASE WHEN i <= 12 THEN 0 WHEN f1 < s1 AND f > s THEN 1 WHEN f1 > s1 AND f < s THEN -1 ELSE 0 END AS cross FROM k"""
    scores = """SELECT o_orderpriority, -avg(CASE WHEN y THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END) AS log_loss, avg((p >= 0.5)::INT = y::INT) AS accuracy
FROM (SELECT o_orderpriority, o_orderkey * 7919 % 1000 / 1000.0::DOUBLE AS p, o_orderstatus = 'F' AS y FROM orders) GROUP BY ALL"""
    raw = {
        "sig_ema_crossover": (crossed, ()), "ev_scores": (scores.replace("avg((p >= 0.5)::INT = y::INT)", "avg(((p >= 0.5)::INT = y::INT)::INT)"), ("log_loss", "accuracy")),
        "ev_unscaled": (f"{p} SELECT symbol, datetime, volume, money FROM panel", ("volume", "money")),
        "sort_intersect": ("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders", ()),
        "agg_horizontal_sum": (f'{p} SELECT symbol, datetime, list_sum([open, CASE WHEN open_interest % 2 = 1 THEN volume END, "close"]) AS total FROM panel', ("total",)),
        "sort_shuffled": ("SELECT o_orderkey, row_number() OVER (ORDER BY substr(md5('7:' || o_orderkey), 1, 15), o_orderkey) - 1 AS position FROM orders", ()),
    }
    return {k: sql.rounded(q, *c) for k, (q, c) in raw.items()} | {"eval_by_name": events_sql()["eval_autocorr"]}
