"""Queries of bars over the ticks of ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom import sql
from tapeloom.operators import bars
from tapeloom.sources import market


def _on_ticks(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(make(market.ticks(spark, sf_dir)))


_QUERIES = {
    "bar_time_shifted": lambda t: bars.shifted_time_bars(t, 86400),
    "bar_clock": lambda t: bars.clock_bars(t, "1 day").drop("bar_end"),
    "bar_clock_filled": lambda t: bars.fill_empty(bars.clock_bars(t, "1 day"), "1 day"),
    "bar_volume": lambda t: bars.threshold_bars(t, "volume", 500).drop("ts_event"),
    "bar_value": lambda t: bars.threshold_bars(t, "value", 50000).drop("ts_event"),
    "bar_extended": lambda t: bars.extended_bars(t, 50000).drop("ts_event"),
    "bar_imbalance": lambda t: bars.imbalance_bars(t, 20, 1.5, 5000).drop("ts_init", "ts_event"),
    "bar_zscore": lambda t: bars.zscore_bars(t, 20, 1.5, 5000).drop("ts_init", "ts_event"),
    "bar_footprint": lambda t: bars.footprint_bars(t, "7 days", 10.0, 2.0).drop("bar_end"),
}
_O = "(PARTITION BY symbol ORDER BY ts, trade_id)"
_OHLC = "first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS \"close\""
_PRICES = ("open", "high", "low", '"close"', "volume")
_CLOCK = f"WITH {sql.TICKS} SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS bar_start, {_OHLC}, sum(quantity) AS volume FROM ticks GROUP BY ALL"


def _split(amount: str, step: int) -> str:
    d = "DECIMAL(28,6)"
    return f"""WITH {sql.TICKS}, r AS (SELECT *, ({amount})::{d} AS amount, sum(({amount})::{d}) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS upto FROM ticks),
p AS (SELECT *, upto - amount AS prior FROM r WHERE amount > 0),
s AS (SELECT *, unnest(generate_series(floor(prior::DOUBLE / {step})::BIGINT, greatest(floor(prior::DOUBLE / {step})::BIGINT, ceil(upto::DOUBLE / {step})::BIGINT - 1))) AS bar FROM p),
x AS (SELECT *, (least(upto, (bar + 1) * {step}) - greatest(prior, bar * {step}))::DOUBLE AS piece FROM s)"""


def _threshold(amount: str, step: int, quantity: str) -> str:
    return f"""{_split(amount, step)}
SELECT symbol, bar, {_OHLC}, sum({quantity}) AS volume, sum(piece) AS amount, round(sum(piece), 6) >= {step} AS "full" FROM x GROUP BY symbol, bar"""


_DIR = f"coalesce(last_value(nullif(m, 0) IGNORE NULLS) OVER {_O[:-1]} ROWS UNBOUNDED PRECEDING), 1)"


def _signal(signed: str, value_rule: str, more: str, keep: str) -> str:
    sides = ", ".join(
        f"coalesce(sum(price * quantity) FILTER ({'NOT' if s == 'buy' else ''} buyer_maker AND price * quantity {'< 5000' if b == 'small' else value_rule}), 0) AS {b}_{s}_value" for b in ("small", "big") for s in ("buy", "sell")
    )
    return f"""WITH {sql.TICKS}, m AS (SELECT *, sign(price - lag(price) OVER {_O}) AS m, price / lag(price) OVER {_O} - 1 AS change FROM ticks),
d AS (SELECT *, {_DIR} AS direction FROM m), g AS (SELECT *, {signed} AS signed FROM d),
z AS (SELECT *, CASE WHEN count(signed) OVER w = 20 THEN (signed - avg(signed) OVER w) / nullif(stddev_samp(signed) OVER w, 0) END AS z
  FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, coalesce(abs(z) > 1.5, false)::INT AS ends FROM z),
b AS (SELECT *, (sum(ends) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) - ends)::BIGINT AS bar FROM e),
a AS (SELECT symbol, bar, {_OHLC}, sum(quantity) AS volume, {sides}, max(ends) AS ends FROM b GROUP BY symbol, bar)
SELECT * EXCLUDE (ends){more} FROM a WHERE ends = 1 {keep}"""


_SIDES = ("small_buy_value", "big_buy_value", "small_sell_value", "big_sell_value")


def oracle_sql() -> dict[str, str]:
    levels = ", ".join(
        f"sum(CASE WHEN buyer_maker = {'false' if s == 'bids' else 'true'} AND level = {k} THEN piece ELSE 0 END) AS {s}_value_level_{k}" for s in ("bids", "asks") for k in range(5)
    )
    level = " + ".join(f"(price * quantity >= {k}::DOUBLE * 50000 / 11111)::INT" for k in bars.LEVEL_SHARES)
    raw = {
        "bar_time_shifted": (
            f"WITH {sql.TICKS}, o AS (SELECT *, floor(epoch(ts)::DOUBLE / 86400) AS own FROM ticks), g AS (SELECT *, coalesce(lag(own) OVER {_O}, own) AS g FROM o) "
            f"SELECT symbol, {_OHLC}, sum(quantity) AS volume, (max(own) * 86400)::BIGINT AS ts_event FROM g GROUP BY symbol, g", _PRICES,
        ),
        "bar_clock": (_CLOCK, _PRICES),
        "bar_clock_filled": (
            f"""WITH b AS ({_CLOCK}), c AS (SELECT symbol, unnest(generate_series(min(bar_start), max(bar_start), INTERVAL 1 DAY)) AS bar_start FROM b GROUP BY symbol),
j AS (SELECT c.symbol, c.bar_start, open, high, low, "close", volume, last_value("close" IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.bar_start ROWS UNBOUNDED PRECEDING) AS l
  FROM c LEFT JOIN b ON b.symbol = c.symbol AND b.bar_start = c.bar_start)
SELECT symbol, bar_start, coalesce(open, l) AS open, coalesce(high, l) AS high, coalesce(low, l) AS low, coalesce("close", l) AS "close", coalesce(volume, 0) AS volume FROM j""", _PRICES,
        ),
        "bar_volume": (_threshold("quantity", 500, "piece"), (*_PRICES, "amount")),
        "bar_value": (_threshold("price * quantity", 50000, "piece / price"), (*_PRICES, "amount")),
        "bar_extended": (
            f"{_split('price * quantity', 50000)} SELECT symbol, bar, {_OHLC}, sum(piece / price) AS volume, {levels} FROM (SELECT *, {level} AS level FROM x) GROUP BY symbol, bar",
            (*_PRICES, *(f"{s}_value_level_{k}" for s in ("bids", "asks") for k in range(5))),
        ),
        "bar_imbalance": (_signal("direction * price * quantity", ">= 5000", "", ""), (*_PRICES, *_SIDES)),
        "bar_zscore": (_signal("change * quantity * direction", "> 5000", ", big_buy_value - big_sell_value AS buyer_maker_imbalance", "AND bar > 0"), (*_PRICES, *_SIDES, "buyer_maker_imbalance")),
    }
    return {k: sql.rounded(q, *c) for k, (q, c) in raw.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _on_ticks(f) for k, f in _QUERIES.items()}
