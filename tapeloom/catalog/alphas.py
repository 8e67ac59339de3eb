"""The formulaic alphas over the monthly panel: all in batches that share their parts, and some by SQL too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import sql
from tapeloom.catalog import factor_sql
from tapeloom.plans.alphas import FORMULAS, alphas
from tapeloom.plans.compile import evaluate
from tapeloom.plans.expression import parse
from tapeloom.sources import market

#: Factors in one plan: enough to share windows, few enough for the planner.
BATCH = 14
_O = "(PARTITION BY symbol ORDER BY datetime)"
_SIMPLE = {
    6: ("-1 * CASE WHEN count(*) OVER w = 10 THEN (covar_samp(open, volume) OVER w) / nullif((stddev_samp(open) OVER w) * (stddev_samp(volume) OVER w), 0) END"),
    12: f'sign(volume - lag(volume) OVER {_O}) * (-1 * ("close" - lag("close") OVER {_O}))',
    23: f"CASE WHEN count(*) OVER v = 20 AND avg(high) OVER v < high THEN -1 * (high - lag(high, 2) OVER {_O}) ELSE 0 END",
    41: "sqrt(high * low) - vwap",
    49: f'CASE WHEN (lag("close", 20) OVER {_O} - lag("close", 10) OVER {_O}) / 10 - (lag("close", 10) OVER {_O} - "close") / 10 < -0.1 THEN 1 ELSE -1 * ("close" - lag("close") OVER {_O}) END',
    53: f'-1 * (((("close" - low) - (high - "close")) / nullif("close" * 1.000001::DOUBLE - low, 0)) - lag((("close" - low) - (high - "close")) / nullif("close" * 1.000001::DOUBLE - low, 0), 9) OVER {_O})',
    54: '-1 * (low - "close") * pow(open, 5) / nullif((low * 1.000001::DOUBLE - high) * pow("close", 5), 0)',
    101: '("close" - open) / (high - low + 0.001::DOUBLE)',
}


#: Formulas that rank correlations or logarithms which are equal but for the last bits: two engines
#: order those each their own way (2 and 72 do so too, but only on tables of 80,000 bars).
TIES = (13, 15, 16, 31, 45, 71, 85, 88, 94, 96, 98)


def _batches() -> dict[str, list[int]]:
    numbers = [n for n in FORMULAS if n not in TIES]
    return {f"alpha_batch_{i // BATCH + 1}": numbers[i : i + BATCH] for i in range(0, len(numbers), BATCH)}


def _batch(numbers: list[int]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = evaluate(market.panel(spark, sf_dir), alphas(numbers))
        return found.select("symbol", "datetime", *(factor_sql.tidy(F.col(c)).alias(c) for c in found.columns[2:]))

    return run


def _one(n: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(evaluate(market.panel(spark, sf_dir), alphas([n])))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    batches = {k: _batch(v) for k, v in (_batches() | {"alpha_batch_ties": list(TIES)}).items()}
    return batches | {f"alpha_{n:03d}": _one(n) for n in _SIMPLE}


def oracle_sql() -> dict[str, str]:
    batches = {k: factor_sql.query({name: parse(text) for name, text in alphas(numbers).items()}) for k, numbers in _batches().items()}
    return batches | {
        f"alpha_{n:03d}": f"WITH {sql.PANEL} SELECT symbol, datetime, ({value})::FLOAT::DOUBLE AS alpha{n:03d} FROM panel WINDOW {sql.window(10)}, {sql.window(20, 'v')}" for n, value in _SIMPLE.items()
    }
