"""One query for each operator of the factor language, over the monthly panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import sql
from tapeloom.plans.compile import factor
from tapeloom.sources import market


def _full(value: str, x: str = '"close"', n: int = 5) -> str:
    return f"CASE WHEN count({x}) OVER w = {n} THEN {value} END"


def _rank(values: str, x: str) -> str:
    return f"(len(list_filter({values}, lambda e: e < {x})) + (len(list_filter({values}, lambda e: e = {x})) + 1) / 2.0) / len({values})"


_I = "row_number() OVER (PARTITION BY symbol ORDER BY datetime)"
_ROWS = 'list("close") OVER w'
_CORR = '(covar_samp("close", volume) OVER w) / nullif((stddev_samp("close") OVER w) * (stddev_samp(volume) OVER w), 0)'
_M = 'avg("close") OVER w'
#: Centred moments of a window's closes, which the two engines define alike.
_POW = 'list_sum(list_transform(list("close") OVER w, lambda v: (v - {m}) ** {k})) / 5.0'
#: name: (expression, SQL of the factor)
OPS: dict[str, tuple[str, str]] = {
    "op_flagship": ("CSRank($close / Ref($close, 5) - 1)", ""),
    "op_feature": ("$close", '"close"'), "op_constant": ("Add($close, 2)", '"close" + 2'), "op_neg": ("-$close", '-"close"'), "op_abs": ("Abs($open - $close)", 'abs(open - "close")'),
    "op_sign": ("Sign($open - $close)", 'sign(open - "close")'), "op_log": ("Log($close)", 'ln("close")'),
    "op_add": ("$open + $close", 'open + "close"'), "op_sub": ("$open - $close", 'open - "close"'), "op_mul": ("$open * $close", 'open * "close"'), "op_div": ("$open / ($high - $low)", "open / nullif(high - low, 0)"),
    "op_greater": ("Greater($open, $close)", 'greatest(open, "close")'), "op_less": ("Less($open, $close)", 'least(open, "close")'),
    "op_gt": ("$open > $close", 'open > "close"'), "op_ge": ("$open >= $close", 'open >= "close"'), "op_lt": ("$open < $close", 'open < "close"'), "op_le": ("$open <= $close", 'open <= "close"'),
    "op_eq": ("$high == $close", 'high = "close"'), "op_ne": ("$high != $close", 'high <> "close"'),
    "op_and": ("($open > $close) & ($volume > 100)", 'open > "close" AND volume > 100'), "op_or": ("($open > $close) | ($volume > 100)", 'open > "close" OR volume > 100'),
    "op_power": ("($close / $open) ** 2", '("close" / open) ** 2'), "op_if": ("If($open > $close, $open, -$close)", 'CASE WHEN open > "close" THEN open ELSE -"close" END'),
    "op_ref": ("Ref($close, 3)", 'lag("close", 3) OVER o'), "op_ref_ahead": ("Ref($close, -2)", 'lead("close", 2) OVER o'), "op_delta": ("Delta($close, 3)", '"close" - lag("close", 3) OVER o'),
    "op_mean": ("Mean($close, 5)", _full('avg("close") OVER w')), "op_sum": ("Sum($close, 5)", _full('sum("close") OVER w')),
    "op_wma": ("WMA($close, 5)", _full("(" + " + ".join(f'{5 - k} * lag("close", {k}) OVER o' for k in range(5)) + ") / 15")),
    "op_ema": ("EMA($close, 5)", '(SELECT sum(b."close" * pow(2 / 3.0::DOUBLE, a.i - b.i)) / sum(pow(2 / 3.0::DOUBLE, a.i - b.i)) FROM n b WHERE b.symbol = a.symbol AND b.i <= a.i)'),
    "op_prod": ("Prod($close / $open, 5)", 'product("close" / open) OVER w'), "op_std": ("Std($close, 5)", _full('stddev_samp("close") OVER w')), "op_var": ("Var($close, 5)", _full('var_samp("close") OVER w')),
    "op_skew": ("Skew($close, 5)", _full(f"({_POW.format(m=_M, k=3)}) / nullif(pow({_POW.format(m=_M, k=2)}, 1.5), 0)")),
    "op_kurt": ("Kurt($close, 5)", _full(f"({_POW.format(m=_M, k=4)}) / nullif(pow({_POW.format(m=_M, k=2)}, 2), 0) - 3")),
    "op_max": ("Max($close, 5)", _full('max("close") OVER w')), "op_min": ("Min($close, 5)", _full('min("close") OVER w')),
    "op_idxmax": ("IdxMax($close, 5)", f"list_position({_ROWS}, list_max({_ROWS}))"), "op_idxmin": ("IdxMin($close, 5)", f"list_position({_ROWS}, list_min({_ROWS}))"),
    "op_full_idxmax": ("FullIdxMax($close, 5)", _full(f"list_position({_ROWS}, list_max({_ROWS})) - 1")), "op_full_idxmin": ("FullIdxMin($close, 5)", _full(f"list_position({_ROWS}, list_min({_ROWS})) - 1")),
    "op_quantile": ("Quantile($close, 5, 0.8)", _full(f"list_sort({_ROWS})[4]")), "op_median": ("Median($close, 5)", _full('median("close") OVER w')),
    "op_mad": ("Mad($close, 5)", f'list_avg(list_transform({_ROWS}, lambda v: abs(v - {_M})))'), "op_rank": ("Rank($close, 5)", _rank(_ROWS, '"close"')),
    "op_count": ("Count(Ref($close, 2), 5)", 'CASE WHEN count(*) OVER w = 5 THEN count(r) OVER w END'),
    "op_slope": ("Slope($close, 5)", 'regr_slope("close", i) OVER w'), "op_rsquare": ("Rsquare($close, 5)", '((covar_samp("close", i) OVER w) / nullif((stddev_samp("close") OVER w) * (stddev_samp(i) OVER w), 0)) ** 2'),
    "op_resi": ("Resi($close, 5)", '"close" - ((regr_slope("close", i) OVER w) * i + (regr_intercept("close", i) OVER w))'),
    "op_corr": ("Corr($close, $volume, 5)", _full(_CORR)), "op_cov": ("Cov($close, $volume, 5)", _full('covar_samp("close", volume) OVER w')),
    "op_csrank": ("CSRank($close)", '(rank() OVER (PARTITION BY datetime ORDER BY "close") + (count(*) OVER (PARTITION BY datetime, "close") - 1) / 2.0) / count(*) OVER (PARTITION BY datetime)'),
    "op_csscale": ("CSScale($close - $open)", '("close" - open) / nullif(sum(abs("close" - open)) OVER (PARTITION BY datetime), 0)'),
    "op_nested": ("Mean(CSRank(Delta($close, 1)), 3)", ""),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    # A residual is a small difference of large numbers: thousandths are what both engines agree on, and zero has no sign.
    tidy = (lambda x: F.round(x, 3) + 0.0) if text.startswith("Resi") else sql.single
    return lambda spark, sf_dir: factor(market.panel(spark, sf_dir), text).select("symbol", "datetime", tidy(F.col("factor")).alias("factor"))


def _sql(value: str) -> str:
    return (
        f"WITH {sql.PANEL}, n AS (SELECT *, {_I} AS i, lag(\"close\", 2) OVER (PARTITION BY symbol ORDER BY datetime) AS r FROM panel)\n"
        f"SELECT symbol, datetime, ({value})::FLOAT::DOUBLE AS factor FROM n a WINDOW o AS (PARTITION BY symbol ORDER BY datetime), {sql.window(5)}"
    )


_RETURN = f"""WITH {sql.PANEL}, n AS (SELECT *, "close" / lag("close", 5) OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS x FROM panel)
SELECT symbol, datetime, (CASE WHEN x IS NOT NULL THEN
  (rank() OVER (PARTITION BY datetime ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY datetime, x) - 1) / 2.0) / count(x) OVER (PARTITION BY datetime) END)::FLOAT::DOUBLE AS factor FROM n"""
_NESTED = f"""WITH {sql.PANEL}, n AS (SELECT *, "close" - lag("close") OVER (PARTITION BY symbol ORDER BY datetime) AS x FROM panel),
c AS (SELECT *, CASE WHEN x IS NOT NULL THEN
  (rank() OVER (PARTITION BY datetime ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY datetime, x) - 1) / 2.0) / count(x) OVER (PARTITION BY datetime) END AS y FROM n)
SELECT symbol, datetime, (CASE WHEN count(y) OVER w = 3 THEN avg(y) OVER w END)::FLOAT::DOUBLE AS factor FROM c WINDOW {sql.window(3)}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(text) for k, (text, _) in OPS.items()}


def oracle_sql() -> dict[str, str]:
    made = {k: _sql(v) for k, (_, v) in OPS.items() if v}
    made["op_resi"] = made["op_resi"].replace(")::DOUBLE)::FLOAT::DOUBLE", "").replace("SELECT symbol, datetime, (", "SELECT symbol, datetime, round((", 1).replace(")::FLOAT::DOUBLE AS factor", "), 3) + 0.0 AS factor")
    return made | {"op_flagship": _RETURN, "op_nested": _NESTED}
