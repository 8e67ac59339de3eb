"""Queries of rolling features and recurrences over the monthly panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import sql
from tapeloom.operators import features, recurrences
from tapeloom.plans.registry import Panel
from tapeloom.sources import market

N = 5


def _columns(made: dict) -> Callable[[DataFrame], DataFrame]:
    return lambda p: p.select("symbol", "datetime", *(c.alias(k) for k, c in made.items()))


def _message(p: DataFrame) -> DataFrame:
    ratio = F.col("close") / F.col("open")
    return p.withColumn("code", features.codes(ratio, 4, 0.0, 2.0)).withColumn("msg", features.message(F.col("code"), 8))


def _zeroed(df: DataFrame, *names: str) -> DataFrame:
    """What is next to nothing in these columns as 0: sums of different orders leave different traces of it."""
    return df.withColumns({c: F.when(F.abs(c) < 1e-6, 0.0).otherwise(F.col(c)) for c in names})


def _micro(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda p: features.microstructure(p, N).select("symbol", "datetime", *names)


_MADE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "feat_moments": lambda p: _zeroed(_columns(features.moments(F.col("close"), N))(p), "skewness", "kurt"),
    "feat_regression": lambda p: _columns(features.regression(F.col("close"), F.col("open"), N))(p).withColumn("residual", F.round("residual", 2) + 0.0),
    "feat_betas": lambda p: _columns(features.betas(F.col("open"), F.col("close"), N))(p),
    "feat_fracdiff": lambda p: _columns({"fracdiff": features.fracdiff(F.col("close"), 0.5, 10)})(p),
    "feat_codes": lambda p: _message(p).select("symbol", "datetime", "code"),
    "feat_shannon_entropy": lambda p: _message(p).select("symbol", "datetime", features.shannon_entropy(F.col("msg")).alias("entropy")),
    "feat_plugin_entropy": lambda p: _message(p).select("symbol", "datetime", features.plugin_entropy(F.col("msg"), 2).alias("entropy")),
    "feat_konto_entropy": lambda p: _message(p).select("symbol", "datetime", features.konto_entropy(2)(F.col("msg")).alias("entropy")),
    "feat_tick_direction": _micro("tick_direction"), "feat_roll_spread": _micro("roll_spread", "roll_variance"), "feat_high_low_volatility": _micro("high_low_volatility"),
    "feat_corwin_schultz": _micro("beta", "gamma", "alpha", "cs_spread", "cs_volatility"), "feat_bar_lambdas": _micro("kyle_bar", "amihud_bar", "hasbrouck_bar"),
    "feat_trade_lambdas": _micro("kyle_lambda", "amihud_lambda", "hasbrouck_lambda", "kyle_t", "amihud_t", "hasbrouck_t"), "feat_vpin": _micro("vpin"),
    "feat_peaks": lambda p: features.peaks(p, 2).withColumns({"n_last": F.size("last_peaks"), "oldest": F.element_at("last_peaks", 1)}).drop("last_peaks"), "feat_fair_value_gaps": features.fair_value_gaps,
    "feat_indicators": lambda p: _zeroed(features.indicators(p, N), "zscore"),
    "feat_ema": lambda p: recurrences.run(p, recurrences.ema(N)), "feat_kalman": lambda p: recurrences.run(p, recurrences.kalman()),
    "feat_supertrend": lambda p: recurrences.run(p, recurrences.supertrend(N, 2.0)), "feat_order_blocks": lambda p: recurrences.run(p, recurrences.order_blocks(3, 5.0)),
    "ev_cusum": lambda p: recurrences.run(p, recurrences.cusum(0.5)),
    "feat_sequences": lambda p: p.select("symbol", "datetime", F.to_json(F.collect_list(F.struct(F.col("volume").cast("long").alias("v"))).over(Panel().last(4))).alias("sequence")),
}


def _query(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(make(market.panel(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(f) for k, f in _MADE.items()}


def _sql(columns: dict[str, str], n: int = N, more: str = "", keys: str = "symbol, datetime") -> str:
    """Columns over the panel with the moves that features share; w: the last n rows."""
    o = "(PARTITION BY symbol ORDER BY datetime)"
    base = f"""WITH {sql.PANEL}, a AS (SELECT *, lag("close") OVER o AS c1, lag(high) OVER o AS h1, lag(low) OVER o AS l1, lag(open) OVER o AS o1, ln(high / low) ** 2 AS hl,
  row_number() OVER o AS i, (high + low + "close") / 3 AS tp FROM panel WINDOW o AS {o}),
b AS (SELECT *, "close" - c1 AS dp, ln("close" / c1) AS r, hl + lag(hl) OVER {o} AS hl2, ln(greatest(high, h1) / least(low, l1)) ** 2 AS g, "close" * volume AS dollar,
  coalesce(last_value(nullif(sign("close" - c1), 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING), 1) AS dir,
  greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, abs(high - l1) AS up, abs(low - h1) AS down, lag(tp) OVER {o} AS tp1,
  (("close" - low) - (high - "close")) / nullif(high - low, 0) * volume AS mf FROM a),
c AS (SELECT *, lag(dp) OVER {o} AS dp1, volume * dir AS sv, sqrt(dollar) * dir AS sd{more} FROM b)"""
    body = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in columns.items())
    return sql.rounded(f"{base} SELECT {keys}, {body} FROM c WINDOW {sql.window(n)}, o AS {o}", *columns)


def _full(value: str, x: str = "dp", n: int = N) -> str:
    return f"CASE WHEN count({x}) OVER w = {n} THEN {value} END"


def betas(x: str, y: str) -> dict[str, str]:
    """Over the window's rows that have both: the slope through zero, its variance, and their ratio."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    total = lambda v: f"(sum(CASE WHEN {both} THEN {v} END) OVER w)"
    beta = f"({total(f'{x} * {y}')} / nullif({total(f'{x} * {x}')}, 0))"
    variance = f"(({total(f'{y} * {y}')} - {beta} * {total(f'{x} * {y}')}) / nullif({total(f'{x} * {x}')} * {N - 1}, 0))"
    return {"beta": beta, "variance": variance, "t": f"({beta} / nullif({variance}, 0))"}


def oracle_sql() -> dict[str, str]:
    weights = features.fracdiff_weights(0.5, 10)
    lam = lambda x, y: _full(f"sum({x} * {y}) OVER w / nullif(sum({x} * {x}) OVER w, 0)")
    b, den, k2 = "(avg(hl2) OVER w)", "(3 - 2 * sqrt(2))", "sqrt(8 / pi())"
    alpha = f"greatest((sqrt(2) - 1) * sqrt({b}) / {den} - sqrt(g / {den}), 0)"
    ready = lambda v: _full(v, "up")
    zeroed = lambda v: f"CASE WHEN abs({v}) < 1e-6 THEN 0.0 ELSE {v} END"
    moment = lambda k: f"list_avg(list_transform(list(\"close\") OVER w, lambda v: (v - avg(\"close\") OVER w) ** {k}))"
    residual = '"close" - ((regr_slope("close", open) OVER w) * open + (regr_intercept("close", open) OVER w))'
    flow = lambda c: f"(sum(CASE WHEN {c} THEN tp * volume ELSE 0 END) OVER w)"
    out = {
        "feat_moments": _sql({
            "mean": 'avg("close") OVER w', "std": 'stddev_samp("close") OVER w',
            "skewness": zeroed(f"{moment(3)} / nullif(pow({moment(2)}, 1.5), 0)"), "kurt": zeroed(f"{moment(4)} / nullif(pow({moment(2)}, 2), 0) - 3"),
        }),
        "feat_regression": _sql({"slope": _full('regr_slope("close", open) OVER w', "open"), "intercept": _full('regr_intercept("close", open) OVER w', "open"), "residual": f"round({_full(residual, 'open')}, 2) + 0.0"}),
        "feat_betas": _sql({k: _full(v, "open") for k, v in betas("open", '"close"').items()}),
        "feat_fracdiff": _sql({"fracdiff": _full(" + ".join(f'{w!r}::DOUBLE * lag("close", {k}) OVER o' for k, w in enumerate(weights)), '"close"', 10)}, 10),
        "feat_tick_direction": _sql({"tick_direction": "dir"}),
        "feat_roll_spread": _sql({"roll_spread": _full("2 * sqrt(greatest(-(covar_samp(dp, dp1) OVER w), 0))", "dp1"), "roll_variance": _full('var_samp("close") OVER w + 2 * (covar_samp(dp, dp1) OVER w)', "dp1")}),
        "feat_high_low_volatility": _sql({"high_low_volatility": _full("sqrt(avg((ln(high) - ln(low)) ** 2) OVER w / (4 * ln(2)))", "high")}),
        "feat_corwin_schultz": _sql({
            "beta": _full(b, "hl2"), "gamma": "g", "alpha": _full(alpha, "hl2"), "cs_spread": _full(f"2 * (exp({alpha}) - 1) / (1 + exp({alpha}))", "hl2"),
            "cs_volatility": _full(f"greatest((sqrt(0.5) - 1) * sqrt({b}) / ({k2} * {den}) + sqrt(g / ({k2} * {k2} * {den})), 0)", "hl2"),
        }),
        "feat_bar_lambdas": _sql({"kyle_bar": _full("avg(dp / nullif(sv, 0)) OVER w"), "amihud_bar": _full("avg(r / nullif(dollar, 0)) OVER w"), "hasbrouck_bar": _full("avg(r / nullif(sd, 0)) OVER w")}),
        "feat_trade_lambdas": _sql({"kyle_lambda": lam("sv", "dp"), "amihud_lambda": _full("sum(CASE WHEN r IS NOT NULL THEN dollar * r END) OVER w / nullif(sum(CASE WHEN r IS NOT NULL THEN dollar * dollar END) OVER w, 0)"), "hasbrouck_lambda": lam("sd", "r"), **{f"{k}_t": _full(betas(x, y)["t"]) for k, x, y in (("kyle", "sv", "dp"), ("amihud", "dollar", "r"), ("hasbrouck", "sd", "r"))}}),
        "feat_indicators": _sql({
            "stochastic_k": ready('100 * ("close" - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0)'), "bias": ready('"close" / avg("close") OVER w - 1'), "roc": ready(f'"close" / lag("close", {N}) OVER o - 1'),
            "cmf": ready("sum(mf) OVER w / nullif(sum(volume) OVER w, 0)"), "mfi": ready(f"100 * {flow('tp > tp1')} / nullif({flow('tp > tp1')} + {flow('tp < tp1')}, 0)"), "bop": '("close" - open) / nullif(high - low, 0)',
            "vortex_plus": ready("sum(up) OVER w / nullif(sum(tr) OVER w, 0)"), "vortex_minus": ready("sum(down) OVER w / nullif(sum(tr) OVER w, 0)"), "atr": ready("avg(tr) OVER w"),
            "rsi": _full("100 * sum(greatest(dp, 0)) OVER w / nullif(sum(abs(dp)) OVER w, 0)"), "band_middle": _full('avg("close") OVER w', '"close"'), "band_upper": _full('avg("close") OVER w + 2 * stddev_pop("close") OVER w', '"close"'), "band_lower": _full('avg("close") OVER w - 2 * stddev_pop("close") OVER w', '"close"'),
            "zscore": zeroed(_full('("close" - avg("close") OVER w) / nullif(stddev_samp("close") OVER w, 0)', '"close"')),
        }),
        "feat_ema": sql.rounded(
            f"WITH {sql.PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS i FROM panel) SELECT symbol, datetime, "
            f'(SELECT sum(b."close" * pow(2 / 3.0::DOUBLE, a.i - b.i)) / sum(pow(2 / 3.0::DOUBLE, a.i - b.i)) FROM n b WHERE b.symbol = a.symbol AND b.i <= a.i) AS ema FROM n a', "ema",
        ),
    }
    panel, o = f"WITH {sql.PANEL}", "(PARTITION BY symbol ORDER BY datetime)"
    out["feat_codes"] = f"""{panel} SELECT symbol, datetime, (greatest(floor(("close" / open) / 0.5), 0)::BIGINT % 62)::INT AS code FROM panel"""
    out["feat_shannon_entropy"] = sql.rounded(
        f"""{panel}, k AS (SELECT *, (greatest(floor(("close" / open) / 0.5), 0)::BIGINT % 62)::INT AS code FROM panel),
m AS (SELECT symbol, datetime, CASE WHEN count(code) OVER w = 8 THEN list(code) OVER w END AS msg FROM k WINDOW {sql.window(8)})
SELECT symbol, datetime, -list_sum(list_transform(list_distinct(msg), lambda c: len(list_filter(msg, lambda v: v = c)) / 8.0 * log2(len(list_filter(msg, lambda v: v = c)) / 8.0))) AS entropy FROM m""", "entropy",
    )
    out["feat_peaks"] = sql.rounded(
        f"""{panel}, k AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS top, min(low) OVER w AS bottom, lead(datetime, 2) OVER {o} AS known_at FROM panel
  WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT symbol, datetime, known_at, indicator, price, count(*) OVER v AS n_last, first_value(price) OVER v AS oldest
FROM (SELECT *, CASE WHEN high = top THEN 1 ELSE -1 END AS indicator, CASE WHEN high = top THEN high ELSE low END AS price FROM k WHERE n = 5 AND (high = top OR low = bottom)) WINDOW {sql.window(5, 'v')}""", "price", "oldest",
    )
    out["feat_fair_value_gaps"] = f"""{panel}, k AS (SELECT *, lag(high, 2) OVER o AS h2, lag(low, 2) OVER o AS l2, lag("close") OVER o AS c1 FROM panel WINDOW o AS {o})
SELECT symbol, datetime, CASE WHEN low > h2 AND c1 > h2 THEN 1 WHEN high < l2 AND c1 < l2 THEN -1 ELSE 0 END AS gap FROM k"""
    return out
