"""Rolling features of bars (symbol, datetime, open, high, low, close, volume).

A feature is NULL until its window is full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import safe
from tapeloom.operators.bars import tick_direction
from tapeloom.plans.registry import Panel

_P = Panel()
SYMBOLS = 62


def _full(n: int, x: Column, value: Column, w: WindowSpec) -> Column:
    return safe.full(n, x, value, w)


def moments(x: Column, n: int) -> dict[str, Column]:
    """Mean, sample deviation, skewness and excess kurtosis; expanding before the window is full."""
    w = _P.last(n)
    return {"mean": F.avg(x).over(w), "std": F.stddev_samp(x).over(w), "skewness": F.skewness(x).over(w), "kurt": F.kurtosis(x).over(w)}


def regression(y: Column, x: Column, n: int) -> dict[str, Column]:
    """Slope, intercept and the last residual of y on x."""
    w = _P.last(n)
    a, b = safe.pairs(x, y)
    slope, intercept = (_full(n, a, f(b, a).over(w), w) for f in (F.regr_slope, F.regr_intercept))
    return {"slope": slope, "intercept": intercept, "residual": y - (slope * x + intercept)}


def betas(x: Column, y: Column, n: int) -> dict[str, Column]:
    """Regression without intercept: beta, its variance, and beta over variance."""
    w = _P.last(n)
    a, b = safe.pairs(x, y)
    xx, xy, yy = (F.sum(v).over(w) for v in (a * a, a * b, b * b))
    beta = safe.ratio(xy, xx)
    variance = safe.ratio(yy - beta * xy, xx * (n - 1))
    return {"beta": _full(n, a, beta, w), "variance": _full(n, a, variance, w), "t": _full(n, a, safe.ratio(beta, variance), w)}


def fracdiff_weights(order: float, n: int, threshold: float = 1e-5) -> list[float]:
    """Weights from the newest value back."""
    out = [1.0]
    for k in range(1, n):
        w = -out[-1] * (order - k + 1) / k
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def fracdiff(x: Column, order: float, n: int, threshold: float = 1e-5) -> Column:
    """Fractional difference: the newest value always has weight 1."""
    weights = fracdiff_weights(order, n, threshold)
    total = sum((F.lag(x, k).over(_P.past()) * w for k, w in enumerate(weights[1:], 1)), x * weights[0])
    return _full(n, x, total, _P.last(n))


def codes(x: Column, quantiles: int, low: float, high: float) -> Column:
    """Symbol of a value: its quantile's number, modulo the alphabet; below the range 0."""
    return F.pmod(F.greatest(F.floor((x - low) / ((high - low) / quantiles)), F.lit(0)), F.lit(SYMBOLS)).cast("int")


def message(code: Column, n: int) -> Column:
    """The last n symbols as an array."""
    return _full(n, code, F.collect_list(code).over(_P.last(n)), _P.last(n))


def _entropy(words: Column) -> Column:
    n = F.size(words)
    p = F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda v: v == w)) / n)
    return -F.aggregate(p, F.lit(0.0), lambda s, q: s + q * F.log2(q))


def shannon_entropy(msg: Column) -> Column:
    return _entropy(msg)


def plugin_entropy(msg: Column, window: int) -> Column:
    """Entropy of words of ``window`` symbols, for each symbol."""
    return _entropy(F.transform(F.sequence(F.lit(1), F.size(msg) - window + 1), lambda i: F.slice(msg, i, window))) / window


def konto_entropy(window: int):
    """Arrow function: entropy by the lengths of matches with what came before (0: all that came)."""

    def match(m: list, i: int, n: int) -> int:
        best = 0
        for length in range(1, n + 1):
            part = m[i : i + length]
            if any(m[j : j + length] == part for j in range(i - n, i)):
                best = len(part)
        return best + 1

    @F.pandas_udf(T.DoubleType())
    def run(messages):
        def one(m):
            if m is None:
                return None
            m = list(m)
            spans = [(i, i) for i in range(1, len(m) // 2 + 1)] if window == 0 else [(i, window) for i in range(window, len(m) - window + 1)]
            return sum(math.log2(n + 1) / match(m, i, n) for i, n in spans) / len(spans) if spans else None

        return messages.map(one, na_action=None)

    return run


def microstructure(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, datetime, spreads, volatilities, price impacts, vpin) for a window of n bars."""
    past, w = _P.past(), _P.last(n)
    lag = lambda c: F.lag(c).over(past)
    range2 = F.pow(F.ln(F.col("high") / F.col("low")), F.lit(2.0))
    at = bars.withColumns({"dp": F.col("close") - lag(F.col("close")), "r": F.ln(F.col("close") / lag(F.col("close"))), "dir": tick_direction(F.col("close"), past), "dollar": F.col("close") * F.col("volume"), "hl2": range2 + lag(range2)})
    at = at.withColumn("dp1", lag(F.col("dp"))).withColumn("gamma", F.pow(F.ln(F.greatest(F.col("high"), lag(F.col("high"))) / F.least(F.col("low"), lag(F.col("low")))), F.lit(2.0)))
    sigma = F.stddev_samp("dp").over(_P.last(n + 1))
    buy = F.col("volume") * safe.normal_cdf(safe.ratio(F.col("dp"), sigma))
    at = at.withColumn("imbalance", F.when(F.count("dp").over(w) == n, F.abs(2 * buy - F.col("volume"))))
    den, k2 = 3 - 2 * math.sqrt(2), math.sqrt(8 / math.pi)
    at = at.withColumn("b", _full(n, F.col("hl2"), F.avg("hl2").over(w), w))
    alpha = F.greatest((math.sqrt(2) - 1) * F.sqrt("b") / den - F.sqrt(F.col("gamma") / den), F.lit(0.0))
    cov = F.covar_samp("dp", "dp1").over(w)
    ready = lambda x, v: _full(n, F.col(x), v, w)
    signed, root = F.col("volume") * F.col("dir"), F.sqrt("dollar") * F.col("dir")
    mean = lambda y, x: ready("dp", F.avg(safe.ratio(F.col(y), x)).over(w))
    out = {
        "tick_direction": F.col("dir"), "roll_spread": ready("dp1", 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))), "roll_variance": ready("dp1", F.var_samp(F.col("close")).over(w) + 2 * cov),
        "high_low_volatility": _full(n, F.col("high"), F.sqrt(F.avg(F.pow(F.ln(F.col("high")) - F.ln(F.col("low")), F.lit(2.0))).over(w) / (4 * math.log(2))), w),
        "beta": F.col("b"), "gamma": F.col("gamma"), "alpha": F.when(F.col("b").isNotNull(), alpha), "cs_spread": F.when(F.col("b").isNotNull(), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))),
        "cs_volatility": F.when(F.col("b").isNotNull(), F.greatest((math.sqrt(0.5) - 1) * F.sqrt("b") / (k2 * den) + F.sqrt(F.col("gamma") / (k2**2 * den)), F.lit(0.0))),
        "kyle_bar": mean("dp", signed), "amihud_bar": mean("r", F.col("dollar")), "hasbrouck_bar": mean("r", root),
        "vpin": ready("imbalance", safe.ratio(F.avg("imbalance").over(w), F.col("volume"))),
    }
    for name, (x, y) in {"kyle": (signed, "dp"), "amihud": (F.col("dollar"), "r"), "hasbrouck": (root, "r")}.items():
        found = betas(x, F.col(y), n)
        out |= {f"{name}_lambda": found["beta"], f"{name}_t": found["t"]}
    return at.select("symbol", "datetime", *(c.alias(k) for k, c in out.items()))


def peaks(bars: DataFrame, order: int, keep: int = 5) -> DataFrame:
    """Bars whose high (low) is the extreme of ``order`` bars on either side, known ``order`` bars later.

    Columns: symbol, datetime (of the peak), known_at, price, indicator (1 high, -1 low) and the
    last ``keep`` peaks' prices.
    """
    around = _P.past().rowsBetween(-order, order)
    known = F.lead("datetime", order).over(_P.past())
    whole = F.count(F.lit(1)).over(around) == 2 * order + 1
    top, bottom = whole & (F.max("high").over(around) == F.col("high")), whole & (F.min("low").over(around) == F.col("low"))
    made = bars.withColumns({"known_at": known, "indicator": F.when(top, 1).when(bottom, -1)}).where("indicator IS NOT NULL")
    made = made.select("symbol", "datetime", "known_at", "indicator", F.when(F.col("indicator") == 1, F.col("high")).otherwise(F.col("low")).alias("price"))
    return made.withColumn("last_peaks", F.collect_list("price").over(_P.last(keep)))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """1 where the low gaps above the high of two bars ago and the bar between closed above it; -1 the other way."""
    two = lambda c, k: F.lag(c, k).over(_P.past())
    up = (F.col("low") > two("high", 2)) & (two("close", 1) > two("high", 2))
    down = (F.col("high") < two("low", 2)) & (two("close", 1) < two("low", 2))
    return bars.select("symbol", "datetime", F.when(up, 1).when(down, -1).otherwise(0).alias("gap"))


def zscore(x: Column, n: int) -> Column:
    w = _P.last(n)
    return _full(n, x, safe.ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), w)


def rsi(n: int) -> Column:
    """Relative strength index with plain averages."""
    w, move = _P.last(n), F.col("close") - F.lag(F.col("close")).over(_P.past())
    gain, loss = F.sum(F.greatest(move, F.lit(0.0))).over(w), F.sum(F.greatest(-move, F.lit(0.0))).over(w)
    return F.when(F.count(move).over(w) == n, 100 * safe.ratio(gain, gain + loss))


def bollinger(n: int, k: float) -> dict[str, Column]:
    mean, std = F.avg(F.col("close")).over(_P.last(n)), F.stddev_pop(F.col("close")).over(_P.last(n))
    return {"middle": _full(n, F.col("close"), mean, _P.last(n)), "upper": _full(n, F.col("close"), mean + k * std, _P.last(n)), "lower": _full(n, F.col("close"), mean - k * std, _P.last(n))}


def true_range() -> Column:
    prior = F.lag(F.col("close")).over(_P.past())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def indicators(bars: DataFrame, n: int) -> DataFrame:
    """Textbook indicators with plain windows: stochastics, bias, momentum, money flow, vortex, ATR, bands, RSI, z-score."""
    w, past = _P.last(n), _P.past()
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    lag = lambda c, k=1: F.lag(c, k).over(past)
    top, bottom = F.max(F.col("high")).over(w), F.min(F.col("low")).over(w)
    bars = bars.withColumns({"tp": typical, "tr": true_range(), "up": F.abs(F.col("high") - lag(F.col("low"))), "down": F.abs(F.col("low") - lag(F.col("high"))), "mf": safe.ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")) * F.col("volume")})
    plus, minus = (F.sum(F.when(c, F.col("tp") * F.col("volume")).otherwise(0.0)).over(w) for c in (F.col("tp") > lag("tp"), F.col("tp") < lag("tp")))
    ready = lambda v: _full(n, F.col("up"), v, w)
    bands = bollinger(n, 2.0)
    out = {
        "stochastic_k": ready(100 * safe.ratio(F.col("close") - bottom, top - bottom)), "bias": ready(safe.ratio(F.col("close"), F.avg(F.col("close")).over(w)) - 1), "roc": ready(safe.ratio(F.col("close"), lag(F.col("close"), n)) - 1),
        "cmf": ready(safe.ratio(F.sum("mf").over(w), F.sum(F.col("volume")).over(w))), "mfi": ready(100 * safe.ratio(plus, plus + minus)), "bop": safe.ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low")),
        "vortex_plus": ready(safe.ratio(F.sum("up").over(w), F.sum("tr").over(w))), "vortex_minus": ready(safe.ratio(F.sum("down").over(w), F.sum("tr").over(w))),
        "atr": ready(F.avg("tr").over(w)), "rsi": rsi(n), "zscore": zscore(F.col("close"), n), **{f"band_{k}": v for k, v in bands.items()},
    }
    return bars.select("symbol", "datetime", *(v.alias(k) for k, v in out.items()))
