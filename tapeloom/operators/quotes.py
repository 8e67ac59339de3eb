"""Market-making: volatility estimates, order-arrival intensities, half spreads.

Quotes have symbol, i (position, from 0 without gaps) or ts (milliseconds), and a mid price or bid
and ask.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import safe
from tapeloom.operators import grouped

#: Rows of a block, least rows, the divisor of the classical estimate, and the floors of A and k.
BLOCK, LEAST, CLASSICAL, FLOOR = 30, 32, 10.0, 1e-6


def sigmas(mids: DataFrame, mid: str = "mid", ieee: bool = False) -> DataFrame:
    """(symbol, gk, parkinson, classical, tv): estimates from all of a symbol's rows.

    Range estimates use whole blocks that another row follows; too few rows give NULL. ``tv`` is
    the mean of the column itself. Blocks with a price of zero or less are left out; with ``ieee``
    they count, and the logarithms of their ratios are infinite or NaN, as in SQL.
    """
    own = Window.partitionBy("symbol").orderBy("i")
    every = Window.partitionBy("symbol")
    x = F.col(mid)
    at = mids.withColumns({"n": F.count(F.lit(1)).over(every), "d": F.lead(x).over(own) - x, "after": F.lead(x, BLOCK).over(own), "b": F.floor(F.col("i") / BLOCK)})
    blocks = at.groupBy("symbol", "b").agg(
        F.max("n").alias("n"), F.min_by(x, "i").alias("open"), F.min_by("after", "i").alias("after"), F.max(x).alias("hi"), F.min(x).alias("lo"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(x).alias("s"),
    )
    log = lambda x, y: safe.ieee_ln(safe.ieee_ratio(F.col(x), F.col(y)))
    hl2, co2 = F.pow(log("hi", "lo"), F.lit(2.0)), F.pow(log("after", "open"), F.lit(2.0))
    whole = (F.col("n") >= LEAST) & F.col("after").isNotNull() & (F.lit(ieee) | (F.col("lo") > 0))
    gk = F.avg(F.when(whole & (F.lit(ieee) | (F.col("open") > 0) & (F.col("after") > 0)), 0.5 * hl2 - (2 * math.log(2) - 1) * co2))
    made = blocks.groupBy("symbol").agg(
        F.when(gk >= 0, F.sqrt(gk)).alias("gk"), F.sqrt(F.avg(F.when(whole, hl2)) / (4 * math.log(2))).alias("parkinson"),
        F.when(F.max("n") >= 2, F.sqrt(F.sum("dd") / CLASSICAL)).alias("classical"), (F.sum("s") / F.max("n")).alias("tv"),
    )
    return made


def select_sigma(mode: str = "auto", ieee: bool = False) -> Column:
    """The estimate of a mode, or the first that is positive; infinities and NaN count only with ``ieee``."""
    order = ["gk", "parkinson", "classical", "tv"] if mode == "auto" else [mode]
    return F.coalesce(*(F.when(F.col(c) > 0, F.col(c) if ieee else safe.finite(F.col(c))) for c in order))


def arrivals(quotes: DataFrame, spreads: Sequence[float], dt: int, window: int) -> DataFrame:
    """(symbol, side, spread, intensity) at each symbol's last tick.

    Every ``dt`` a virtual order is placed at the mid plus or minus each spread and filled when the
    opposite quote crosses it strictly. Intensity is dt times the filled over the time waited, of
    orders placed within the window.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        ts, bid, ask = (rows[c].to_numpy(float) for c in ("ts", "bid", "ask"))
        slots = np.arange(ts[0], ts[-1] + 1, dt)
        at = np.searchsorted(ts, slots, side="right") - 1  # the mid known when the slot comes
        slots, at = slots[slots >= ts[-1] - window], at[slots >= ts[-1] - window]
        out = []
        for side, quote, sign in (("buy", ask, -1), ("sell", bid, 1)):
            for s in spreads:
                price, waited, filled = (bid[at] + ask[at]) / 2 + sign * s, 0.0, 0
                for k, p, t in zip(at, price, slots, strict=True):
                    crossed = np.flatnonzero(quote[k + 1 :] < p if sign < 0 else quote[k + 1 :] > p)
                    filled += bool(len(crossed))
                    waited += (ts[k + 1 + crossed[0]] if len(crossed) else ts[-1]) - t
                out.append((rows["symbol"].iloc[0], side, float(s), dt * filled / waited if waited > 0 else 0.0))
        return pd.DataFrame(out, columns=["symbol", "side", "spread", "intensity"])

    schema = T.StructType([T.StructField("symbol", quotes.schema["symbol"].dataType), T.StructField("side", T.StringType()), T.StructField("spread", T.DoubleType()), T.StructField("intensity", T.DoubleType())])
    return grouped.by_symbol(quotes.select("symbol", "ts", "bid", "ask"), "symbol", ["ts"], one, schema)


def solve_regression(intensities: DataFrame, by: Sequence[str] = ("symbol", "side")) -> DataFrame:
    """(by, a, k): regression of log intensity on spread; zeros where there is too little."""
    y = F.when(F.col("intensity") > 0, F.ln("intensity"))
    x = F.when(y.isNotNull(), F.abs("spread"))
    made = intensities.groupBy(*by).agg(F.exp(F.regr_intercept(y, x)).alias("a"), (-F.regr_slope(y, x)).alias("k"))
    return made.select(*by, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("k", F.lit(0.0)).alias("k"))


def solve_pairs(intensities: DataFrame, by: Sequence[str] = ("symbol", "side")) -> DataFrame:
    """(by, a, k): the curve through each pair of spreads, averaged. A curve has a handful of spreads, held as an array."""
    point = F.struct(F.abs("spread").alias("s"), F.col("intensity").alias("v"))
    points = F.sort_array(F.collect_list(F.when(F.col("intensity") > 0, point)))
    listed = intensities.groupBy(*by).agg(points.alias("p"))
    left = listed.select(*by, "p", F.posexplode("p").alias("i", "x"))
    pairs = left.select(*by, "x", F.explode(F.slice("p", F.col("i") + 2, F.greatest(F.size("p") - F.col("i") - 1, F.lit(0)))).alias("y"))
    k = safe.ratio(F.ln(F.col("x.v") / F.col("y.v")), F.col("y.s") - F.col("x.s"))
    return pairs.withColumn("k", k).groupBy(*by).agg(F.avg(F.col("x.v") * F.exp(F.col("k") * F.col("x.s"))).alias("a"), F.avg("k").alias("k"))


def intensity(a: Column, k: Column, spread: Column) -> Column:
    return a * F.exp(-k * spread)


def spread_for(a: Column, k: Column, rate: Column) -> Column:
    return safe.ratio(-F.ln(safe.ratio(rate, a)), k)


def half_spreads(gamma: float, sigma: Column, buy_a: Column, buy_k: Column, sell_a: Column, sell_k: Column, inventory: Column) -> dict[str, Column]:
    """half_bid, half_ask and ok, with A and k floored."""
    ba, bk, sa, sk = (F.greatest(c, F.lit(FLOOR)) for c in (buy_a, buy_k, sell_a, sell_k))
    valid = (sigma > 0) & F.lit(gamma > 0)

    def half(a: Column, k: Column, held: Column, sign: int) -> Column:
        base = 1 + gamma / k
        term = sigma * sigma * gamma / (2 * k * a)
        return F.when(valid, safe.finite(F.ln(base) / gamma + sign * (held + sign * 0.5) * F.sqrt(term * F.pow(base, 1 + k / gamma))))

    bid, ask = half(sa, sk, inventory, 1), half(ba, bk, inventory, -1)
    return {"half_bid": bid, "half_ask": ask, "ok": F.coalesce((bid > 0) & (ask > 0), F.lit(False))}


def quoted(mid: Column, half_bid: Column, half_ask: Column, tick: float, most_ticks: int = 1000) -> dict[str, Column]:
    """bid and ask: the mid less or plus half spreads kept within one and ``most_ticks`` ticks."""
    kept = lambda h: safe.clip(h, F.lit(tick), F.lit(tick * most_ticks))
    return {"bid": mid - kept(half_bid), "ask": mid + kept(half_ask)}
