"""Signals and checks around models: crossovers, pair residuals, market structure, relabelling, parameter grids."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import safe
from tapeloom.operators import lines
from tapeloom.plans.registry import Panel

_P = Panel()


def crossovers(df: DataFrame, fast: str, slow: str, warm_up: int = 1440) -> DataFrame:
    """(symbol, datetime, cross): 1 where fast passes above slow, -1 below, 0 else and in the first ``warm_up`` rows."""
    own = _P.past()
    x = lines.crossing(F.col(fast), F.col(slow), own)
    return df.select("symbol", "datetime", F.when(F.row_number().over(own) > warm_up, x).otherwise(0).alias("cross"))


def pair_residuals(df: DataFrame, base: DataFrame, period: int) -> DataFrame:
    """(symbol, datetime, change, base_change, residual): how oddly a bar moved for how its base did.

    Changes over ``period`` bars are regressed on the base's, over a symbol's whole history; the
    residual's absolute z-score is kept. ``base`` has (datetime, close).
    """
    own = _P.past()
    both = df.select("symbol", "datetime", "close").join(base.select("datetime", F.col("close").alias("_b")), "datetime", "left")
    change = lambda c: safe.ratio(F.col(c), F.lag(c, period).over(own)) - 1
    both = both.withColumns({"change": change("close"), "base_change": change("_b")}).where("change IS NOT NULL AND base_change IS NOT NULL")
    fit = both.groupBy(F.col("symbol").alias("_s")).agg(
        F.regr_slope("change", "base_change").alias("_k"), F.avg("change").alias("_y"), F.avg("base_change").alias("_x"), F.var_pop("change").alias("_v"), F.covar_pop("change", "base_change").alias("_c"),
    )
    # Residuals have mean zero, and their variance is what the slope leaves over.
    left = F.sqrt(F.greatest(F.col("_v") - F.col("_k") * F.col("_c"), F.lit(0.0)))
    off = (F.col("change") - F.col("_y")) - F.col("_k") * (F.col("base_change") - F.col("_x"))
    return both.join(fit, F.col("symbol") == F.col("_s")).select("symbol", "datetime", "change", "base_change", F.abs(safe.ratio(off, left)).alias("residual"))


def market_structure(bars: DataFrame, order: int) -> DataFrame:
    """(symbol, datetime, swing, break): swing points and breaks of them.

    A swing high (low) is the extreme of ``order`` bars on either side and is known ``order`` bars
    later: HH or LH (LL or HL) against the one before. A close that passes the last known swing
    high (low) for the first time is a break: BOS, or CHoCH if the break before went the other way.
    """
    own = _P.past()
    around = own.rowsBetween(-2 * order, 0)
    whole, middle = F.count(F.lit(1)).over(around) == 2 * order + 1, lambda c: F.lag(c, order).over(own)
    tops = F.when(whole & (F.max("high").over(around) == middle("high")), middle("high"))
    bottoms = F.when(whole & (F.min("low").over(around) == middle("low")), middle("low"))
    at = bars.select("symbol", "datetime", "close", tops.alias("top"), bottoms.alias("bottom"))
    held = lambda c, w: F.last(c, ignorenulls=True).over(w)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({
        "high": held("top", own), "low": held("bottom", own), "last_top": held("top", before), "last_bottom": held("bottom", before),
        "nth_top": F.count("top").over(own), "nth_bottom": F.count("bottom").over(own),
    })
    passed = lambda up: F.coalesce(F.col("close") > F.col("high") if up else F.col("close") < F.col("low"), F.lit(False))
    first = lambda up: passed(up) & (F.sum(passed(up).cast("int")).over(Window.partitionBy("symbol", "nth_top" if up else "nth_bottom").orderBy("datetime")) == 1)
    at = at.withColumns({"up": first(True), "down": first(False)}).withColumn("way", F.when(F.col("up"), 1).when(F.col("down"), -1))
    turned = F.coalesce(held("way", before) != F.col("way"), F.lit(False))
    swing = (
        F.when(F.col("top").isNotNull(), F.when(F.col("top") > F.coalesce("last_top", F.lit(0.0)), "HH").otherwise("LH"))
        .when(F.col("bottom").isNotNull(), F.when(F.col("bottom") < F.coalesce("last_bottom", F.lit(0.0)), "LL").otherwise("HL"))
    )
    broke = F.when(F.col("way").isNotNull(), F.concat(F.when(F.col("way") > 0, "up ").otherwise("down "), F.when(turned, "CHoCH").otherwise("BOS")))
    return at.select("symbol", "datetime", swing.alias("swing"), broke.alias("break"))


def equal_swings(swings: DataFrame, tolerance: Column) -> DataFrame:
    """(symbol, datetime, indicator, price, equal): swing points as near to the last of their kind as ``tolerance``."""
    own = Window.partitionBy("symbol", "indicator").orderBy("datetime")
    near = F.abs(F.col("price") - F.lag("price").over(own)) < tolerance
    return swings.select("symbol", "datetime", "indicator", "price", F.coalesce(near, F.lit(False)).alias("equal"))


def oscillators(bars: DataFrame, n: int) -> DataFrame:
    """Further textbook indicators over plain windows of n bars.

    Ultimate oscillator over n, 2n and 4n bars, AR and BR, forecast oscillator, R squared and slope
    on the bar's number, relative volatility, pretty-good oscillator (plain means), accumulation/distribution.
    """
    own, w = _P.past(), _P.last(n)
    prior = F.lag("close").over(own)
    at = bars.withColumns({"i": F.row_number().over(own), "c1": prior, "sd": F.stddev_pop("close").over(w)})
    low, high = F.least(F.col("low"), F.col("c1")), F.greatest(F.col("high"), F.col("c1"))
    at = at.withColumns({"bp": F.col("close") - low, "tr": high - low, "money": safe.ratio(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")) * F.col("volume")})
    mean = lambda k: safe.ratio(F.sum("bp").over(_P.last(k)), F.sum("tr").over(_P.last(k)))
    part = lambda a, b: 100 * safe.ratio(F.sum(a).over(w), F.sum(b).over(w))
    up = lambda x: F.greatest(x, F.lit(0.0))
    ready = lambda v, k=n: F.when(F.count("c1").over(_P.last(k)) == k, v)
    i = F.col("i").cast("double")
    slope, cut = F.regr_slope("close", i).over(w), F.regr_intercept("close", i).over(w)
    rises, falls = F.when(F.col("close") > F.col("c1"), F.col("sd")).otherwise(0.0), F.when(F.col("close") < F.col("c1"), F.col("sd")).otherwise(0.0)
    out = {
        "uo": ready(100 * (4 * mean(n) + 2 * mean(2 * n) + mean(4 * n)) / 7, 4 * n), "ar": ready(part(F.col("high") - F.col("open"), F.col("open") - F.col("low"))),
        "br": ready(part(up(F.col("high") - F.col("c1")), up(F.col("c1") - F.col("low")))), "cfo": ready(100 * safe.ratio(F.col("close") - (cut + slope * i), F.col("close"))),
        "r2": ready(F.pow(safe.corr(F.col("close"), i, w), F.lit(2.0))), "slope": ready(slope), "rvi": ready(100 * safe.ratio(F.sum(rises).over(w), F.sum(rises + falls).over(w))),
        "pgo": ready(safe.ratio(F.col("close") - F.avg("close").over(w), F.avg("tr").over(w))), "ad": F.sum(F.coalesce("money", F.lit(0.0))).over(own.rowsBetween(Window.unboundedPreceding, 0)),
    }
    return at.select("symbol", "datetime", *(c.alias(k) for k, c in out.items()))


def spreads(quotes: DataFrame, n: int = 600) -> DataFrame:
    """(symbol, ts, relative_spread, variation): variation adds how far the mid is from the first of the last n."""
    own = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
    at = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).where("mid > 0")
    wide = (F.col("ask") - F.col("bid")) / F.col("mid")
    return at.select("symbol", "ts", wide.alias("relative_spread"), (F.abs(F.col("mid") / F.first("mid").over(own) - 1) + wide).alias("variation"))


def range_breaks(times: DataFrame) -> DataFrame:
    """(symbol, extra_us, at): where more than the usual step is missing between a symbol's times.

    ``extra_us`` is the missing length in microseconds, ``at`` when it begins: one usual step after the time before.
    """
    own = Window.partitionBy("symbol").orderBy("datetime")
    us = F.unix_micros(F.col("datetime").cast("timestamp"))
    at = times.select("symbol", "datetime").distinct().withColumn("gap", F.lead(us).over(own) - us)
    least = F.min("gap").over(Window.partitionBy("symbol"))
    at = at.withColumn("least", least).where("gap > least")
    return at.select("symbol", (F.col("gap") - F.col("least")).alias("extra_us"), F.timestamp_micros(us + F.col("least")).alias("at"))


# -- around models ---------------------------------------------------------------------------------


def top_share(rows: DataFrame, score: str, ratio: float, key: str, buckets: int = 4096) -> DataFrame:
    """``rows`` with ``top``: whether a row is among the floor(ratio * n) with the highest scores in [0, 1].

    Ties go by key. Counts of score buckets settle all buckets but one, whose rows alone are ranked.
    """
    rows = rows.withColumn("_b", F.least(F.lit(buckets - 1), F.floor(F.coalesce(score, F.lit(0.0)) * buckets)).cast("int"))
    counts = rows.groupBy("_b").count()  # at most ``buckets`` rows
    down = Window.orderBy(F.col("_b").desc())
    room = F.floor(F.lit(ratio) * F.sum("count").over(Window.partitionBy())) - (F.sum("count").over(down) - F.col("count"))
    rows = rows.join(F.broadcast(counts.select("_b", "count", room.alias("_room"))), "_b")
    sure = rows.where((F.col("_room") >= F.col("count")) | (F.col("_room") <= 0)).withColumn("top", F.col("_room") > 0)
    edge = rows.where((F.col("_room") < F.col("count")) & (F.col("_room") > 0))
    edge = edge.withColumn("top", F.row_number().over(Window.partitionBy("_b").orderBy(F.col(score).desc_nulls_last(), key)) <= F.col("_room"))
    return sure.unionByName(edge).drop("_b", "count", "_room")


def relabelled(rows: DataFrame, ratio: float, key: str, label: str = "label", score: str = "proba") -> DataFrame:
    """``rows`` with ``label`` 1 where the score agrees: labelled 1 and among the top share, or 0 and not among it."""
    agreed = (F.col(label) == 1) & F.col("top") | (F.col(label) != 1) & ~F.col("top")
    return top_share(rows, score, ratio, key).withColumn(label, agreed.cast("int")).drop("top")


def majority(votes: Sequence[Column]) -> Column:
    """1 where over half of the votes exceed 0.5, else 0; a tie is 0."""
    yes = functools.reduce(lambda a, b: a + b, [F.coalesce((v > 0.5).cast("int"), F.lit(0)) for v in votes])
    return (2 * yes > len(votes)).cast("int")


def meta_label(models: Sequence[Column], truth: Column) -> dict[str, Column]:
    """``predict_prob``: the last class's mean probability over the models' arrays; ``label``: 1 if the likeliest class is the true one, the first of equals."""
    mean = functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), models)
    mean = F.transform(mean, lambda x: x / len(models))
    return {"predict_prob": F.element_at(mean, -1), "label": (F.array_position(mean, F.array_max(mean)) - 1 == truth).cast("int")}


def in_out_correlation(df: DataFrame, x: str, y: str, share: float = 0.7, by: Sequence[str] = ("symbol",), order: str = "datetime") -> DataFrame:
    """(by, in_sample, out_sample): correlation in the first floor(share * n) rows of a group and in the rest."""
    own, every = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    early = F.row_number().over(own) <= F.floor(F.lit(share) * F.count(F.lit(1)).over(every))
    at = df.withColumn("_early", early)
    part = lambda first: safe.corr(*(F.when(F.col("_early") == first, F.col(c)) for c in (x, y)))
    return at.groupBy(*by).agg(part(True).alias("in_sample"), part(False).alias("out_sample"))


def parameter_grid(make: Callable[..., DataFrame], grid: Mapping[str, Sequence], x: str, y: str, share: float = 0.7, least_rows: int = 0) -> DataFrame:
    """(grid's names, symbol, n, in_sample, out_sample), best first, for the settings whose two correlations share a sign.

    ``make(**setting)`` returns (symbol, datetime, x, y). x is clipped at five deviations of the
    symbol, which correlations need no scaling after. All settings are parts of one plan.
    """
    every = Window.partitionBy("symbol")
    runs = []
    for values in itertools.product(*grid.values()):
        made = make(**dict(zip(grid, values, strict=True))).select("symbol", "datetime", x, y)
        mean, spread = F.avg(x).over(every), 5 * F.stddev_samp(x).over(every)
        made = made.withColumn(x, F.coalesce(safe.clip(F.col(x), mean - spread, mean + spread), F.col(x)))
        runs.append(made.select(*(F.lit(v).alias(k) for k, v in zip(grid, values, strict=True)), "symbol", "datetime", x, y))
    rows = functools.reduce(DataFrame.unionByName, runs)
    by = [*grid, "symbol"]
    found = in_out_correlation(rows, x, y, share, by).join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    return found.where((F.signum("in_sample") == F.signum("out_sample")) & (F.col("n") >= least_rows)).select(*by, "n", "in_sample", "out_sample").orderBy(F.abs("out_sample").desc(), *by)
