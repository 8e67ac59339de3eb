"""Factors against later returns: preprocessing, information coefficients, groups, turnover, screening.

Frames have symbol, datetime, a factor and a label column.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import safe


def _day() -> WindowSpec:
    return Window.partitionBy("datetime")


def _partition(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by)


def extremes(df: DataFrame, method: str, columns: Sequence[str], n: float = 3.0, low: float = 0.01, high: float = 0.99, by: Sequence[str] = ("datetime",)) -> DataFrame:
    """Adds c_low, c_high, c_clip: bounds by mean and deviation, median and MAD, or quantiles."""
    w, out = _partition(by), df
    for c in columns:
        x = F.col(c)
        if method == "three_sigma":
            middle, spread = F.avg(x).over(w), F.stddev_samp(x).over(w)
            bounds = (middle - n * spread, middle + n * spread)
        elif method == "mad":
            out = out.withColumn("_m", F.percentile(x, 0.5).over(w))
            spread = F.percentile(F.abs(x - F.col("_m")), 0.5).over(w)
            bounds = (F.col("_m") - n * spread, F.col("_m") + n * spread)
        elif method == "quantile":
            bounds = (F.percentile(x, low).over(w), F.percentile(x, high).over(w))
        else:
            raise ValueError(f"no method {method!r}")
        out = out.withColumns({f"{c}_low": bounds[0], f"{c}_high": bounds[1]})
        out = out.withColumn(f"{c}_clip", safe.clip(x, F.col(f"{c}_low"), F.col(f"{c}_high"))).drop("_m")
    return out


def scale(df: DataFrame, method: str, columns: Sequence[str], by: Sequence[str] = ("datetime",)) -> DataFrame:
    """Adds c_zscore, c_robust or c_minmax."""
    w, out = _partition(by), df
    for c in columns:
        x = F.col(c)
        if method == "zscore":
            made = safe.ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
        elif method == "robust":
            out = out.withColumn("_m", F.percentile(x, 0.5).over(w))
            made = safe.ratio(x - F.col("_m"), F.percentile(F.abs(x - F.col("_m")), 0.5).over(w))
        elif method == "minmax":
            made = safe.ratio(x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))
        else:
            raise ValueError(f"no method {method!r}")
        out = out.withColumn(f"{c}_{method}", made).drop("_m")
    return out


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + k * d) or tiny), (1 + k / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n pairs (Student's t)."""

    @F.pandas_udf(T.DoubleType())
    def run(r, n):
        def one(v, k):
            if v is None or math.isnan(v) or k < 3:
                return None
            return _beta_tail(max(0.0, 1 - v * v), (k - 2) / 2, 0.5)

        return r.combine(n, one).astype("float64")

    return run(r.cast("double"), n.cast("long"))


def information_coefficients(df: DataFrame, factor: str, label: str, method: str = "pearson", by: Sequence[str] = ("datetime",)) -> DataFrame:
    """(by, ic, n): correlation of factor and label in each group of rows that have both; spearman uses average ranks."""
    both = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    x, y = F.col(factor), F.col(label)
    if method == "spearman":
        both = both.withColumns({"_x": safe.average_rank(x, by, Window), "_y": safe.average_rank(y, by, Window)})
        x, y = F.col("_x"), F.col("_y")
    elif method != "pearson":
        raise ValueError(f"no method {method!r}")
    return both.groupBy(*by).agg(safe.corr(x, y).alias("ic"), F.count("*").alias("n"))


def ic_summary(ic: DataFrame, threshold: float = 0.02, p_threshold: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, ratio, shares above zero and above the threshold, skewness, kurtosis, share significant and of sign changes."""
    w = Window.partitionBy(*by).orderBy("datetime")
    at = ic.where("ic IS NOT NULL").withColumns({"flip": F.abs(F.signum("ic") - F.signum(F.lag("ic").over(w))), "p": p_value(F.col("ic"), F.col("n"))})
    n = F.count("ic")
    return at.groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), safe.ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"), safe.ratio(F.count_if(F.col("ic") > 0), n).alias("ic_positive_ratio"),
        safe.ratio(F.count_if(F.abs("ic") > threshold), n).alias("ic_abs_ratio"), F.skewness("ic").alias("ic_skew"), F.kurtosis("ic").alias("ic_kurt"),
        safe.ratio(100 * F.count_if(F.col("p") < p_threshold), n).alias("significant_pct"), safe.ratio(100 * F.sum("flip"), n).alias("sign_change_pct"),
    )


def multi_period_ic(df: DataFrame, factor: str, first: int, decay: int, method: str = "pearson") -> DataFrame:
    """(period, ic_mean, ic_std): coefficients of label_first .. label_(decay - 1) in one pass."""
    names = [f"label_{i}" for i in range(first, decay)]
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    long = df.select("symbol", "datetime", factor, F.explode(F.array(*(F.struct(F.lit(i).alias("period"), F.col(f"label_{i}").alias("label")) for i in range(first, decay)))).alias("x"))
    ic = information_coefficients(long.select("datetime", factor, "x.period", "x.label"), factor, "label", method, ("period", "datetime"))
    return ic.groupBy("period").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))


def half_life(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """(half-life, a) of the least-squares fit y = c exp(a x): -ln 2 / a, infinite if it doesn't decay."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    sign = -1.0 if y.sum() < 0 else 1.0
    a, b = np.polyfit(x, np.log(np.maximum(sign * y, 1e-12)), 1)
    c = sign * math.exp(b)
    for _ in range(100):
        f = np.exp(a * x)
        jac = np.stack([f, c * x * f], axis=1)
        step, *_ = np.linalg.lstsq(jac, y - c * f, rcond=None)
        c, a = c + step[0], a + step[1]
        if np.abs(step).max() < 1e-12:
            break
    return (-math.log(2) / a if a < 0 else math.inf), float(a)


def ic_decay(df: DataFrame, factor: str, first: int, decay: int, method: str = "pearson") -> DataFrame:
    """(half_life, rate): how fast the mean coefficient falls from period to period, by the fit of ``half_life``; one row."""
    means = sorted((r["period"], r["ic_mean"]) for r in multi_period_ic(df, factor, first, decay, method).collect() if r["ic_mean"] is not None)  # a row for each period
    fitted = half_life([p for p, _ in means], [m for _, m in means]) if len(means) > 1 else (None, None)
    return df.sparkSession.createDataFrame([tuple(None if x is None else float(x) for x in fitted)], "half_life double, rate double")


def group_returns(df: DataFrame, factor: str, label: str, n: int = 5, reverse: bool = False) -> DataFrame:
    """(datetime, group_1 .. group_n, long_short, long_average, cumulated ones): mean labels of n equal groups by factor.

    A day's k-th group holds rows k*m to (k+1)*m of the order, m a n-th of them; the rest is left out.
    """
    both = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    order = F.col(factor).asc() if reverse else F.col(factor).desc()
    ranked = both.withColumns({"_k": F.row_number().over(_day().orderBy(order, "symbol")) - 1, "_m": F.floor(F.count(F.lit(1)).over(_day()) / n)})
    ranked = ranked.where("_m > 0").withColumn("_g", F.floor(F.col("_k") / F.col("_m")) + 1)
    groups = ranked.groupBy("datetime").agg(*(F.avg(F.when(F.col("_g") == g, F.col(label))).alias(f"group_{g}") for g in range(1, n + 1)), F.avg(label).alias("average"))
    made = groups.withColumns({"long_short": (F.col("group_1") - F.col(f"group_{n}")) / 2, "long_average": F.col("group_1") - F.col("average")})
    w = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    return made.withColumns({f"cum_{c}": F.sum(c).over(w) for c in (*(f"group_{g}" for g in range(1, n + 1)), "long_short", "long_average")})


def monthly_heat(ic: DataFrame) -> DataFrame:
    """(year, m1 .. m12): mean coefficient of each month."""
    months = ic.groupBy(F.year("datetime").alias("year")).pivot("month", list(range(1, 13))) if "month" in ic.columns else ic.withColumn("month", F.month("datetime")).groupBy(F.year("datetime").alias("year")).pivot("month", list(range(1, 13)))
    return months.agg(F.avg("ic")).select("year", *(F.col(str(i)).alias(f"m{i}") for i in range(1, 13)))


def autocorrelation(df: DataFrame, factor: str, lag: int = 1) -> DataFrame:
    """(datetime, autocorr): correlation of the factor's percentile ranks with those ``lag`` rows earlier of the symbol."""
    at = df.withColumn("_lag", F.lag(factor, lag).over(Window.partitionBy("symbol").orderBy("datetime")))
    ranks = at.withColumns({"_x": safe.average_rank(F.col(factor), ["datetime"], Window), "_y": safe.average_rank(F.col("_lag"), ["datetime"], Window)})
    share = lambda c: safe.ratio(F.col(c), F.count(c).over(_day()))
    return ranks.withColumns({"_x": share("_x"), "_y": share("_y")}).groupBy("datetime").agg(safe.corr(F.col("_x"), F.col("_y")).alias("autocorr"))


def turnover(df: DataFrame, factor: str, n: int = 5, lag: int = 1) -> DataFrame:
    """(datetime, top, bottom): share of the extreme n-th that was not in it ``lag`` rows earlier."""
    at = df.where(F.col(factor).isNotNull()).withColumn("_lag", F.lag(factor, lag).over(Window.partitionBy("symbol").orderBy("datetime"))).where("_lag IS NOT NULL")
    at = at.withColumn("_m", F.floor(F.count(F.lit(1)).over(_day()) / n))
    place = lambda c: F.row_number().over(_day().orderBy(c, "symbol"))
    at = at.withColumns({"t0": place(F.col(factor).desc()), "t1": place(F.col("_lag").desc()), "b0": place(F.col(factor)), "b1": place(F.col("_lag"))})
    kept = lambda a, b: 1 - safe.ratio(F.count_if((F.col(a) <= F.col("_m")) & (F.col(b) <= F.col("_m"))), F.max("_m"))
    return at.where("_m > 0").groupBy("datetime").agg(kept("t0", "t1").alias("top"), kept("b0", "b1").alias("bottom"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns, all in one aggregation."""
    pairs = list(itertools.combinations(columns, 2))
    row = df.agg(*(safe.corr(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def screen(df: DataFrame, columns: Sequence[str], label: str, threshold: float, share: float = 0.5, method: str = "pearson") -> DataFrame:
    """(feature, ic_in, ic_out): features kept of pairs correlated above the threshold, with the same sign in both parts of time, best first."""
    high = {(r["a"], r["b"]) for r in correlation_matrix(df, columns).where(F.col("corr") > threshold).collect()}
    kept: list[str] = []
    for c in columns:  # a feature goes if an earlier one is too like it
        if not any((e, c) in high for e in columns[: list(columns).index(c)]):
            kept.append(c)
    at = df.withColumn("_k", F.row_number().over(Window.orderBy("datetime", "symbol"))).withColumn("_in", F.col("_k") <= F.floor(F.count(F.lit(1)).over(Window.partitionBy()) * share))
    part = lambda c, inside: safe.corr(F.when(F.col("_in") == inside, F.col(c)), F.when(F.col("_in") == inside, F.col(label)))
    row = at.agg(*(part(c, i).alias(f"{c}_{int(i)}") for c in kept for i in (True, False)))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_1").alias("ic_in"), F.col(f"{c}_0").alias("ic_out")) for c in kept))).alias("x")).select("x.*")
    return long.where(F.col("ic_in") * F.col("ic_out") > 0).orderBy(F.abs("ic_out").desc(), "feature")


def normal_quantile_points(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """(p, sample, normal): quantiles of a column beside those of the normal distribution with its moments."""
    from statistics import NormalDist

    ps = [(i + 0.5) / n for i in range(n)]
    row = df.agg(F.percentile(column, ps).alias("q"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    points = F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("q").alias("sample"), F.array(*(F.lit(NormalDist().inv_cdf(p)) for p in ps)).alias("z"))
    return row.select(F.explode(points).alias("x"), "m", "s").select("x.p", "x.sample", (F.col("m") + F.col("s") * F.col("x.z")).alias("normal"))


def analysis(name: str):
    """The analysis of a factor by its name: a function of (df, factor, label)."""
    known = {
        "ic": information_coefficients, "rank_ic": lambda d, f, y: information_coefficients(d, f, y, "spearman"), "groups": group_returns,
        "monthly_heat": lambda d, f, y: monthly_heat(information_coefficients(d, f, y)), "autocorrelation": lambda d, f, y: autocorrelation(d, f),
        "turnover": lambda d, f, y: turnover(d, f), "quantile_points": lambda d, f, y: normal_quantile_points(d, f),
    }
    if name not in known:
        raise ValueError(f"no analysis {name!r}; there are {', '.join(known)}")
    return known[name]
