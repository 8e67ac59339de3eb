"""The factor operators: name, arity, kind, and how each becomes a column.

Kinds: ``scalar`` (row by row), ``rolling`` (over a symbol's rows in time), ``cross`` (over a time's
symbols), ``recursive`` (a symbol's whole past, one function call for each symbol).
Full-window operators are NULL until N rows, and where one of N is NULL; partial-window operators
(Prod, IdxMax, IdxMin, Mad, Rank, Slope, Rsquare, Resi) start with the first row.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions import safe


@dataclass(frozen=True)
class Panel:
    """Names of a panel's key columns, and windows over it."""

    symbol: str = "symbol"
    time: str = "datetime"

    def past(self) -> WindowSpec:
        return Window.partitionBy(self.symbol).orderBy(self.time)

    def last(self, n: int) -> WindowSpec:
        return self.past().rowsBetween(-(n - 1), 0)

    def across(self, *more: Column) -> WindowSpec:
        return Window.partitionBy(self.time, *more)


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    columns: int  # arguments that are expressions
    numbers: int  # arguments after them that are constants
    build: Callable[..., Column]  # (panel, columns..., numbers...) -> Column

    @property
    def n_args(self) -> int:
        return self.columns + self.numbers


OPERATORS: dict[str, Operator] = {}


def register(name: str, kind: str, columns: int, numbers: int, build: Callable[..., Column]) -> None:
    """Adds an operator; warns if one of the name is replaced."""
    if kind not in ("scalar", "rolling", "cross", "recursive"):
        raise ValueError(f"no kind {kind!r}")
    if name in OPERATORS:
        warnings.warn(f"operator {name} is replaced", stacklevel=2)
    OPERATORS[name] = Operator(name, kind, columns, numbers, build)


def _flag(x: Column) -> Column:
    return x.cast("boolean")


def _rows(x: Column, w: WindowSpec) -> Column:
    """The window's values in order, NULLs kept in place."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))).over(w), lambda s: s["v"])


def _values(x: Column, w: WindowSpec) -> Column:
    return F.collect_list(x).over(w)


def _index(p: Panel) -> Column:
    return F.row_number().over(p.past())


def _wma(p: Panel, x: Column, n: int) -> Column:
    w = p.last(n)
    total = F.aggregate(_rows(x, w), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, v: F.struct((a["s"] + v * (a["k"] + 1)).alias("s"), (a["k"] + 1).alias("k")), lambda a: a["s"])
    return safe.full(n, x, total / F.lit(n * (n + 1) / 2), w)


def _extreme(best: Callable[[Column], Column]) -> Callable[..., Column]:
    def build(p: Panel, x: Column, n: int) -> Column:
        return F.nullif(F.transform(F.array(_rows(x, p.last(n))), lambda a: F.array_position(a, best(a)))[0], F.lit(0)).cast("double")

    return build


def _quantile(p: Panel, x: Column, n: int, q: float) -> Column:
    return safe.full(n, x, F.sort_array(_values(x, p.last(n)))[int(q * (n - 1) + 0.5)], p.last(n))


def _mad(p: Panel, x: Column, n: int) -> Column:
    w = p.last(n)
    mean = F.avg(x).over(w)
    total = F.aggregate(_values(F.struct(x.alias("v")), w), F.lit(0.0), lambda a, s: a + F.coalesce(F.abs(s["v"] - mean), F.lit(0.0)))
    return safe.ratio(total, F.count(x).over(w))


def _rank(p: Panel, x: Column, n: int) -> Column:
    a = _values(x, p.last(n))
    below = lambda v, y: F.size(F.filter(v, lambda e: e < y)) + (F.size(F.filter(v, lambda e: e == y)) + 1) / 2
    return F.when(x.isNotNull(), F.transform(F.array(a), lambda v: below(v, x) / F.size(v))[0])


def _slope(p: Panel, x: Column, n: int) -> Column:
    return F.regr_slope(x.cast("double"), _index(p)).over(p.last(n))


def _resi(p: Panel, x: Column, n: int) -> Column:
    w, i = p.last(n), _index(p)
    return x - (_slope(p, x, n) * i + F.regr_intercept(x.cast("double"), i).over(w))


def _corr(p: Panel, x: Column, y: Column, n: int) -> Column:
    a, b = safe.pairs(x, y)
    return safe.full(n, F.when(a.isNotNull() & b.isNotNull(), 1), safe.corr(a, b, p.last(n)), p.last(n))


def _cov(p: Panel, x: Column, y: Column, n: int) -> Column:
    a, b = safe.pairs(x, y)
    return safe.full(n, F.when(a.isNotNull() & b.isNotNull(), 1), F.covar_samp(a, b).over(p.last(n)), p.last(n))


def _csrank(p: Panel, x: Column) -> Column:
    rank = F.rank().over(p.across().orderBy(x.asc_nulls_last())) + (F.count(F.lit(1)).over(p.across(x)) - 1) / 2
    return F.when(x.isNotNull(), rank / F.count(x).over(p.across()))


def _lagged(p: Panel, x: Column, n: int) -> Column:
    return F.lag(x, n).over(p.past()) if n >= 0 else F.lead(x, -n).over(p.past())


def _scalars() -> dict[str, tuple[int, Callable[..., Column]]]:
    compare = {
        "Gt": lambda x, y: x > y, "Ge": lambda x, y: x >= y, "Lt": lambda x, y: x < y, "Le": lambda x, y: x <= y, "Eq": lambda x, y: x == y, "Ne": lambda x, y: x != y,
        "And": lambda x, y: _flag(x) & _flag(y), "Or": lambda x, y: _flag(x) | _flag(y), "Greater": F.greatest, "Less": F.least,
        "Add": lambda x, y: x + y, "Sub": lambda x, y: x - y, "Mul": lambda x, y: x * y, "Div": safe.ratio, "Power": lambda x, y: safe.finite(F.pow(x, y)),
    }
    return {k: (2, f) for k, f in compare.items()} | {
        "Neg": (1, lambda x: -x), "Abs": (1, F.abs), "Sign": (1, F.signum), "Log": (1, lambda x: F.when(x > 0, F.ln(x))),
        "If": (3, lambda c, a, b: F.when(_flag(c), a).otherwise(b)),
    }


def _whole(f: Callable[[Column], Column]) -> Callable[..., Column]:
    return lambda p, x, n: safe.full(n, x, f(x).over(p.last(n)), p.last(n))


for _name, (_n, _f) in _scalars().items():
    register(_name, "scalar", _n, 0, lambda p, *a, f=_f: f(*a))
for _name, _f in {
    "Mean": F.avg, "Sum": F.sum, "Std": F.stddev_samp, "Var": F.var_samp, "Skew": F.skewness, "Kurt": F.kurtosis, "Max": F.max, "Min": F.min, "Median": lambda x: F.percentile(x, 0.5),
}.items():
    register(_name, "rolling", 1, 1, _whole(_f))
register("Ref", "rolling", 1, 1, _lagged)
register("Delta", "rolling", 1, 1, lambda p, x, n: x - _lagged(p, x, n))
register("WMA", "rolling", 1, 1, _wma)
register("Prod", "rolling", 1, 1, lambda p, x, n: F.product(x).over(p.last(n)))
register("IdxMax", "rolling", 1, 1, _extreme(F.array_max))
register("IdxMin", "rolling", 1, 1, _extreme(F.array_min))
register("FullIdxMax", "rolling", 1, 1, lambda p, x, n: safe.full(n, x, _extreme(F.array_max)(p, x, n) - 1, p.last(n)))
register("FullIdxMin", "rolling", 1, 1, lambda p, x, n: safe.full(n, x, _extreme(F.array_min)(p, x, n) - 1, p.last(n)))
register("Quantile", "rolling", 1, 2, _quantile)
register("Mad", "rolling", 1, 1, _mad)
register("Rank", "rolling", 1, 1, _rank)
register("Count", "rolling", 1, 1, lambda p, x, n: F.when(F.count(F.lit(1)).over(p.last(n)) == n, F.count(x).over(p.last(n))).cast("double"))
register("Slope", "rolling", 1, 1, _slope)
register("Rsquare", "rolling", 1, 1, lambda p, x, n: F.pow(safe.corr(x, _index(p), p.last(n)), F.lit(2.0)))
register("Resi", "rolling", 1, 1, _resi)
register("Corr", "rolling", 2, 1, _corr)
register("Cov", "rolling", 2, 1, _cov)
register("EMA", "recursive", 1, 1, lambda series, n: series.ewm(span=n, adjust=True).mean())
register("CSRank", "cross", 1, 0, _csrank)
register("CSScale", "cross", 1, 0, lambda p, x: F.try_divide(x, F.sum(F.abs(x)).over(p.across())))
