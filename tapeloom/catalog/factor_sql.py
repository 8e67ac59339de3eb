"""Factor trees as SQL, stage by stage, for comparison: each operator in the words of the SQL engine.

Stage k first names the arguments of the window operators on level k as columns, then computes
those operators over them; scalar operators are written in place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom import sql
from tapeloom.plans.compile import operator
from tapeloom.plans.expression import Node

#: What counts as zero.
ZERO = 1e-9
_O = "(PARTITION BY symbol ORDER BY datetime)"
_INFIX = {"Gt": ">", "Ge": ">=", "Lt": "<", "Le": "<=", "Eq": "=", "Ne": "<>", "And": "AND", "Or": "OR", "Add": "+", "Sub": "-", "Mul": "*"}


def tidy(x: Column) -> Column:
    """A number in single precision, as the SQL gives it; what is next to nothing is 0."""
    return F.when(F.abs(x) < ZERO, 0.0).otherwise(sql.single(x))


def scalar(op: str, a: list[str]) -> str:
    if op in _INFIX:
        return f"({a[0]} {_INFIX[op]} {a[1]})"
    return {
        "Div": "({0} / nullif({1}, 0))", "Power": "(CASE WHEN isfinite(pow({0}, {1})) THEN pow({0}, {1}) END)", "Greater": "greatest({0}, {1})", "Less": "least({0}, {1})",
        "Neg": "(-{0})", "Abs": "abs({0})", "Sign": "sign({0})", "Log": "(CASE WHEN {0} > 0 THEN ln({0}) END)", "If": "(CASE WHEN {0} THEN {1} ELSE {2} END)",
    }[op].format(*a)


def window(op: str, a: list[str], numbers: list) -> str:
    """A window operator over columns; ``i`` is the row's number."""
    x, n = a[0], numbers[0] if numbers else 0
    if op == "CSRank":
        day = "PARTITION BY datetime"
        return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({day} ORDER BY {x} NULLS LAST) + (count(*) OVER ({day}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER ({day}) END"
    if op == "CSScale":
        return f"{x} / nullif(sum(abs({x})) OVER (PARTITION BY datetime), 0)"
    if op in ("Ref", "Delta"):
        past = f"lag({x}, {n}) OVER {_O}" if n >= 0 else f"lead({x}, {-n}) OVER {_O}"
        return past if op == "Ref" else f"{x} - {past}"
    w = f"(PARTITION BY symbol ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    over = {"Mean": "avg", "Sum": "sum", "Std": "stddev_samp", "Var": "var_samp", "Max": "max", "Min": "min", "Median": "median"}
    full = lambda v, of=f"count({x})": f"CASE WHEN {of} OVER {w} = {n} THEN {v} END"
    if op in over:
        return full(f"{over[op]}({x}) OVER {w}")
    if op == "WMA":
        return full("(" + " + ".join(f"{n - k} * lag({x}, {k}) OVER {_O}" for k in range(n)) + f") / {n * (n + 1) / 2}")
    if op == "Prod":
        return f"product({x}) OVER {w}"
    some = f"(list({x}) FILTER ({x} IS NOT NULL) OVER {w})"
    if op in ("IdxMax", "IdxMin"):
        rows = f"(list({x}) OVER {w})"
        return f"CASE WHEN count({x}) OVER {w} > 0 THEN list_position({rows}, list_{op[3:].lower()}({rows})) END"
    if op == "Quantile":
        return full(f"list_sort({some})[{int(numbers[1] * (n - 1) + 0.5) + 1}]")
    if op == "Mad":
        return f"list_avg(list_transform({some}, lambda v: abs(v - avg({x}) OVER {w})))"
    if op == "Rank":
        return f"CASE WHEN {x} IS NOT NULL THEN (len(list_filter({some}, lambda e: e < {x})) + (len(list_filter({some}, lambda e: e = {x})) + 1) / 2.0::DOUBLE) / len({some}) END"
    if op == "Count":
        return f"CASE WHEN count(*) OVER {w} = {n} THEN count({x}) OVER {w} END"
    if op in ("Corr", "Cov"):
        pair = f"{a[0]} IS NOT NULL AND {a[1]} IS NOT NULL"
        p, q = (f"(CASE WHEN {pair} THEN {c} END)" for c in a)
        cov = f"(covar_samp({p}, {q}) OVER {w})"
        return full(cov if op == "Cov" else f"{cov} / nullif((stddev_samp({p}) OVER {w}) * (stddev_samp({q}) OVER {w}), 0)", f"count(CASE WHEN {pair} THEN 1 END)")
    if op in ("Slope", "Resi"):
        slope = f"(regr_slope({x}, i) OVER {w})"
        return slope if op == "Slope" else f"{x} - ({slope} * i + (regr_intercept({x}, i) OVER {w}))"
    raise KeyError(op)


def query(factors: Mapping[str, Node]) -> str:
    """SELECT symbol, datetime and the factors, ``tidy``."""
    levels: dict[Node, int] = {}
    names: dict[Node, str] = {}

    def level(node: Node) -> int:
        if node not in levels:
            op = None if node.op in ("Feature", "Constant") else operator(node)
            levels[node] = 0 if op is None else max((level(x) for x in node.args[: op.columns]), default=0) + (op.kind != "scalar")
            if op is not None and op.kind != "scalar":
                names[node] = f"f{len(names)}"
        return levels[node]

    def value(node: Node) -> str:
        if node.op == "Feature":
            return f'"{node.args[0]}"'
        if node.op == "Constant":
            return f"{node.args[0]!r}::DOUBLE"
        return names[node] if node in names else scalar(node.op, [value(x) for x in node.args])

    for node in factors.values():
        level(node)
    stages, last = [sql.PANEL, f"s0 AS (SELECT *, row_number() OVER {_O} AS i FROM panel)"], "s0"
    for k in range(1, max(levels.values(), default=0) + 1):
        own = [x for x in names if levels[x] == k]
        given, made = [], []
        for x in own:
            op = operator(x)
            args = [f"{names[x]}_{j}" for j in range(op.columns)]
            given += [f"{value(y)} AS {c}" for y, c in zip(x.args[: op.columns], args, strict=True)]
            numbers = [int(c.args[0]) if c.args[0] == int(c.args[0]) else c.args[0] for c in x.args[op.columns :]]
            made.append(f"{window(x.op, args, numbers)} AS {names[x]}")
        stages += [f"a{k} AS MATERIALIZED (SELECT *, {', '.join(given)} FROM {last})", f"s{k} AS MATERIALIZED (SELECT *, {', '.join(made)} FROM a{k})"]
        last = f"s{k}"
    tidied = f"CASE WHEN abs({{0}}) < {ZERO} THEN 0.0 ELSE {{0}}::FLOAT END::DOUBLE AS {{0}}"
    stages.append(f"z AS (SELECT symbol, datetime, {', '.join(f'({value(node)})::DOUBLE AS {name}' for name, node in factors.items())} FROM {last})")
    body, last = ", ".join(map(tidied.format, factors)), "z"
    return f"WITH {', '.join(stages)} SELECT symbol, datetime, {body} FROM {last}"
