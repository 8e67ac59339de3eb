"""From expression trees to one staged DataFrame plan.

Every window node becomes a column, computed once however many factors use it. Nodes are computed
level by level (a node's level is one more than its deepest window argument), within a level first
those over symbols, then those over times: a change of partitioning costs a shuffle, so each level
has two at most. Scalar nodes are written into the columns that use them.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators import grouped
from tapeloom.plans.expression import ExpressionError, Node, parse
from tapeloom.plans.registry import OPERATORS, Operator, Panel


def operator(node: Node) -> Operator:
    if (op := OPERATORS.get(node.op)) is None:
        raise ExpressionError(f"no operator {node.op}")
    if len(node.args) != op.n_args:
        raise ExpressionError(f"{node.op} takes {op.n_args} arguments, not {len(node.args)}")
    return op


def _numbers(node: Node, op: Operator) -> list:
    out = []
    for a in node.args[op.columns :]:
        if a.op != "Constant":
            raise ExpressionError(f"{node.op} takes a number, not {a}")
        out.append(int(a.args[0]) if a.args[0] == int(a.args[0]) else a.args[0])
    return out


class Plan:
    """Collects the window nodes of some factors by level and kind, each once."""

    def __init__(self, factors: Mapping[str, Node]):
        self.factors, self.levels, self.names = factors, {}, {}
        for node in factors.values():
            self._level(node)

    def _level(self, node: Node) -> int:
        if node in self.levels:
            return self.levels[node]
        if node.op in ("Feature", "Constant"):
            self.levels[node] = 0
            return 0
        op = operator(node)
        _numbers(node, op)
        level = max((self._level(a) for a in node.args[: op.columns]), default=0)
        if op.kind != "scalar":
            level += 1
            self.names[node] = f"_f{len(self.names)}"
        self.levels[node] = level
        return level

    def column(self, node: Node, panel: Panel, at: DataFrame, memo: dict) -> Column:
        if node in self.names:
            return F.col(self.names[node])
        if node not in memo:
            if node.op == "Feature":
                memo[node] = F.col(node.args[0]).cast("double")
            elif node.op == "Constant":
                memo[node] = F.lit(node.args[0])
            else:
                memo[node] = operator(node).build(panel, *(self.column(a, panel, at, memo) for a in node.args))
        return memo[node]

    def run(self, frame: DataFrame, panel: Panel) -> DataFrame:
        fields = sorted({n.args[0] for n in self.levels if n.op == "Feature"})
        if missing := [f for f in fields if f not in frame.columns]:
            raise ExpressionError(f"no fields {missing}")
        at, memo = frame.select(panel.symbol, panel.time, *(F.col(f) for f in fields if f not in (panel.symbol, panel.time))), {}
        for level in range(1, max([0, *(self.levels[n] for n in self.names)]) + 1):
            own = [n for n in self.names if self.levels[n] == level]
            for kind in ("rolling", "cross"):
                if some := [n for n in own if operator(n).kind == kind]:
                    at = at.withColumns({self.names[n]: self._build(n, panel, at, memo) for n in some})
            if some := [n for n in own if operator(n).kind == "recursive"]:
                at = self._recursive(at, panel, some, memo)
        return at.select(panel.symbol, panel.time, *(self.column(n, panel, at, memo).cast("double").alias(k) for k, n in self.factors.items()))

    def _build(self, node: Node, panel: Panel, at: DataFrame, memo: dict) -> Column:
        op = operator(node)
        return op.build(panel, *(self.column(a, panel, at, memo) for a in node.args[: op.columns]), *_numbers(node, op))

    def _recursive(self, at: DataFrame, panel: Panel, nodes: list[Node], memo: dict) -> DataFrame:
        """Functions of a symbol's whole past: one pass over its rows adds all columns of the level."""
        given = at.withColumns({f"{self.names[n]}_in": self.column(n.args[0], panel, at, memo) for n in nodes})
        schema = T.StructType([*at.schema.fields, *(T.StructField(self.names[n], T.DoubleType()) for n in nodes)])
        calls = [(self.names[n], operator(n).build, _numbers(n, operator(n))) for n in nodes]

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            for name, build, numbers in calls:
                rows[name] = build(rows[f"{name}_in"].astype("float64"), *numbers)
            return rows[schema.fieldNames()]

        return grouped.by_symbol(given, panel.symbol, [panel.time], run, schema)


def evaluate(frame: DataFrame, factors: Mapping[str, str | Node], panel: Panel | None = None) -> DataFrame:
    """(symbol, datetime, one column for each factor) of a panel whose (symbol, datetime) is unique."""
    return Plan({k: parse(v) if isinstance(v, str) else v for k, v in factors.items()}).run(frame, panel or Panel())


def factor(frame: DataFrame, text: str, panel: Panel | None = None) -> DataFrame:
    """(symbol, datetime, factor)."""
    return evaluate(frame, {"factor": text}, panel)
