"""Functions of a symbol's ordered rows, over partitions sorted by symbol and time.

A partition holds many symbols and is read as a stream, so a symbol costs no call into Python of
its own, and what is kept is the rows of one symbol at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def by_symbol(df: DataFrame, symbol: str, order: Sequence[str], make: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """``make`` of each symbol's rows in order; the symbol must not be NULL."""

    def ended(rows: pd.DataFrame, cuts: Sequence[int]) -> pd.DataFrame:
        return pd.concat([make(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(cuts, cuts[1:], strict=False)], ignore_index=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in parts:
            if rows.empty:
                continue
            if held and held[-1][symbol].iloc[-1] == rows[symbol].iloc[0] and rows[symbol].iloc[0] == rows[symbol].iloc[-1]:
                held.append(rows)
                continue
            rows = pd.concat([*held, rows], ignore_index=True)
            keys = rows[symbol].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            if len(cuts) > 1:
                yield ended(rows, cuts)
            held = [rows.iloc[cuts[-1] :]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield ended(rows, [0, len(rows)])

    return df.repartition(symbol).sortWithinPartitions(symbol, *order).mapInPandas(run, schema)


def stepped(df: DataFrame, symbol: str, order: str, inputs: Sequence[str], outputs: Sequence[str], step: Callable) -> DataFrame:
    """(symbol, order, outputs): ``step(state, row)`` along each symbol's rows; only its state is kept."""
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField(symbol, kinds[symbol]), T.StructField(order, kinds[order]), *(T.StructField(o, T.DoubleType()) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            out = []
            columns = [b.column(2 + k).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist() for k in range(len(inputs))]
            for key, row in zip(b.column(0).to_pylist(), zip(*columns, strict=True), strict=True):
                if key != now:
                    now, state = key, None
                state, emitted = step(state, row)
                out.append(emitted)
            made = [pa.array(c, pa.float64(), from_pandas=True) for c in (zip(*out, strict=True) if out else [[]] * len(outputs))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], [symbol, order, *outputs])

    return df.select(symbol, order, *inputs).repartition(symbol).sortWithinPartitions(symbol, order).mapInArrow(run, schema)
