"""Recurrences on a stream: the step functions of the batch, with state kept for each symbol.

Rows of a micro-batch are taken in time order, rows of the same time as they come; rows earlier than
the last one seen are dropped, as in a batch over ordered bars there are none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.recurrences import Recurrence

STATE = T.StructType([T.StructField("last", T.TimestampType()), T.StructField("state", T.BinaryType())])


class Steps(StatefulProcessor):
    def __init__(self, r: Recurrence, time: str):
        self.r, self.time = r, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        last, state = None, None
        if self.kept.exists():
            kept = self.kept.get()
            last, state = kept[0], pickle.loads(kept[1])
            found = found[found[self.time] >= pd.Timestamp(last)]
        out = []
        for values in found[list(self.r.inputs)].itertuples(index=False, name=None):
            state, emitted = self.r.step(state, values)
            out.append(emitted)
        if out:
            self.kept.update((found[self.time].iloc[-1].to_pydatetime(), pickle.dumps(state)))
            made = pd.DataFrame(out, columns=list(self.r.outputs), dtype="float64")
            made.insert(0, self.time, found[self.time].to_numpy())
            made.insert(0, "symbol", key[0])
            yield made

    def close(self) -> None:
        pass


def run(stream: DataFrame, r: Recurrence, time: str = "ts", mode: str = "Append") -> DataFrame:
    """(symbol, time, outputs). The session needs a state store that keeps column families (RocksDB)."""
    kinds = {f.name: f.dataType for f in stream.schema}
    schema = T.StructType([T.StructField("symbol", kinds["symbol"]), T.StructField(time, kinds[time]), *(T.StructField(o, T.DoubleType()) for o in r.outputs)])
    given = stream.select("symbol", time, *r.inputs)
    return given.groupBy("symbol").transformWithStateInPandas(Steps(r, time), outputStructType=schema, outputMode=mode, timeMode="None")
