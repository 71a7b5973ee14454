"""Streaming cooldown: one remembered pass per key."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import COOLDOWN_MS

#: How long a key's last pass is remembered after it was written, in real time.
REMEMBERED_MS = 86_400_000
_LAST = T.StructType([T.StructField("last_ts", T.LongType())])


class Cooldown(StatefulProcessor):
    """Passes a row if its key has no last pass or the window has gone by in event time."""

    def __init__(self, window: int, order: str, remembered: int = REMEMBERED_MS):
        self.window = window
        self.order = order
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LAST, self.remembered)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for pdf in [pd.concat(list(rows)).sort_values(self.order)]:
            keep = []
            for ts, ok in zip(pdf["ts"].tolist(), pdf["send_ok"].tolist()):
                passed = last is None or ts - last >= self.window
                if passed:
                    last = ts if ok else None
                keep.append(passed)
            if last is None:
                self.last.clear()
            else:
                self.last.update((last,))
            yield pdf[keep]


def cooldown_stream(rows: DataFrame, keys: list[str], order: str = "seq",
                    window: int = COOLDOWN_MS, remembered: int = REMEMBERED_MS) -> DataFrame:
    """Rows that pass; `send_ok` (default true) of false gives the cooldown back. A key's state
    goes `remembered` milliseconds of real time after its last pass."""
    if "send_ok" not in rows.columns:
        rows = rows.withColumn("send_ok", F.lit(True))
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Cooldown(window, order, remembered), outputStructType=rows.schema,
        outputMode="Append", timeMode="ProcessingTime")
