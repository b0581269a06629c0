"""Keyed state of streams: alert verdicts judged by event-time timers, and runs of an average that merge.

Both keep their state in Spark's state store, which the checkpoint of a query recovers; a batch that
is run again sees the state from before it. Executors get these classes by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store that holds it on disk; a store set by the user stays
    if it is that one."""
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)


class Verdicts(StatefulProcessor):
    """Changes of a rule's verdict over time windows.

    A window's verdict waits in the state until the watermark has passed the window's end; timers
    fire in the order of time, so verdicts are compared in order however the windows came in.
    """

    output = "rule string, severity string, window_start timestamp, value double, status string"

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "severity string, value double, triggered boolean")
        self.last = handle.getValueState("last", "triggered boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, severity, value, triggered in zip(part["at"], part["severity"], part["value"], part["triggered"]):
                value = None if pd.isna(value) else float(value)
                self.waiting.updateValue((int(at),), (severity, value, bool(triggered)))
                self.handle.registerTimer(int(at) + self.window_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() - self.window_ms
        if not self.waiting.containsKey((at,)):
            return
        severity, value, triggered = self.waiting.getValue((at,))
        self.waiting.removeKey((at,))
        was = self.last.get()[0] if self.last.exists() else False
        self.last.update((triggered,))
        if was != triggered:
            start = pd.to_datetime([at], unit="ms")
            yield pd.DataFrame({
                "rule": [key[0]], "severity": [severity], "window_start": start, "value": [value],
                "status": ["active" if triggered else "resolved"],
            })

    def close(self) -> None:
        pass


class Runs(StatefulProcessor):
    """The map that a stretch of time applies to an exponential average: x to decay^n x + shift.

    Rows of a stretch that is still open wait in the state in no order; a late row takes its place among
    them when their map is made, and every batch that adds to a stretch gives its map anew. When the
    watermark has passed the end of the stretch its rows leave the state: its last map stands.
    """

    def __init__(self, order: list[str], order_types: str, alpha: float, stretch_ms: int):
        self.order, self.order_types, self.alpha, self.stretch_ms = order, order_types, alpha, stretch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"{self.order_types}, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for part in rows for r in part[[*self.order, "value"]].astype(object).itertuples(index=False)]
        self.rows.appendList(new)
        values = [r[-1] for r in sorted(tuple(r) for r in self.rows.get())]
        shift = 0.0
        for v in values:
            shift = (1.0 - self.alpha) * shift + self.alpha * v
        yield pd.DataFrame({"key": [key[0]], "stretch": [key[1]], "n": [len(values)], "shift": [shift], "first": [values[0]]})
        self.handle.registerTimer(int(key[1]) + self.stretch_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass
