"""Adaptive debouncing: bursts of changes, whose quiet time grows when many come at once.

A key's changes wait 200 ms for the next one. When more than three fall into one
window of 200 ms, the wait is 500 ms until a change opens a new window. (After
five seconds of quiet it is 200 ms again; since a change that late always opens a
new window, that needs no state of its own.)

State and timers are Spark's: changes wait in a list state until the watermark
has passed them, are then taken in order of time, and a timer ends a burst that
nothing followed. So results depend on neither the order of arrival within the
watermark's delay nor on how the stream is cut into batches, and a batch that
runs again finds the state of the batch before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

BASE_MS, BURST_MS, THRESHOLD, QUIET_MS = 200, 500, 3, 5000
BURSTS = "path string, first_ts timestamp, last_ts timestamp, events long, op string, wait_ms long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tracker:
    """The window of one key: (its start, its number of changes, whether they are too many)."""

    def __init__(self, start: int = -(1 << 62), count: int = 0, extended: bool = False) -> None:
        self.start, self.count, self.extended = start, count, extended

    def update(self, now: int) -> int:
        """Takes a change at ``now`` (ms); the wait that then holds."""
        if now - self.start > BASE_MS:
            self.start, self.count, self.extended = now, 1, False
        else:
            self.count += 1
            self.extended = self.extended or self.count > THRESHOLD
        return BURST_MS if self.extended else BASE_MS

    def wait(self, last: int, now: int) -> int:
        """The wait at ``now``, after the last change at ``last``."""
        return BURST_MS if self.extended and now - last <= QUIET_MS else BASE_MS


class _Debounce(StatefulProcessor):
    """Held changes, the open burst (first, last, events, op, wait) and the tracker of each path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, op string")
        self.open = handle.getValueState("open", "first long, last long, events long, op string, wait long, start long, count long, extended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [(int(at), op) for part in rows for at, op in zip(part["at"], part["op"], strict=True)]
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, fresh: list[tuple[int, str]], reached: int) -> Iterator[pd.DataFrame]:
        held = sorted([*(tuple(x) for x in (self.held.get() if self.held.exists() else [])), *fresh])
        ready = [x for x in held if x[0] <= reached]
        state = self.open.get() if self.open.exists() else None
        burst = list(state[:5]) if state else None
        tracker = Tracker(*state[5:]) if state else Tracker()
        ended = []
        for at, op in ready:
            if burst and at - burst[1] > burst[4]:
                ended.append(burst)
                burst = None
            wait = tracker.update(at)
            burst = [burst[0], at, burst[2] + 1, op, wait] if burst else [at, at, 1, op, wait]
        if burst and burst[1] + burst[4] <= reached:
            ended.append(burst)
            burst = None
        rest = held[len(ready) :]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        if burst:
            self.open.update((*burst, tracker.start, tracker.count, tracker.extended))
        else:
            self.open.clear()
        due = min([x[0] for x in rest[:1]] + ([burst[1] + burst[4]] if burst else []), default=None)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)
        if ended:
            time = lambda i: pd.to_datetime([b[i] for b in ended], unit="ms")
            yield pd.DataFrame({"path": [key[0]] * len(ended), "first_ts": time(0), "last_ts": time(1), "events": [b[2] for b in ended], "op": [b[3] for b in ended], "wait_ms": [b[4] for b in ended]})

    def close(self) -> None:
        pass


def adaptive(changes: DataFrame, *, late: str = "1 second") -> DataFrame:
    """Ended bursts (path, first_ts, last_ts, events, op, wait_ms) of a stream of changes (path, op, ts).

    Times count in whole milliseconds. Of one time the greater op is the last.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    known = changes.select("path", "op", "ts", F.unix_millis("ts").alias("at")).withWatermark("ts", late)
    return known.groupBy("path").transformWithStateInPandas(_Debounce(), StructType.fromDDL(BURSTS), outputMode="Append", timeMode="EventTime")


def bursts(times: Iterable[tuple[int, str]], reached: int) -> list[tuple[int, int, int, str, int]]:
    """The ended bursts of one key, at once: (first, last, events, op, wait) of changes (ms, op) up to a watermark."""
    out, burst, tracker = [], None, Tracker()
    for at, op in sorted(times):
        if burst and at - burst[1] > burst[4]:
            out.append(burst)
            burst, tracker = None, Tracker()
        wait = tracker.update(at)
        burst = (burst[0], at, burst[2] + 1, op, wait) if burst else (at, at, 1, op, wait)
    return out + ([burst] if burst and burst[1] + burst[4] <= reached else [])


def drained(stream: DataFrame, spark: SparkSession, place: str) -> DataFrame:
    """All rows that a stream over what is there now gives, written below ``place`` and read back."""
    writer = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
