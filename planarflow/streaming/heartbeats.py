"""Heartbeats of workers as a stream with state and timers: when each one fell silent, and when it came back."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a worker's stream of beats tells.
STRETCH = "worker long, began timestamp, ended timestamp, beats long"
#: The state store that state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(at) -> int:
    return int(pd.Timestamp(at).value // 1000)


def _time(micros: int) -> datetime:
    return datetime.fromtimestamp(micros / 1e6, timezone.utc).replace(tzinfo=None)


class Stretches(StatefulProcessor):
    """Stretches in which a worker was alive, by beats no more than lease apart.

    State holds the stretches that later beats can still change, each as its begin, end and number of beats. A timer of event time
    stands at the end of the first one and the lease; when the watermark passes it, no beat can lengthen that stretch, so it is
    returned and forgotten. Beats that come late, but before the watermark, lengthen or join stretches wherever they belong."""

    def __init__(self, lease_micros: int):
        self.lease = lease_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "began long, ended long, beats long")

    def _held(self) -> list[list[int]]:
        return [list(row) for row in self.open.get()] if self.open.exists() else []

    def _keep(self, stretches: list[list[int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stretches:
            self.open.put([tuple(s) for s in stretches])
            self.handle.registerTimer((stretches[0][1] + self.lease) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = [[t, t, 1] for frame in rows for t in map(_micros, frame["ts"])]
        out: list[list[int]] = []
        for began, ended, n in sorted([*self._held(), *beats]):
            if out and began - out[-1][1] <= self.lease:
                out[-1][1] = max(out[-1][1], ended)
                out[-1][2] += n
            else:
                out.append([began, ended, n])
        self._keep(out)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        over = [s for s in held if s[1] + self.lease < mark]
        self._keep([s for s in held if s[1] + self.lease >= mark])
        if over:
            yield pd.DataFrame({"worker": [key[0]] * len(over), "began": [_time(s[0]) for s in over], "ended": [_time(s[1]) for s in over], "beats": [s[2] for s in over]})

    def close(self) -> None:
        pass


def stretches(events: DataFrame, lease: float, late: str = "10 minutes") -> DataFrame:
    """worker, began, ended and beats of every stretch of life that is over; events is a stream of worker and ts (timestamp).

    The session needs the state store STORE."""
    beats = events.withWatermark("ts", late).select("worker", "ts")
    return beats.groupBy("worker").transformWithStateInPandas(Stretches(int(lease * 1e6)), STRETCH, "append", "eventTime")
