"""An exact trailing-window throttle as a stream: hits of a key in the seconds up to each of its events, corrected while late events may come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = "event_id long, key long, hits long"


def trailing(at: np.ndarray, micros: int) -> np.ndarray:
    """Of each of the sorted times how many lie in (time - micros, time], ties included."""
    return np.searchsorted(at, at, "right") - np.searchsorted(at, at - micros, "right")


class _Hits(StatefulProcessor):
    """A key's state is the list of its events that are still in reach: of an event not older than the watermark, or of one in such an
    event's window, with the hits last given out. New events give out their own hits and those of later ones that they change. A timer
    forgets events that are out of reach, so a silent key keeps nothing."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "at long, event_id long, hits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([r[["at_us", "event_id"]] for r in rows]).to_numpy(np.int64)
        held = np.array(list(self.hits.get()) if self.hits.exists() else [], np.int64).reshape(-1, 3)
        closed = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        new, held = new[new[:, 0] > closed], held[held[:, 0] > closed - self.micros]
        if not len(new):
            return
        every = np.concatenate([held, np.column_stack([new, np.full(len(new), -1)])])
        every = every[np.argsort(every[:, 0], kind="stable")]
        hits = trailing(every[:, 0], self.micros)
        changed = (every[:, 0] >= new[:, 0].min()) & (hits != every[:, 2])  # earlier ones may have lost part of their window
        every[changed, 2] = hits[changed]
        self.hits.put([tuple(map(int, r)) for r in every])
        self._wake(every[-1, 0])
        yield pd.DataFrame({"event_id": every[changed, 1], "key": key[0], "hits": hits[changed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        floor = timerValues.getCurrentWatermarkInMs() * 1000 - self.micros
        left = [r for r in self.hits.get() if r[0] > floor] if self.hits.exists() else []
        if left:
            self.hits.put(left)
            self._wake(left[-1][0])
        else:
            self.hits.clear()
        yield pd.DataFrame({"event_id": [], "key": [], "hits": []}).astype("int64")

    def _wake(self, last: int) -> None:
        """One timer, for the time at which the last event is out of reach."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((int(last) + self.micros) // 1000 + 1)

    def close(self) -> None:
        pass


def trailing_hits(events: DataFrame, seconds: int, late: str) -> DataFrame:
    """event_id, key, hits for a stream of events (event_id, key, ts): in update mode, the last row of an event counts. Events that come
    later than `late` behind the newest are dropped. The session's state store must be RocksDB."""
    at = events.select("event_id", F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("at")).withColumn("at_us", F.unix_micros("at"))
    return at.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Hits(seconds * 1_000_000), OUTPUT, "Update", "EventTime")
