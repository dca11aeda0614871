"""File events with state: of a path's events in a burst the last one counts, whatever the order they come in.

For each path the state holds the last event seen (by its time, then its number), whether the path was last told as gone,
and a timer. An event that is older than the state's changes nothing, so a log that is replayed or comes out of order
tells the same. What a path comes to is told when its burst is over: DEBOUNCE after its last event, in event time. The
state of a deleted path stays as a tombstone for RETENTION, so that late events of it are not taken for new ones, and goes
then; that of a path which lives on goes too, for its next event is told in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.store import Snapshots
from ..sources.session import importable
from .watch import apply_changes

EVENTS = "path string, change string, at timestamp, seq bigint"
CHANGES = "path string, change string, at timestamp"
#: Milliseconds after a path's last event at which it is told, and for which its state stays afterwards.
DEBOUNCE, RETENTION = 500, 24 * 3600 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastEvent(StatefulProcessor):
    """(path, change, at) of each burst of a path's events (EVENTS); ticks, which have no path, only move time on."""

    def __init__(self, debounce: int = DEBOUNCE, retention: int = RETENTION):
        self.debounce, self.retention = debounce, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, seq bigint, change string, told boolean, timer bigint")

    def _set_timer(self, old: int | None, new: int) -> None:
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = None
        for frame in rows:
            at = frame["at"].astype("datetime64[ms]").astype("int64")
            for t, seq, change in zip(at, frame["seq"], frame["change"], strict=True):
                new = max(new, (int(t), int(seq), change)) if new else (int(t), int(seq), change)
        if new is None or not key[0]:
            return iter([])
        old = self.last.get() if self.last.exists() else None
        if old is None or (old[0], old[1]) < new[:2]:
            timer = new[0] + self.debounce
            self._set_timer(old[4] if old else None, timer)
            self.last.update((*new, False, timer))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, seq, change, told, _ = self.last.get()
        if told:
            self.last.clear()
            return iter([])
        timer = at + self.debounce + self.retention
        self._set_timer(None, timer)
        self.last.update((at, seq, change, True, timer))
        return iter([pd.DataFrame({"path": [key[0]], "change": [change], "at": [pd.Timestamp(at, unit="ms")]})])

    def close(self) -> None:
        pass


def settled(events: DataFrame, delay: str = "10 seconds", debounce: int = DEBOUNCE, retention: int = RETENTION) -> DataFrame:
    """CHANGES of a stream of EVENTS. ``delay``: how much later than others an event may come and still be looked at.

    The session's state store has to be RocksDB (``prepare``). Rows without a time are left out.
    """
    rows = events.where("at is not null").select(F.coalesce("path", F.lit("")).alias("path"), "change", "at", F.coalesce("seq", F.lit(0)).alias("seq"))
    return rows.withWatermark("at", delay).groupBy("path").transformWithStateInPandas(LastEvent(debounce, retention), CHANGES, "Append", "EventTime")


def prepare(spark: SparkSession) -> None:
    """State in RocksDB, and this package for the workers."""
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def follow(spark: SparkSession, log: str, root: str, store: Snapshots, checkpoint: str, delay: str = "10 seconds", **timing: int):
    """Applies a folder of event files (JSON lines of EVENTS) about the tree at root to a store, and ends with what there is."""
    prepare(spark)
    events = spark.readStream.schema(EVENTS).json(log)
    writer = settled(events, delay, **timing).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.foreachBatch(lambda b, _: apply_changes(store, root, b.select("path", "change"))).trigger(availableNow=True).start()
