"""Bursts of events over a stream, each told once, with an account of what came too late.

The batch operator is ``timeline.episodes``. Over a stream, the open episodes of a key are
its state; an event opens one, extends one or closes the gap between two. A timer tells an
episode when the watermark has passed its end by the gap, as no event can reach it then.

An event behind the watermark is not dropped in silence, as Spark's own aggregates would:
it comes out as a row of the kind ``late``, with its time, and changes no episode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPISODE, LATE = "episode", "late"
_MICROS = 1_000_000


class _Episodes(StatefulProcessor):
    """Times are microseconds since 1970; an episode is (first, last, count)."""

    def __init__(self, keys: list[str], gap_micros: int):
        self.keys, self.gap = keys, gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first_at long, last_at long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        times = pd.concat(list(rows))["event_micros"]
        late = times[times < mark]
        if len(late):
            yield self._out(key, [(LATE, t, t, int(n)) for t, n in late.value_counts().sort_index().items()])
        merged: list[list[int]] = []
        points = [(int(t), int(t), int(n)) for t, n in times[times >= mark].value_counts().items()]
        for first, last, n in sorted([*self.open.get(), *points]):
            if merged and first <= merged[-1][1] + self.gap:
                merged[-1][1] = max(merged[-1][1], last)
                merged[-1][2] += n
            else:
                merged.append([first, last, n])
        self._keep(merged)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        episodes = sorted(self.open.get())
        done = [e for e in episodes if e[1] + self.gap < mark]
        if done:
            yield self._out(key, [(EPISODE, *e) for e in done])
        self._keep([e for e in episodes if e[1] + self.gap >= mark])

    def _keep(self, episodes) -> None:
        """The new state, and one timer: at the time by which the first of it has ended."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if episodes:
            self.open.put([tuple(e) for e in episodes])
            self.handle.registerTimer((episodes[0][1] + self.gap) // 1000 + 1)
        else:
            self.open.clear()

    def _out(self, key, rows) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["kind", "first_micros", "last_micros", "event_count"])
        for place, (name, value) in enumerate(zip(self.keys, key, strict=True)):
            frame.insert(place, name, value)
        return frame

    def close(self) -> None:
        pass


def live_episodes(events: DataFrame, keys: list[str], at: str, gap_minutes: int = 30, lateness: str = "1 hour") -> DataFrame:
    """(keys, kind, first_at, last_at, event_count) of a stream of events.

    ``kind`` is ``episode`` for a burst that has ended, or ``late`` for events of one
    time that were more than ``lateness`` behind the latest. Every event is counted in
    one row or the other, or is still open. Events without a key or a time are left out,
    as in batch. Use the ``append`` output mode and the RocksDB state store.
    """
    kept = events.select(*keys, F.col(at).alias("_at")).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "_at"]))
    # Without the time column itself, Spark does not drop late rows before they are seen here.
    marked = kept.withWatermark("_at", lateness).select(*keys, F.unix_micros("_at").alias("event_micros"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(*keys).schema)
    told = marked.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Episodes(keys, gap_minutes * 60 * _MICROS),
        outputStructType=f"{types}, kind string, first_micros long, last_micros long, event_count long",
        outputMode="Append", timeMode="EventTime")
    return told.select(*keys, "kind", *(F.timestamp_micros(f"{c}_micros").alias(f"{c}_at") for c in ("first", "last")), "event_count")


def write_episodes(live: DataFrame, folder: str, checkpoint: str, **trigger):
    """Start writing episodes and late events to two tables, ``episode`` and ``late``.

    A batch that is run again after a failure writes the same folder again.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind in (EPISODE, LATE):
            batch.filter(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")
        batch.unpersist()

    return (live.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start())
