"""Stateful streams with timers: a folder's files over its walks, and beliefs whose check runs out.

Both are keyed (by path, by id) and hold one small value and at most two timers a key in the state store, in event time: what a
stream says depends on the times in its rows and not on when they are read, so a restart, or other micro-batches, changes nothing
(as long as the rows of one walk come in one micro-batch). The state store has to be RocksDB, as tarn.session sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: A file has to be left alone so long before it is read; a belief stays checked so long.
SETTLE_MS, QUIET_MS = 2000, 30 * 24 * 3600 * 1000
CHANGES = "path string, change string, modified timestamp, at timestamp"


def _ms(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64") // 1000).tolist()


class Watch(StatefulProcessor):
    """Sightings of one file -> fresh (first settled version), changed (a later one), missing (a walk went by without it), back."""

    def __init__(self, gap_ms: int, settle_ms: int) -> None:
        self.gap, self.settle = gap_ms, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "modified long, length long, seen long, told boolean, known boolean, missing boolean")

    def _told(self, key: tuple, changes: list[tuple[str, int, int]]) -> pd.DataFrame:
        names, modified, at = zip(*changes, strict=True)
        time = lambda x: pd.to_datetime(pd.Series(x), unit="ms")
        return pd.DataFrame({"path": key[0], "change": names, "modified": time(modified), "at": time(at)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["seen", "modified", "length"])
        old = self.state.get() if self.state.exists() else None
        modified, length, seen, told, known, missing = old or (None, None, None, True, False, False)
        timers, changes = {t for t in self.handle.listTimers()}, []
        for at, when, size in zip(_ms(frame["seen"]), _ms(frame["modified"]), frame["length"].tolist(), strict=True):
            if missing or (seen is not None and at - seen > self.gap):
                if not missing:  # walks without the file and its return came in one batch
                    changes.append(("missing", modified, seen + self.gap))
                changes.append(("back", when, at))
                missing = False
            if not told and modified + self.settle <= (at if (when, size) == (modified, length) else when):  # settled meanwhile
                changes.append(("changed" if known else "fresh", modified, modified + self.settle))
                told = known = True
            if (when, size) != (modified, length):
                modified, length, told = when, size, False
                if modified + self.settle <= at:
                    changes.append(("changed" if known else "fresh", modified, at))
                    told = known = True
            seen = at
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(seen + self.gap)
        if not told:
            self.handle.registerTimer(modified + self.settle)
        self.state.update((modified, length, seen, told, known, missing))
        if changes:
            yield self._told(key, changes)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, changes = expiredTimerInfo.getExpiryTimeInMs(), []
        modified, length, seen, told, known, missing = self.state.get()
        if not told and at == modified + self.settle:
            changes.append(("changed" if known else "fresh", modified, at))
            told = known = True
        if not missing and at == seen + self.gap:
            changes.append(("missing", modified, at))
            missing = True
        self.state.update((modified, length, seen, told, known, missing))
        if changes:
            yield self._told(key, changes)


def file_changes(sightings: DataFrame, gap_ms: int, settle_ms: int = SETTLE_MS) -> DataFrame:
    """A stream of sightings (path, modified, length, seen: the walk's time), a row a file and walk -> CHANGES.

    A file that the walks of the next ``gap_ms`` (longer than the time between two walks) don't see is missing; nothing is ever
    deleted. A version that is not yet settled when it is seen is told of once it is, unless it changed before.
    """
    marked = sightings.withWatermark("seen", "0 seconds")
    return marked.groupBy("path").transformWithStateInPandas(Watch(gap_ms, settle_ms), CHANGES, "append", "eventTime")


class Sweep(StatefulProcessor):
    """Checks of one belief -> the time at which it is due again."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("checked", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = max(t for frame in rows for t in _ms(frame["checked_at"]))
        if self.state.exists():
            last = max(last, self.state.get()[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update((last,))
        self.handle.registerTimer(last + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at == self.state.get()[0] + self.quiet:
            yield pd.DataFrame({"id": [key[0]], "due_at": pd.to_datetime([at], unit="ms")})


def due_again(checks: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of checks (id, checked_at) -> (id, due_at), once the last one of a belief is ``quiet_ms`` old by the stream's time."""
    marked = checks.withWatermark("checked_at", "0 seconds")
    return marked.groupBy("id").transformWithStateInPandas(Sweep(quiet_ms), "id long, due_at timestamp", "append", "eventTime")
