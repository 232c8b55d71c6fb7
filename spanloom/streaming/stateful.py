"""Streams whose rows need the one before: captions that roll, and the onset of a window's energy.

Each keeps one small state for a source.  A timer in event time ends a source that has
been silent, so states don't pile up; what it still holds is given out then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators import folds

CAPTION = "source_id string, start double, end double, text string"
HELD = "start double, end double, words array<string>, timer long"


def _whole(value: object) -> float | None:
    return None if value is None or pd.isna(value) else float(value)


class Captions(StatefulProcessor):
    """Holds the open caption of a source until the next one with new words, or until ``silence`` seconds have passed."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", HELD)

    def _hold(self, last: dict, timer: int, before: int | None) -> None:
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(timer)
        self.open.update((last["start"], last["end"], last["words"], timer))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        last = {"start": held[0], "end": held[1], "words": list(held[2])} if held else None
        timer = before = held[3] if held else None
        out = []
        for row in pd.concat(rows).sort_values("pos", kind="stable").itertuples():
            done, last = folds.rolled(last, {"start": _whole(row.start), "end": _whole(row.end), "text": row.text})
            if done is not None:
                out.append((key[0], *folds.said(done).values()))
            timer = max(timer or 0, int(row.at.timestamp() * 1000) + self.silence * 1000)
        if last is not None:
            self._hold(last, timer, before)
        yield pd.DataFrame(out, columns=["source_id", "start", "end", "text"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            start, end, words, timer = self.open.get()
            if timer <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], start, end, " ".join(words)))
                self.open.clear()
        yield pd.DataFrame(out, columns=["source_id", "start", "end", "text"])

    def close(self) -> None:
        pass


def captions(rows: DataFrame, late: str = "10 seconds", silence: int = 60) -> DataFrame:
    """The captions of ``folds.rolling_captions`` from a stream of ``source_id, pos, start, end, text`` and their arrival ``at``.

    A batch's rows stand by ``pos``; batches of a source must come in its order.  A
    source's last caption comes once the watermark is ``silence`` seconds past its row.
    """
    marked = rows.withWatermark("at", late).select("source_id", "pos", "start", "end", "text", "at")
    return marked.groupBy("source_id").transformWithStateInPandas(Captions(silence), CAPTION, "Append", "EventTime")


def onset(level: float, before: float | None) -> float:
    """How much of a level wasn't there before, 0..1; nothing before, or silence, gives none."""
    return max(0.0, min(1.0, (level - (before or level)) / max(level, 1e-6)))


class Onsets(StatefulProcessor):
    """Holds the last window's level of a source."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rms double, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, timer = self.last.get() if self.last.exists() else (None, None)
        before, found = timer, []
        frame = pd.concat(rows).sort_values("at", kind="stable")
        for row in frame.itertuples():
            found.append(onset(row.rms, level))
            level, timer = row.rms, max(timer or 0, int(row.at.timestamp() * 1000) + self.silence * 1000)
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(timer)
        self.last.update((level, timer))
        yield pd.DataFrame({"key": key[0], "at": frame["at"], "rms": frame["rms"], "onset": found})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def onsets(windows: DataFrame, key: str, silence: int = 3600) -> DataFrame:
    """``key, at, rms, onset`` from a stream of ``events.energy_windows``: each level against that of the window before."""
    rows = windows.select(F.col(key).cast("string").alias("key"), "at", "rms")
    out = rows.groupBy("key").transformWithStateInPandas(Onsets(silence), "key string, at timestamp, rms double, onset double", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


def onsets_of(windows: DataFrame, key: str) -> DataFrame:
    """The same of a table."""
    before = F.lag("rms").over(Window.partitionBy(key).orderBy("at"))
    before = F.coalesce(F.nullif(before, F.lit(0.0)), F.col("rms"))
    rise = (F.col("rms") - before) / F.greatest(F.col("rms"), F.lit(1e-6))
    return windows.select(key, "at", "rms", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rise)).alias("onset"))
