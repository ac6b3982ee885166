"""Frames as they come: tracks of recognised text in the state of their medium, handed on once they are over.

Needs a state store that supports it (RocksDB). A medium's frames come in order; what comes after the watermark is
dropped, and a track that is not seen again ends when the watermark passes its gap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import tracks

TRACK = "media string, text string, confidence double, first double, last double, seen int"


class Tracks(StatefulProcessor):
    def __init__(self, gap: float = tracks.GAP):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("active", "tracks string")

    def _table(self, media: str, over: list[dict]) -> pd.DataFrame:
        done = [tracks.finished(t) for t in over]
        return pd.DataFrame({"media": [media] * len(done), **{c: [t[c] for t in done] for c in ("text", "confidence", "first", "last", "seen")}})

    def _active(self) -> list[dict]:
        return json.loads(self.state.get()[0]) if self.state.exists() else []

    def _keep(self, active: list[dict]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if active:
            self.state.update((json.dumps(active),))
            self.handle.registerTimer(int(1000 * (min(t["last"] for t in active) + self.gap)) + 1)
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active = self._active()
        lines = pd.concat(list(rows)).sort_values(["seconds", "frame", "line"]).to_dict("records")
        for (seconds, _), frame in groupby(lines, key=lambda r: (r["seconds"], r["frame"])):
            active, over = tracks.advance(active, seconds, [(r["text"], r["confidence"], tuple(r["box"]), [r["frame"], r["line"]]) for r in frame], self.gap)
            if over:
                yield self._table(key[0], over)
        self._keep(active)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        active, over = tracks.advance(self._active(), now, [], self.gap)
        if over:
            yield self._table(key[0], over)
        self._keep(active)

    def close(self) -> None:
        pass


def stream_tracks(lines: DataFrame, watermark: str = "1 second", gap: float = tracks.GAP) -> DataFrame:
    """Finished tracks of a stream of lines(media, frame, line, at timestamp, text, confidence, box); first and last are seconds of `at`."""
    timed = lines.where("box is not null and size(box) = 4").withWatermark("at", watermark)
    rows = timed.select("media", "frame", "line", "at", F.unix_micros("at").cast("double").__truediv__(1e6).alias("seconds"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "box")
    return rows.groupBy("media").transformWithStateInPandas(Tracks(gap), TRACK, "Append", "EventTime")
