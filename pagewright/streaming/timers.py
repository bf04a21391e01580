"""Debounced edits by timers: a burst fires although nothing follows it (needs the RocksDB state store)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.edits import DEBOUNCE, _seconds


class Debounce(StatefulProcessor):
    """Holds the last edit of a page's open burst and a timer for it.

    Edits up to `gap` apart in event time are one burst, as in
    `operators.edits.debounce`. A later edit beyond the gap fires the open burst
    at once; otherwise the timer does, `gap` after the last arrival. An edit
    older than the open burst by more than the gap is a burst of its own.
    """

    def __init__(self, gap_seconds: float, payload_type: str):
        self.gap = pd.Timedelta(seconds=gap_seconds)
        self.wait_ms = int(gap_seconds * 1000)
        self.payload_type = payload_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"first timestamp, ts timestamp, seq long, payload {self.payload_type}")

    def _row(self, key, burst) -> tuple:
        return key[0], burst[1] + self.gap, burst[2], burst[3]

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["page_id", "fire_at", "seq", "payload"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bursts: list[list] = []  # [first, last, seq, payload] in event time, further apart than the gap
        if self.open.exists():
            first, ts, seq, payload = self.open.get()
            bursts.append([pd.Timestamp(first), pd.Timestamp(ts), seq, payload])
        for frame in rows:
            for ts, seq, payload in zip(frame["ts"], frame["seq"], frame["payload"]):
                new = [ts, ts, int(seq), payload]
                apart = []
                for b in bursts:
                    if b[0] - self.gap <= new[1] and new[0] - self.gap <= b[1]:  # within the gap of each other
                        last = max(b, new, key=lambda x: (x[1], x[2]))
                        new = [min(b[0], new[0]), *last[1:]]
                    else:
                        apart.append(b)
                bursts = sorted([*apart, new], key=lambda b: b[1])
        *fired, last = bursts
        self.open.update((last[0].to_pydatetime(), last[1].to_pydatetime(), last[2], last[3]))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield from self._frame([self._row(key, b) for b in fired])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            first, ts, seq, payload = self.open.get()
            self.open.clear()
            yield from self._frame([self._row(key, [first, pd.Timestamp(ts), seq, payload])])

    def close(self) -> None:
        pass


def debounce_timed(edits: DataFrame, payload: str, gap: str = DEBOUNCE) -> DataFrame:
    """(page_id, fire_at, seq, payload): the last edit of each burst, also of the last one of a stream that falls silent.

    The state of a page is one edit. Give `edits` a watermark and
    `dropDuplicatesWithinWatermark` first where replays are to count once. Run
    it with a processing-time trigger: its batches go on without new data, so
    the timers come due. A burst that has fired does not come back: an edit that
    arrives later than `gap` fires anew, as the page was silent in between.
    """
    kind = edits.schema["page_id"].dataType.simpleString()
    content = edits.schema[payload].dataType.simpleString()
    out = edits.selectExpr("page_id", "ts", "seq", f"`{payload}` AS payload").groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=Debounce(_seconds(gap), content), outputStructType=f"page_id {kind}, fire_at timestamp, seq long, payload {content}",
        outputMode="Append", timeMode="ProcessingTime")
    return out.withColumnRenamed("payload", payload)
