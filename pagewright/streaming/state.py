"""Page state as a stateful stream (needs the RocksDB state store)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = ("status string, progress int, error string, attempts long, ts timestamp, seq long, "
         "shown_ts timestamp, shown_seq long")
OUTPUT = "status string, progress int, error string, attempts long"
NEVER = (pd.Timestamp("1900-01-01"), -1)


class PageState(StatefulProcessor):
    """Folds the events of a page; same rules as `operators.edits.page_state`.

    Keeps the (ts, seq) of the last event and of the last one that set the
    progress, so events may come in any order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("page", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, progress, error, attempts, last, shown = "idle", 0, None, 0, NEVER, NEVER
        if self.state.exists():
            status, progress, error, attempts, *order = self.state.get()
            last, shown = (pd.Timestamp(order[0]), order[1]), (pd.Timestamp(order[2]), order[3])
        for frame in rows:
            frame = frame.sort_values(["ts", "seq"])
            attempts += int((frame["event"] == "started").sum())
            percent = frame["progress"].where(frame["event"] == "progress").mask(frame["event"] == "started", 0).mask(frame["event"] == "finished", 100)
            setting = frame[percent.notna()]
            if len(setting) and (at := (setting["ts"].iloc[-1], setting["seq"].iloc[-1])) > shown:
                progress, shown = int(percent.dropna().iloc[-1]), at
            row = frame.iloc[-1]
            if (at := (row["ts"], row["seq"])) > last:
                last = at
                status = {"finished": "completed", "failed": "failed"}.get(row["event"], "processing")
                known = isinstance(row["error"], str) and row["error"]
                error = (row["error"] if known else "Unknown error") if row["event"] == "failed" else None
        self.state.update((status, progress, error, attempts, last[0].to_pydatetime(), int(last[1]),
                           shown[0].to_pydatetime(), int(shown[1])))
        yield pd.DataFrame({"page_id": [key[0]], "status": [status], "progress": [progress], "error": [error],
                            "attempts": [attempts]})

    def close(self) -> None:
        pass


def page_state_stream(events: DataFrame) -> DataFrame:
    """Current state of each page after every batch that brought events for it (update mode)."""
    kind = events.schema["page_id"].dataType.simpleString()
    return events.groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=PageState(), outputStructType=f"page_id {kind}, {OUTPUT}", outputMode="Update", timeMode="None")
