"""Edit and progress streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edits import DEBOUNCE
from ..operators.manifest import struct_diff


def with_watermark(edits: DataFrame, delay: str) -> DataFrame:
    """Edits later than `delay` are dropped; replays of one (page, seq) within it count once."""
    return edits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["page_id", "seq"])


def debounce_stream(edits: DataFrame, payload: str, gap: str = DEBOUNCE) -> DataFrame:
    """Streaming form of `operators.edits.debounce`: the last edit of each burst.

    Bursts are session windows, reduced per batch before the shuffle. A burst
    comes out when the watermark passes its end, so the last one of a finished
    stream waits for more data.
    """
    sessions = edits.groupBy("page_id", F.session_window("ts", gap).alias("_w")).agg(
        F.max_by(F.struct("seq", payload), F.struct("ts", "seq")).alias("_last"))
    return sessions.select("page_id", F.col("_w.end").alias("fire_at"), "_last.seq", F.col(f"_last.{payload}"))


def invalidate_erased(new_blocks: DataFrame, stored_blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Pages of a micro-batch whose erased picture is out of date: page_id, n_changed.

    For use inside foreachBatch. The stored side is cut to the pages of the
    batch. `pages` lists them where some have lost all their blocks; without it
    only pages that still have a block are seen.
    """
    touched = (pages if pages is not None else new_blocks).select("page_id").distinct()
    old = stored_blocks.join(touched, "page_id", "left_semi")
    return struct_diff(old, new_blocks).where("is_stale").select("page_id", "n_changed")
