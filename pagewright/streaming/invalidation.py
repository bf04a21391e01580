"""Erased pictures that are out of date, from a stream of block lists (needs the RocksDB state store)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHAPE = ("xmin", "ymin", "xmax", "ymax", "type")


class Invalidation(StatefulProcessor):
    """Holds one digest per block of a page and compares each new list with it by position."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("blocks", "ordinal int", "digest string", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for ordinal, digest in zip(initialState["ordinal"], initialState["digest"]):
            if not pd.isna(ordinal):
                self.known.updateValue((int(ordinal),), (digest,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, new = None, {}
        for frame in rows:  # of several lists in one batch the newest counts
            for version, ordinal, digest in zip(frame["version"], frame["ordinal"], frame["digest"]):
                if top is None or version > top:
                    top, new = version, {}
                if version == top and not pd.isna(ordinal):
                    new[int(ordinal)] = digest
        old = {k[0]: v[0] for k, v in self.known.iterator()}
        changed = [o for o in {*old, *new} if old.get(o) != new.get(o)]
        for o in changed:
            if o in new:
                self.known.updateValue((o,), (new[o],))
            else:
                self.known.removeKey((o,))
        if changed:
            yield pd.DataFrame({"page_id": [key[0]], "n_changed": [len(changed)]})

    def close(self) -> None:
        pass


def _digests(blocks: DataFrame) -> DataFrame:
    """Geometry and type of a block as one digest; fields are written out, so a null is not the same as a missing one."""
    fields = F.to_json(F.struct(*SHAPE), {"ignoreNullFields": "false"})
    return blocks.withColumn("digest", F.when(F.col("ordinal").isNotNull(), F.sha2(fields, 256)))


def stale_pages(lists: DataFrame, stored: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(page_id, n_changed): pages of a micro-batch whose block list differs by position from the one before, as `manifest.struct_diff` counts.

    `lists` is a stream of page_id, version, ordinal, the box and type: the
    whole new list of a page, or one row with a null ordinal for a page that has
    lost all its blocks. No stored table is read: what is known of a page is a
    digest per block in the state. `stored` (page_id, ordinal, box, type) fills
    it once when the query starts for the first time; a page the state does not
    know is stale. `ttl_ms` forgets blocks that no list has touched for so long,
    which makes a page of that age stale again.
    """
    kind = lists.schema["page_id"].dataType.simpleString()
    first = None if stored is None else _digests(stored).select("page_id", "ordinal", "digest").groupBy("page_id")
    return _digests(lists).select("page_id", "version", "ordinal", "digest").groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=Invalidation(ttl_ms), outputStructType=f"page_id {kind}, n_changed long", outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime", initialState=first)
