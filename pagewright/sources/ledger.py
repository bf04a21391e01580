"""Tables whose versions become visible in one step, and work that is done once.

A unit of work (a micro-batch, a run) makes several results. Each is written to
a folder of its own, and then a row in the ledger says that it is whole; when
all of them are, one closing row makes the unit visible. Readers take the
folders of closed units only, so half a unit is never seen, whatever breaks. A
unit that is started again reads the results that its ledger rows name and does
only the rest; a closed unit does nothing. Data and ledger are Parquet written
by Spark, so any store that Spark writes will do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .files import path_exists

ENTRY = "unit string, step string, folder string, replaces boolean, at long"
CLOSED = ""  # the step name of a closing row


class Ledger:
    """The ledger of one folder. It has a row per result and unit, which the driver reads; `compact` shortens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _entries(self) -> list:
        """Rows in the order they were written; of two attempts at one result the first counts, for all readers alike."""
        if not path_exists(self.spark, f"{self.path}/ledger"):
            return []
        rows = sorted(self.spark.read.schema(ENTRY).parquet(f"{self.path}/ledger").collect(), key=lambda r: (r["at"], r["folder"] or ""))
        first: dict[tuple[str, str], object] = {}
        for r in rows:
            first.setdefault((r["unit"], r["step"]), r)
        return list(first.values())

    def _note(self, unit: str, step: str, folder: str | None, replaces: bool = False) -> None:
        row = self.spark.createDataFrame([(unit, step, folder, replaces, time.time_ns())], ENTRY)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def _drop(self, folder: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def step(self, unit: str, name: str, build: Callable[[], DataFrame], replaces: bool = False) -> DataFrame:
        """The unit's result `name`: what the ledger names, else what `build` gives, written before it is used.

        A write that fails leaves no draft and no row.
        """
        if name == CLOSED:
            raise ValueError("a result needs a name")
        for r in self._entries():
            if (r["unit"], r["step"]) == (unit, name):
                return self.spark.read.parquet(r["folder"])
        folder = f"{self.path}/{name}/{unit}-{uuid.uuid4().hex}"
        try:
            build().write.parquet(folder)
        except Exception:
            self._drop(folder)
            raise
        self._note(unit, name, folder, replaces)
        return self.spark.read.parquet(folder)

    def closed(self, unit: str) -> bool:
        return any((r["unit"], r["step"]) == (unit, CLOSED) for r in self._entries())

    def close(self, unit: str) -> None:
        """Makes all results of the unit visible at once. Closing twice changes nothing."""
        if not self.closed(unit):
            self._note(unit, CLOSED, None)

    def publish(self, unit: str, results: dict[str, DataFrame], replaces: bool = False) -> None:
        """All results of a unit, then the closing row. `replaces`: readers no longer see what came before."""
        if self.closed(unit):
            return
        for name, df in results.items():
            self.step(unit, name, lambda df=df: df, replaces)
        self.close(unit)

    def folders(self, name: str) -> list[str]:
        """The folders of `name` in closed units, oldest unit first, from the last one that replaces on."""
        entries = self._entries()
        order = {r["unit"]: r["at"] for r in entries if r["step"] == CLOSED}
        mine = sorted((r for r in entries if r["step"] == name and r["unit"] in order), key=lambda r: order[r["unit"]])
        last = max((i for i, r in enumerate(mine) if r["replaces"]), default=0)
        return [r["folder"] for r in mine[last:]]

    def read(self, name: str) -> DataFrame | None:
        """All visible rows of `name`; None if no closed unit has any. Columns that an older unit lacks are null."""
        frames = [self.spark.read.parquet(f) for f in self.folders(name)]
        if not frames:
            return None
        if all(f.schema == frames[0].schema for f in frames):
            return self.spark.read.schema(frames[0].schema).parquet(*self.folders(name))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def compact(self, name: str, unit: str, newest: Callable[[DataFrame], DataFrame]) -> None:
        """One unit with `newest` of all visible rows replaces the units of `name` so far. Old folders stay for readers that have begun."""
        rows = self.read(name)
        if rows is not None:
            self.publish(unit, {name: newest(rows)}, replaces=True)
