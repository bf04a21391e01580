"""Helpers of the corpus operators: folds, bounded labelled samples, Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# A training sample takes at most this many pieces of a text, spread evenly
# over all of it, so that the sample's bytes are bounded whatever the texts are.
SAMPLE_PIECES = 4
SAMPLE_PIECE_BYTES = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids whose crc32 leaves 1 modulo 3; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def agreed_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): training ids labelled 0 or 1. An id with contradictory labels is left out."""
    return (labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_top"))
            .where((F.col("label") == F.col("_top")) & ~held_out()).drop("_top"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label) of at most `per_class` training documents per label 0 and 1.

    Ids are taken in hash order, so the choice does not depend on the layout of
    the tables. Only ids are shuffled; the limit is applied in every task before
    rows meet.
    """
    agreed = agreed_labels(labels, label).join(docs.select("doc_id"), "doc_id", "left_semi")
    parts = [agreed.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)]
    return parts[0].unionByName(parts[1])


def spread_pieces(data: bytes, pieces: int = SAMPLE_PIECES, size: int = SAMPLE_PIECE_BYTES) -> list[bytes]:
    """The whole text in blocks if it has few, else evenly spaced blocks of it."""
    blocks = [data[at:at + size] for at in range(0, len(data), size)]
    if len(blocks) <= pieces:
        return blocks
    return [blocks[i * (len(blocks) - 1) // (pieces - 1)] for i in range(pieces)]


def sample_texts(docs: DataFrame, chosen: DataFrame, key: str) -> list[tuple[object, int, list[bytes]]]:
    """(key value, doc_id, pieces) of the chosen ids, in a fixed order. `chosen` is bounded by its limit.

    An id with many rows gives one of its texts, the one of least hash, so that the rows that are collected are bounded too.
    """

    def pieces(batches):
        for batch in batches:
            rows = [spread_pieces(x) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(key), batch.column("_h"), pa.array(rows, pa.list_(pa.binary()))], ["doc_id", key, "_h", "pieces"])

    wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).join(F.broadcast(chosen.select("doc_id", key).distinct()), "doc_id")
    kind = wanted.schema[key].dataType.simpleString()
    id_kind = wanted.schema["doc_id"].dataType.simpleString()
    cut = wanted.mapInArrow(pieces, f"doc_id {id_kind}, {key} {kind}, _h long, pieces array<binary>")
    rows = cut.groupBy("doc_id", key).agg(F.min_by("pieces", "_h").alias("pieces")).collect()
    return sorted(((r[key], r["doc_id"], [bytes(x) for x in r["pieces"]]) for r in rows), key=lambda x: (str(x[0]), str(x[1]), x[2]))


class Rounds:
    """Tables of a loop in the shared checkpoint folder.

    A table replaces the one before it of the same name, so a loop holds the disk
    of one round, however many it takes. As files they have a measured size, by
    which Spark joins small ones without a shuffle and reads many in one task.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.places, self.written = spark, {}, 0
        self.folder = f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """`df` as a table of its own; frames on the one before it can't be read any more."""
        place = f"{self.folder}/{name}-{self.written}"
        self.written += 1
        df.write.parquet(place)
        self.drop(name)
        self.places[name] = place
        return self.spark.read.schema(df.schema).parquet(place)

    def drop(self, *names: str) -> None:
        for place in (self.places.pop(name, None) for name in names):
            if place:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @contextmanager
    def freed(self) -> Iterator[None]:
        """Queries made inside free the files of their shuffles when they end, not when the driver next collects its garbage."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)


def slices(batch: pa.RecordBatch, rows: int = 1024):
    """A batch in parts, so that the Python copies of few texts are alive at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Texts as str; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


class Recent(dict):
    """A dictionary of two generations, whose bound affects time only.

    `missing` first makes a full young generation the old one, brings back
    those of its keys that the old one has, and returns the rest, which the
    caller adds. So all keys of one call are there until the next call.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> set:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        fresh = keys.difference(self)
        if self.old and fresh:
            back = fresh.intersection(self.old)
            self.update((k, self.old[k]) for k in back)
            fresh -= back
        return fresh

    def forget(self, keys) -> None:
        for k in keys:
            self.pop(k, None)
