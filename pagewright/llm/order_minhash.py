"""Order MinHash fingerprints: minima of numbered k-mers, kept in text order.

A text's k-mers are runs of K words; the n-th occurrence of a k-mer is a k-mer
of its own. For each of M hash functions the L k-mers of least hash are taken,
put back into text order and hashed together. Texts agree in a position of the
fingerprint about as often as they share k-mers in the same order, so moving
text costs likeness where a plain MinHash sees no difference.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import strings

K = 3  # words in a k-mer
L = 2  # k-mers in a tuple
M = 64  # tuples in a fingerprint
SLOTS_PER_PARTITION = 4
KMERS_AT_ONCE = 1 << 13
_MIX = np.uint64(0x9E3779B97F4A7C15)
_A = (np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, M, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, M, dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def kmers(text: bytes) -> np.ndarray:
    """Hashes of the numbered k-mers in text order. Fewer than K words are one k-mer, no word none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(K, len(words))
    h = own[:len(own) - k + 1].copy()
    for i in range(1, k):
        h = _scramble(h * _MIX + own[i:len(own) - k + 1 + i])
    # Occurrence numbers: position inside the run of equal values after a stable sort.
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    if not first.all():
        at = np.arange(len(s))
        number = np.empty(len(s), np.uint64)
        number[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        h = _scramble(h + number * _MIX)
    return h


def sketch(text: bytes) -> np.ndarray:
    """M 32-bit values; all zero for a text without words."""
    h = kmers(text)
    if not len(h):
        return np.zeros(M, np.uint32)
    rows, top = np.arange(M), np.iinfo(np.uint64).max
    best = np.full((M, L), top, np.uint64)
    where = np.zeros((M, L), np.int64)
    for at in range(0, len(h), KMERS_AT_ONCE):
        part = h[at:at + KMERS_AT_ONCE]
        mixed = part[None, :] * _A[:, None] + _B[:, None]
        low, least = [], []
        for _ in range(min(L, len(part))):
            i = mixed.argmin(axis=1)
            low.append(i + at)
            least.append(mixed[rows, i])
            mixed[rows, i] = top
        values = np.concatenate([best, np.array(least).T], axis=1)
        places = np.concatenate([where, np.array(low).T], axis=1)
        order = np.argsort(values, axis=1, kind="stable")[:, :L]
        best, where = np.take_along_axis(values, order, axis=1), np.take_along_axis(places, order, axis=1)
    n = min(L, len(h))
    where = np.sort(where[:, :n], axis=1)  # text order
    out = np.full(M, n, np.uint64)
    for i in range(n):
        out = _scramble(out * _MIX + h[where[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Between 0 and 1: the share of equal tuples to the power 1 / L, near the share of common k-mers.
    Equal fingerprints have likeness 1."""
    return float(np.mean(a == b) ** (1 / L))


def text_of(sketch_: np.ndarray) -> str:
    return sketch_.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of `following`."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _in_order(doc_id):
    """An id as Spark sorts it: texts by their bytes."""
    return doc_id.encode() if isinstance(doc_id, str) else doc_id


def _bounds(docs: DataFrame, slots: int) -> np.ndarray | list:
    """Ends of `slots` ranges of ids: quantiles of numbers; of ids of any other type, those of a sample in hash order
    of about ten ids a range, which is what the driver gets."""
    if isinstance(docs.schema["doc_id"].dataType, NumericType):
        share = [i / slots for i in range(1, slots)]
        cuts = docs.select(F.percentile_approx("doc_id", F.array(*map(F.lit, share)) if share else F.array(F.lit(0.5)), 10 * slots).alias("c")).first()["c"]
        return np.unique(np.array([c for c in (cuts or []) if c is not None]))
    drawn = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("_h")).orderBy("_h").limit(10 * slots).collect()
    found = sorted(_in_order(r["doc_id"]) for r in drawn)
    return sorted({found[i * len(found) // slots] for i in range(1, slots)}) if found else []


def neighbouring(docs: DataFrame, slots: int) -> DataFrame:
    """(doc_id, text, slot, extra): rows cut into `slots` ranges of ids, each with the first row of the
    next range as an extra row at its end, and the last with the very first.

    Ids are numbers, texts or dates; see `_bounds` for what is sent to the driver.
    """
    bounds = _bounds(docs, slots)

    @F.arrow_udf("long")
    def slot(ids: pa.Array) -> pa.Array:  # the range of an id; null ids come first
        if isinstance(bounds, np.ndarray):
            places = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, places), pa.int64())
        return pa.array([0 if i is None else bisect_right(bounds, _in_order(i)) for i in ids.to_pylist()], pa.int64())

    placed = docs.select("doc_id", "text", slot("doc_id").alias("slot"))
    at = F.struct(F.col("doc_id").isNotNull().alias("n"), F.col("doc_id").alias("i"))
    ranges = docs.select("doc_id", slot("doc_id").alias("slot")).groupBy("slot").agg(F.min(at).alias("first"))
    one = Window.partitionBy(F.lit(0)).orderBy("slot")  # one row per range: at most `slots`
    ranges = ranges.withColumn("before", F.coalesce(F.lag("slot").over(one), F.max("slot").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = ranges.select(F.col("first.i").alias("_id"), F.col("first.n").alias("_n"), "before")
    # At most `slots` ids, so they may be sent to every task.
    extra = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")))
    extra = extra.select("doc_id", "text", F.col("before").alias("slot"), F.lit(True).alias("extra"))
    return placed.withColumn("extra", F.lit(False)).unionByName(extra)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document row.

    The next document is the one with the next larger id (null ids come first);
    rows that repeat an id follow each other in the order of their texts. The
    last one's next is the first; a single document is its own next. Null texts
    count as empty. An empty table gives no rows; other columns are ignored.
    Texts are shuffled once, in ranges of ids that are sorted by the tasks.
    """
    spark = docs.sparkSession
    slots = SLOTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # (doc_id, text, slot, extra, sketch) of the row before
        rows: list[tuple] = []
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text, slot, extra in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")),
                                                 batch.column("slot").to_pylist(), batch.column("extra").to_pylist()):
                if held is not None and held[2] == slot and held[3] and extra:
                    continue  # of rows that repeat the first id of a range, the first one is the neighbour
                own = sketch(text.encode())
                if held is not None and held[2] == slot and not held[3]:
                    changed = edited(held[1], text).encode()
                    other = sketch(changed)
                    rows.append((held[0], len(held[1]), hashlib.sha256(changed).hexdigest(), text_of(held[4]), text_of(other),
                                 likeness(held[4], other), likeness(held[4], own)))
                held = (doc_id, text, slot, extra, own)
            if rows:
                columns = list(zip(*rows))
                types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                rows = []

    placed = neighbouring(chosen, slots)
    return (placed.repartition("slot").sortWithinPartitions("slot", "extra", "doc_id", "text")
            .mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
