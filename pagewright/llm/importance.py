"""Importance resampling: documents drawn by how like a target their words are.

Every feature falls into a bucket; a bucket's gain is the logarithm of its share
in the target texts over its share in all documents. Gains are one array, so a
text's weight is a mean of array elements, and Gumbel noise from a hash of the
id turns the best scores into a weighted draw without replacement.

Exact ranks come from sorting by regular sampling. Tasks sort their rows; rows
at regular distances in these runs give splitters; every row goes to its
segment, which merges what it gets from the runs; the counts of the segments
before give the first rank of each.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import utf8

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SAMPLES_PER_SEGMENT = 32
TEXT_AT_ONCE = 1 << 20
# Words are runs of ASCII letters, digits and all other characters above ASCII; A-Z count as a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _stretches(text: bytes):
    """A text in stretches of bounded length, cut between words."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > TEXT_AT_ONCE:
            end = text.rfind(b" ", at, at + TEXT_AT_ONCE)
            end = text.find(b" ", at + TEXT_AT_ONCE) if end < 0 else end
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def buckets(text: bytes) -> np.ndarray:
    """The bucket of every feature: all words, then all pairs of neighbours.

    A pair's checksum goes on from that of its first word, so no pair is put together.
    """
    words, singles = [], []
    pairs: list[int] = []
    for stretch in _stretches(text.translate(_TABLE)):
        before = singles[-1:]  # the pair across a cut
        words = stretch.split()
        found = list(map(zlib.crc32, words))
        follows = (before + found)[:len(before) + len(found) - 1]
        pairs += map(zlib.crc32, [b" " + w for w in (words if before else words[1:])], follows)
        singles += found
    return (np.fromiter(chain(singles, pairs), np.uint32, len(singles) + len(pairs)) % BUCKETS).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket over the whole table. Every task adds up its own; BUCKETS numbers come to the driver."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in utf8(batch.column("text")):
                counts += np.bincount(buckets(text), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of every bucket, both shares smoothed by one."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: str) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{SEED}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight, score) of every row."""

    def run(batches):
        for batch in batches:
            sizes, weights, scores = [], [], []
            for text, name in zip(utf8(batch.column("text")), batch.column("_name").to_pylist()):
                found = buckets(text)
                sizes.append(len(found))
                weights.append(int(gain[found].sum()) // len(found) if len(found) else 0)
                scores.append(weights[-1] + noise(name))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, weights, scores))],
                                             ["doc_id", "n_features", "weight", "score"])

    chosen = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_features long, weight long, score long")


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """The order of the draw: high scores, then small ids; what is equal in both goes by size and place, so that no key repeats."""
    return [(-s, i is None, i, n, at) for s, i, n, at in zip(*(batch.column(c).to_pylist() for c in ("score", "doc_id", "n_features", "_at")))]


def ranked(scored: DataFrame, eligible: str, segments: int) -> tuple[DataFrame, int]:
    """(the eligible rows with `rank`, the other rows with a null rank, how many are eligible), as one table.

    Keys are distinct, so segments are even whatever repeats. The driver gets one
    number per run and per segment and about SAMPLES_PER_SEGMENT keys per segment.
    """
    columns = scored.columns
    rows = scored.withColumn("_in", F.expr(eligible)).sortWithinPartitions(F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features") \
        .withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    runs = rows.where("_in")
    total = runs.count()
    stride = max(1, total // (segments * SAMPLES_PER_SEGMENT))
    regular = runs.where((F.col("_at").bitwiseAND((1 << 33) - 1)) % stride == stride // 2)
    sample = sorted((-r["score"], r["doc_id"] is None, r["doc_id"], r["n_features"], r["_at"]) for r in regular.select("score", "doc_id", "n_features", "_at").collect())
    splitters = [sample[i * len(sample) // segments] for i in range(1, segments)] if sample else []

    def assign(batches):
        for batch in batches:
            yield batch.append_column("segment", pa.array([bisect_left(splitters, k) for k in _keys(batch)], pa.int32()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    placed = runs.select(*columns, "_at").mapInArrow(assign, f"{kinds}, _at long, segment int")
    sizes = {r["segment"]: r["count"] for r in placed.groupBy("segment").count().collect()}
    before = [0, *accumulate(sizes.get(s, 0) for s in range(segments))]

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = _keys(table)
        order = sorted(range(len(keys)), key=keys.__getitem__)  # runs that are sorted already are merged
        first = before[table.column("segment")[0].as_py()]
        return table.take(pa.array(order, pa.int64())).select(columns).append_column("rank", pa.array(range(first + 1, first + 1 + len(order)), pa.int64()))

    inside = placed.groupBy("segment").applyInArrow(merge, f"{kinds}, rank long")
    return inside.unionByName(rows.where("NOT _in").select(*columns, F.lit(None).cast("long").alias("rank"))), total


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of `docs`; `rank` is null where a row is not drawn.

    Null and empty texts have no features, weight 0, and cannot be drawn.
    Repeated rows are drawn one by one, rows of one id and equal score by their
    number of features. A null id has noise as an empty text and comes after
    all ids of its score. An empty target gives a gain to rare buckets only; no
    documents give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, eligible = ranked(score(docs, gain), f"n_features >= {2 * min_words - 1}", segments)
    drawn = percent * eligible // 100
    return rows.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
