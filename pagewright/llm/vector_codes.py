"""Vectors as short codes: one byte per part, the nearest entry of that part's codebook.

Components become integers, so rounds, ties and results do not depend on the
layout of the table. Distances are not taken vector by vector: a batch gets a
dictionary of distinct integers per dimension, the squared differences of every
dictionary value to all entries are tabulated, and a part's distances are the
sum of the table rows its dictionary codes point at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
ROWS_AT_ONCE = 1024  # rows whose distances to all entries are in memory at once
NO_ENTRY = -1


def _limit(width: int) -> int:
    """Largest scaled component: the squared differences of a part of this width still sum below 2^62."""
    return 1 << (61 - max(width - 1, 0).bit_length()) // 2 - 1


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): floor(1024 x) of every component, for rows whose vector is complete and finite.

    Rows with a null vector or a null, NaN or infinite component go.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().cast(pa.float64())
            good = np.isfinite(values.to_numpy(zero_copy_only=False))  # a null becomes NaN
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = np.asarray(lists.is_valid()) & (bad[ends] == bad[ends - lengths])
            scaled = np.floor(SCALE * np.where(good, values.to_numpy(zero_copy_only=False), 0.0))
            whole = np.clip(scaled, -float(1 << 62), float(1 << 62)).astype(np.int64)[np.repeat(keep, lengths)]
            offsets = np.concatenate([[0], np.cumsum(lengths[keep])]).astype(np.int32)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))], ["vec_id", "label", "v"])

    chosen = vectors.select("vec_id", "label", vector)
    kinds = [chosen.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return chosen.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, v array<long>")


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, code of every row)."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 4 * len(column):
        return np.unique(column, return_inverse=True)
    present = np.zeros(span, bool)
    present[column - low] = True
    return np.flatnonzero(present) + low, (np.cumsum(present) - 1)[column - low]


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for every row; the lower index on ties."""
    reach = max(int(np.abs(part).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if part.shape[1] * (2 * reach) ** 2 < 1 << 31 else np.int64
    tables, codes = [], []
    for j in range(part.shape[1]):
        values, code = dictionary(part[:, j])
        tables.append(((values[:, None] - entries[None, :, j]) ** 2).astype(kind))
        codes.append(code)
    index, distance = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for at in range(0, len(part), ROWS_AT_ONCE):
        here = slice(at, min(at + ROWS_AT_ONCE, len(part)))
        total = np.zeros((here.stop - at, len(entries)), kind)
        for table, code in zip(tables, codes):
            total += table[code[here]]
        index[here] = total.argmin(axis=1)
        distance[here] = total[np.arange(len(total)), index[here]]
    return index, distance


def _parts(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """The batch's vectors as PARTS arrays of shape (rows, width)."""
    flat = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
    spare = PARTS * width - flat.shape[1]
    flat = np.clip(np.pad(flat, ((0, 0), (0, spare))), -_limit(width), _limit(width))
    return [flat[:, p * width:(p + 1) * width] for p in range(PARTS)]


def _sums(vectors: DataFrame, books: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (rows, componentwise sums)}. Every task adds up its own rows first; what comes to the
    driver has at most PARTS * ENTRIES * width rows."""

    def run(batches):
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        sums = np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, part in enumerate(_parts(batch, width)):
                index = nearest(part, books[p])[0]
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                counts[p, used] += n
                if width:
                    sums[p, used] += np.add.reduceat(part[order], first, axis=0)
        p, e = np.nonzero(counts)
        values = [[int(counts[i, j]), *sums[i, j].tolist()] for i, j in zip(p, e)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(values, pa.list_(pa.int64()))], ["part", "entry", "x"])

    partial = vectors.select("v").mapInArrow(run, "part int, entry int, x array<long>")
    rows = partial.select("part", "entry", F.posexplode("x").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        out.setdefault((r["part"], r["entry"]), {})[r["at"]] = int(r["x"])
    return {k: (x[0], [x[j + 1] for j in range(width)]) for k, x in out.items()}


def first_books(vectors: DataFrame) -> tuple[list[np.ndarray], int, int]:
    """(codebooks, width of a part, length of a vector) from the vectors of the smallest ids, ascending."""
    by_id = vectors.where(F.col("vec_id").isNotNull())
    head = by_id.orderBy("vec_id", "v").limit(1).select(F.size("v")).collect()
    if not head:
        return [], 0, 0
    length = head[0][0]
    width = -(-length // PARTS)
    by_id, ids = by_id.where(F.size("v") == length), []
    while len(ids) < ENTRIES:  # one pass, more only where an id has many rows
        more = by_id.where(F.col("vec_id") > F.lit(ids[-1])) if ids else by_id
        found = more.select("vec_id").orderBy("vec_id").limit(ENTRIES - len(ids)).collect()
        if not found:
            break
        ids += sorted({r[0] for r in found})
    least = by_id.where(F.col("vec_id") <= F.lit(ids[-1])).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    start = [list(r["v"]) + [0] * (PARTS * width - length) for r in least]
    limit = _limit(width)
    flat = np.clip(np.array(start, np.int64).reshape(len(start), PARTS * width), -limit, limit)
    return [flat[:, p * width:(p + 1) * width].copy() for p in range(PARTS)], width, length


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int, int]:
    """Codebooks after `rounds` rounds over all vectors of `whole_vectors`; they hold ENTRIES times the length numbers."""
    books, width, length = first_books(vectors)
    fitting = vectors.where(F.size("v") == length)
    for _ in range(rounds if books else 0):
        for (p, e), (n, totals) in _sums(fitting, books, width).items():
            books[p][e] = [x // n for x in totals]
    return books, width, length


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per kept row.

    Rows without a complete, finite vector go. The length is that of the vector
    of the smallest id; rows of another length go, as no codebook fits them. A
    length that PARTS does not divide is filled up with zeros. An id that
    repeats gives one start entry, its smallest vector; every row is encoded.
    A row without an id is encoded and counts in the means, but gives no start
    entry; if no row has an id, there are no codebooks and no rows. Components
    whose squares would not fit 63 bits in a part's distance are clipped to the
    largest that do. A label's error beyond 63 bits is null. No rows in, none
    out; other columns are ignored.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    whole = whole_vectors(vectors, vector).checkpoint()  # read by every round
    books, width, length = fit(whole, rounds)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.full(batch.num_rows, "", f"U{2 * PARTS}"), np.zeros(batch.num_rows, np.int64)
            for part, book in zip(_parts(batch, width), books):
                index, distance = nearest(part, book)
                code = np.char.add(code, hexes[index])
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = [whole.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    fitting = whole.where(F.size("v") == length) if books else whole.limit(0)
    coded = fitting.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long").checkpoint()
    errors = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return coded.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
