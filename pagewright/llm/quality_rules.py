"""Base counts of a text, and a likelihood ratio of hashed n-grams against the corpus.

The raw multinomial counts the hashed byte 4-grams of all documents; the target
multinomial those of the trusted texts, all that are labelled good in the
training fold: one half of them, by a hash of the id. The log ratio of the two,
averaged over a text's n-grams, is held against one threshold for every
document, an exact quantile over the other half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import row_numbers
from ..session import ensure_checkpoint_dir
from .common import agreed_labels, utf8

BUCKETS = 1 << 14
PART_BUCKETS = 256  # buckets that are summed in one group
GRAM = 4  # bytes
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SMOOTHING = 1.0
LOST_GOOD = 0.002  # share of the trusted texts that may fall below the threshold
BYTES_AT_ONCE = 1 << 22


@dataclass(frozen=True, eq=False)
class RatioModel:
    ratio: np.ndarray  # BUCKETS, log target - log raw
    threshold: float


def gram_counts(text: bytes) -> np.ndarray:
    """Hashed n-gram counts; a text shorter than an n-gram has none."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(text) - GRAM + 1), BYTES_AT_ONCE):
        b = np.frombuffer(text[at:at + BYTES_AT_ONCE + GRAM - 1], np.uint8).astype(np.uint32)
        grams = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        total += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def mean_ratio(text: bytes, ratio: np.ndarray) -> float:
    counts = gram_counts(text)
    n = int(counts.sum())
    return float(counts @ ratio / n) if n else 0.0


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
    n = len(known)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]  # numbered anew, so that no product overflows
    _, window, times = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i:len(words) - 2 + i] |= again
    return int(inside.sum())


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """n-gram counts of all documents. A task sends its BUCKETS sums in arrays of PART_BUCKETS, the driver receives BUCKETS."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in utf8(batch.column("text")):
                total += gram_counts(text)
        if total.any():
            yield sums(range(BUCKETS // PART_BUCKETS), total.reshape(-1, PART_BUCKETS))

    def sums(parts, rows):
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(list(rows), pa.list_(pa.int64()))], ["part", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        of_tasks = rows.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, PART_BUCKETS)
        return pa.Table.from_batches([sums([rows.column("part")[0].as_py()], [of_tasks.sum(axis=0)])])

    out = np.zeros((BUCKETS // PART_BUCKETS, PART_BUCKETS), np.float64)
    kind = "part int, sums array<long>"
    for row in docs.select("text").mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect():
        out[row["part"]] = row["sums"]
    return out.ravel()


def fit(docs: DataFrame, labels: DataFrame) -> RatioModel:
    """Raw counts of all of `docs`; target counts and threshold of all trusted texts, whole.

    Without trusted texts nothing is rejected. The driver receives BUCKETS sums
    per side and two ratios. Texts meet their labels once, by a merge join at
    every size, as the labels grow with the documents.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    good = agreed_labels(labels, "quality").where("label = 1").select("doc_id")
    trusted = docs.select("doc_id", "text").hint("merge").join(good, "doc_id", "left_semi").checkpoint()
    target = corpus_counts(trusted.where(_builds()))
    if not target.any():
        return RatioModel(np.zeros(BUCKETS), float("-inf"))
    ratio = _log_share(target) - _log_share(corpus_counts(docs))
    rest = quantile(_long_ratios(trusted.where(~_builds()), ratio), LOST_GOOD)
    return RatioModel(ratio, 0.0 if rest is None else rest)


def _builds() -> Column:
    """Whether a trusted text builds the target; the others set the threshold."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def _log_share(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS))


def _long_ratios(texts: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(ratio) of the texts with LEAST_WORDS words or more."""

    def run(batches):
        for batch in batches:
            means = [mean_ratio(text, ratio) for text in utf8(batch.column("text")) if len(text.split()) >= LEAST_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array(means, pa.float64())], ["ratio"])

    return texts.select("text").mapInArrow(run, "ratio double")


def quantile(values: DataFrame, share: float) -> float | None:
    """The quantile of the one column, between its two neighbours in rank as numpy takes it; none of no rows."""
    value = values.columns[0]
    ranked = row_numbers(values, [], [value], "_n")
    at = share * (ranked.count() - 1)
    if at < 0:
        return None
    low, *high = [r[0] for r in ranked.where(F.col("_n").between(int(at) + 1, int(at) + 2)).orderBy("_n").select(value).collect()]
    return low + (high[0] - low) * (at - int(at)) if high else low


def judge(docs: DataFrame, model: RatioModel) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept), one row per document row.

    A null text has no words and fails; so does an empty one. Repeated rows are
    judged alike; null ids are kept; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                counts = base_counts(text)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > 50 * counts[0]
                ratio = mean_ratio(text, model.ratio)
                rows.append((*counts, failed, ratio, not failed and ratio >= model.threshold))
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
                             "n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean")
