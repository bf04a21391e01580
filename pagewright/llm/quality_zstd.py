"""Quality from compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks, each block is compressed once with either
dictionary, and the difference of the two sizes over the size of the text says
which kind it resembles. Blocks keep a long text from explaining itself, so the
dictionaries matter as much at its end as at its start. A logistic curve fitted
on labelled texts that built no dictionary turns the difference into a score.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import SAMPLE_PIECES, held_out, labelled, sample_texts, utf8

BLOCK = 2048
LEVEL = 3
DICT_BYTES = 384 * 1024
SAMPLE_PER_CLASS = 3000  # bound of the labelled sample


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


@functools.lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    made = []
    for content in (good, bad):
        packed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packed.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=packed, write_content_size=False, write_dict_id=False))
    return made


def features(data: bytes, good: bytes, bad: bytes) -> tuple[float, ...]:
    """The size difference (bad - good) over the length and over both sizes, the first weighted by the
    evidence a text of this length carries, and the share of the text that is left after compression."""
    if not data:
        return 0.0, 0.0, 0.0, 0.5
    as_good, as_bad = _compressors(good, bad)
    blocks = [data[at:at + BLOCK] for at in range(0, len(data), BLOCK)]
    if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 2:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    if_good = sum(len(as_good.compress(b)) for b in blocks)
    if_bad = sum(len(as_bad.compress(b)) for b in blocks)
    gap, both = if_bad - if_good, if_bad + if_good
    return gap / len(data), gap / len(data) * min(1.0, (len(data) / BLOCK) ** 0.5), gap / both, both / len(data) / 2


def score_of(data: bytes, model: QualityModel) -> float:
    x = features(data, model.good, model.bad)
    z = float(np.dot(model.weights, (1.0, *x)))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps; the ridge keeps separable samples finite. Both classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + ridge * w
        hess = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Learns from a bounded labelled sample of the training fold.

    Every third sample text calibrates, the others fill the dictionaries. With
    no label of one kind the model is neutral: every score is 0.5.
    """
    chosen = labelled(docs, labels, "quality", per_class)
    texts: dict[int, list[list[bytes]]] = {0: [], 1: []}
    seen = set()
    for value, _, pieces in sample_texts(docs, chosen, "label"):
        content = b"".join(pieces)
        if content and content not in seen:  # a copy must not stand on both sides of the calibration
            seen.add(content)
            texts[value].append(pieces)
    return fit_texts(texts[1], texts[0])


def spread_share(pieces: list[bytes], share: int) -> bytes:
    """At most `share` bytes of a text: all of it, or equal parts at even distances from its start to its end."""
    content = b"".join(pieces)
    if len(content) <= share:
        return content
    size, gap = share // SAMPLE_PIECES, len(content) - share // SAMPLE_PIECES
    starts = [i * gap // (SAMPLE_PIECES - 1) for i in range(SAMPLE_PIECES)]
    return b"".join(content[at:at + size] for at in starts)


def fit_texts(good: list[list[bytes]], bad: list[list[bytes]]) -> QualityModel:
    if not good or not bad:
        return QualityModel(b"", b"", (0.0,) * 5)
    books = []
    for texts in (good, bad):
        build = [pieces for i, pieces in enumerate(texts) if i % 3 or len(texts) < 3]
        share = max(64, DICT_BYTES // len(build))
        # The same share of every text, so that one long text cannot fill a dictionary, and from all over the text.
        books.append(b"".join(spread_share(pieces, share) for pieces in build)[:DICT_BYTES])
    tests = [(pieces, y) for texts, y in ((good, 1), (bad, 0)) for i, pieces in enumerate(texts) if i % 3 == 0]
    x = np.array([features(b"".join(pieces), *books) for pieces, _ in tests])
    w = _logistic(x, np.array([y for _, y in tests]))
    return QualityModel(books[0], books[1], tuple(float(v) for v in w))


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row.

    Null and empty texts get the score of no evidence (difference 0). Repeated
    rows are scored one by one and alike. An empty table gives an empty result;
    other columns are ignored. A text is one value in one task, of any length.
    """

    def judge(batches):
        for batch in batches:
            scores = [score_of(x, model) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select("doc_id", "text").withColumn("held_out", held_out())
    return chosen.mapInArrow(judge, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches `least`, with all their columns."""

    def good(batches):
        for batch in batches:
            yield batch.filter(pa.array([score_of(x, model) >= least for x in utf8(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
