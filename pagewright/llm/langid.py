"""Language by nearest centroid over TF-IDF vectors of character n-grams.

A text becomes a unit vector of hashed 1-, 2- and 3-grams of its letters. Each
language has several centroids from spherical k-means over labelled texts; the
language of the centroid with the largest cosine wins. A text that lies further
from every centroid than nearly all training texts of its length is rejected.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, sample_texts, strings

DIMS = 1 << 14
CENTROIDS = 4
SAMPLE_PER_LANG = 600  # bound of the labelled sample
REJECT_QUANTILE = 0.001
REJECT_SLACK = 0.4
FEW_TEXTS = 20  # a length class with fewer texts sets its floor from parts of longer texts
PART_TEXTS, PARTS = 300, 4
SHARPNESS = 25.0
UNKNOWN = "und"
CHUNK = 1 << 20  # letters counted at once, so that a very long text needs bounded memory


@dataclass(frozen=True, eq=False)
class LangModel:
    langs: tuple[str, ...]
    idf: np.ndarray  # DIMS
    centroids: np.ndarray  # DIMS x n, unit columns
    owner: np.ndarray  # n, index into langs
    floors: np.ndarray  # lowest accepted cosine by length class


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """n-gram counts of the lower-cased letters; other characters are one space. None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint32)
    keep = letter | np.append(True, letter[:-1])
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    total = np.zeros(DIMS, np.int64)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    for at in range(0, len(points), CHUNK):
        p = points[max(0, at - 2):at + CHUNK]
        new = p[min(at, 2):]  # grams that end in this chunk
        total += np.bincount((new * np.uint32(2654435761)) >> shift, minlength=DIMS)
        if len(p) > 1:
            two = p[:-1] * np.uint32(40503) + p[1:] * np.uint32(2246822519)
            total += np.bincount((two[-len(new):] * np.uint32(2654435761)) >> shift, minlength=DIMS)
        if len(p) > 2:
            three = p[:-2] * np.uint32(3266489917) + p[1:-1] * np.uint32(668265263) + p[2:] * np.uint32(374761393)
            total += np.bincount((three[-len(new):] * np.uint32(2654435761)) >> shift, minlength=DIMS)
    return total


def _length_class(grams: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(grams, 1)).astype(int), 0, 15)


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first start, so that no chance is involved."""
    centres = [_units(rows.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.max(rows @ np.array(centres).T, axis=1).argmin()])
    centres = np.array(centres)
    for _ in range(rounds):
        owner = (rows @ centres.T).argmax(axis=1)
        centres = _units(np.array([rows[owner == i].mean(axis=0) if (owner == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def _dense(sparse: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows of (gram, count) pairs."""
    rows = np.zeros((len(sparse), DIMS), np.float32)
    for row, (at, n) in zip(rows, sparse):
        row[at] = np.log1p(n) * idf[at]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)  # in place
    return rows


def _near_of_parts(samples: list[tuple[str, str]], kind: int, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines to the nearest centroid of parts of the samples that have the length class `kind`.

    Parts are whole words from evenly spread places of evenly spread samples."""
    letters = max(1, (3 << kind) // 6)  # three n-grams a letter, the middle of the class
    near = []
    for _, text in samples[::max(1, len(samples) // PART_TEXTS)]:
        for i in range(PARTS):
            at = max(0, len(text) - letters) * i // PARTS
            at = text.find(" ", at) + 1 if at else 0
            end = text.find(" ", at + letters)
            part = text[at:] if end < 0 else text[at:end]
            if len(part) > 2 * letters + 8:  # a text without spaces
                part = part[:letters]
            c = counts(part)
            if c is not None and _length_class(c.sum()) == kind:
                where = np.flatnonzero(c)
                row = np.log1p(c[where]) * idf[where]
                near.append((row / np.linalg.norm(row) @ centroids[where]).max())
    return np.array(near)


def fit_texts(samples: list[tuple[str, str]]) -> LangModel:
    """A model from (lang, text) pairs; pairs without a letter teach nothing.

    Counts are held sparse; only one language at a time has dense vectors."""
    by_lang: dict[str, list] = {}
    df = np.zeros(DIMS, np.int64)
    for lang, text in samples:
        c = counts(text)
        if c is not None:
            at = np.flatnonzero(c)
            df[at] += 1
            by_lang.setdefault(lang, []).append((at.astype(np.uint16), c[at].astype(np.float32)))
    if not by_lang:
        return LangModel((), np.ones(DIMS, np.float32), np.zeros((DIMS, 0), np.float32), np.zeros(0, int), np.zeros(16))
    idf = np.log((1 + sum(map(len, by_lang.values()))) / (1 + df)).astype(np.float32) + 1
    langs = tuple(sorted(by_lang))
    parts = [_k_means(_dense(by_lang[lang], idf), CENTROIDS) for lang in langs]
    owner = np.concatenate([[i] * len(p) for i, p in enumerate(parts)]).astype(int)
    centroids = np.concatenate(parts).T.astype(np.float32)
    best = np.concatenate([(_dense(by_lang[lang], idf) @ centroids).max(axis=1) for lang in langs])
    kinds = _length_class(np.array([n.sum() for lang in langs for _, n in by_lang[lang]]))
    floors = np.zeros(16)
    for k in range(16):
        near = best[kinds == k]
        if len(near) < FEW_TEXTS:  # too few texts of this length: short parts of longer ones tell
            near = _near_of_parts(samples, k, idf, centroids)
        floors[k] = REJECT_SLACK * np.quantile(near, REJECT_QUANTILE) if len(near) >= FEW_TEXTS else floors[k - 1] if k else 0.0
    return LangModel(langs, idf, centroids, owner, floors)


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LangModel:
    """Learns from at most `per_lang` training texts of every non-null language.

    Ids are taken in hash order, each once. Languages are counted first, and of a large
    one only the ids in the lowest part of the hash range, about four times the
    limit, are ranked: what meets in one task does not grow with the table.
    """
    ids = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out()).distinct().withColumn("_h", F.xxhash64("doc_id"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("_all"))
    low = F.shiftrightunsigned("_h", 1) <= F.lit(4.0 * per_lang) / F.col("_all") * float(1 << 63)
    by_hash = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ranked = ids.join(F.broadcast(sizes), "lang").where(low).withColumn("_n", F.row_number().over(by_hash))  # one size per language
    chosen = ranked.where(F.col("_n") <= per_lang).select("doc_id", "lang")
    rows = sample_texts(docs, chosen, "lang")
    return fit_texts([(lang, b"".join(pieces).decode("utf-8", "ignore")) for lang, _, pieces in rows])


def classify(texts: list[str], model: LangModel) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of every text."""
    langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not model.langs:
        return langs, scores, rejected
    for at in range(0, len(texts), 64):
        found = [(i, c) for i in range(at, min(at + 64, len(texts))) if (c := counts(texts[i])) is not None]
        if not found:
            continue
        tf = np.array([c for _, c in found], np.float32)
        near = _units(np.log1p(tf) * model.idf) @ model.centroids
        best = near.max(axis=1)
        by_lang = np.array([near[:, model.owner == i].max(axis=1) for i in range(len(model.langs))]).T
        odds = np.exp(SHARPNESS * (by_lang - by_lang.max(axis=1, keepdims=True)))
        pick = by_lang.argmax(axis=1)
        share = odds.max(axis=1) / odds.sum(axis=1)
        low = best < model.floors[_length_class(tf.sum(axis=1))]
        for (i, _), p, s, r in zip(found, pick, share, low):
            langs[i], scores[i], rejected[i] = model.langs[p], float(s), bool(r)
    return langs, scores, rejected


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per document row.

    A null text or one without a letter is `und` with score 0 and is rejected.
    So is every text if there was nothing to learn from. Equal cosines go to
    the language that sorts first. Repeated rows are judged alike; an empty
    table gives an empty result; other columns are ignored.
    """

    def judge(batches):
        for batch in batches:
            langs, scores, rejected = classify(strings(batch.column("text")), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    chosen = docs.select("doc_id", "text").withColumn("held_out", held_out())
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LangModel) -> DataFrame:
    """The documents that are not rejected, with all their columns."""

    def known(batches):
        for batch in batches:
            rejected = classify(strings(batch.column("text")), model)[2]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
