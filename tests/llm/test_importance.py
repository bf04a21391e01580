import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from pagewright.llm import importance

from .conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]], len(words)


def plain(docs, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank); docs are (doc_id, text) with different ids."""
    found = {i: plain_buckets(t) for i, t in docs}
    s = Counter(b for x, _ in found.values() for b in x)
    t = Counter(b for text in target for b in plain_buckets(text)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (big_s + 10000) / ((s[i] + 1) * (big_t + 10000)))) for i in range(10000)]
    out = {}
    for i, (x, _) in found.items():
        weight = math.floor(sum(gain[b] for b in x) / len(x)) if x else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = (len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted((i for i, (_, n) in found.items() if n >= least), key=lambda i: (-out[i][2], i))
    ranks = {i: k + 1 for k, i in enumerate(order[:percent * len(order) // 100])}
    return sorted((i, *out[i], ranks.get(i)) for i in out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_draw_matches_plain_python(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert rows(importance.resample(docs, target)) == want


@pytest.mark.parametrize("size", [7, 60])
def test_stretches_lose_no_pair(monkeypatch, size):
    monkeypatch.setattr(importance, "TEXT_AT_ONCE", size)
    for text in ["Größe is-not the ONE; a b c", "x" * 100 + " y", "", " ", "a", "é" * 50, "one two three " * 30]:
        assert sorted(importance.buckets(text.encode()).tolist()) == sorted(plain_buckets(text)[0])


def test_ranks_are_exact_with_repeated_keys(spark):
    scored = [(5, 50, 1, 7)] * 300 + [(i, 50, 1, 7 + i % 3) for i in range(400)] + [(None, 50, 2, 9)] * 5 + [(900, 3, 0, 99)]
    df = spark.createDataFrame(scored, "doc_id long, n_features long, weight long, score long").repartition(5)
    for segments in (1, 7, 64):
        ranked, total = importance.ranked(df, "n_features >= 39", segments)
        got = ranked.collect()
        assert total == 705 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 706))
        inside = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        keys = [(-r["score"], r["doc_id"] is None, r["doc_id"]) for r in inside]
        assert keys == sorted(keys) and [r["doc_id"] for r in got if not r["rank"]] == [900]


def test_segments_are_even_when_one_key_has_most_rows(spark):
    df = spark.createDataFrame([(1, 50, 1, 7)] * 4000 + [(i, 50, 1, i) for i in range(1000)], "doc_id long, n_features long, weight long, score long").repartition(6)
    seen = []
    real = importance.accumulate
    try:
        importance.accumulate = lambda sizes: seen.append(list(sizes)) or real(seen[-1])
        importance.ranked(df, "true", 10)
    finally:
        importance.accumulate = real
    assert sum(seen[0]) == 5000 and max(seen[0]) <= 1000


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "the ned of"), (2, None)], "item_id long, text string")
    got = importance.resample(odd_docs, target).collect()
    assert len(got) == odd_docs.count() and all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for r in got if r["doc_id"] in (0, 1, 2))
    assert importance.resample(no_docs, target).count() == 0
    assert importance.resample(odd_docs, target.limit(0)).count() == odd_docs.count()


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "word " * 25) for i in range(20)], "doc_id string, text string")
    got = importance.resample(docs, docs, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
