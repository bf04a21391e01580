import pathlib
import time

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import simhash_trie, word_sets
from pagewright.llm.common import Rounds
from pagewright.llm.components import components

from .test_duplicates import plain_components


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_parts(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    close = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    return plain_components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if close(sets[a], sets[b])], ids)


def planted(groups, copies, edits):
    """Texts of 150 words; a copy has up to `edits` words replaced, each of which costs five shingles."""
    rng, out = np.random.default_rng(5), {}
    for g in range(groups):
        base = [f"w{g}x{i}" for i in rng.integers(0, 1000, 150)]
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, 150, rng.integers(0, edits + 1)):
                words[at] = f"e{rng.integers(0, 10**9)}"
            out[len(out)] = " ".join(words)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("few", [0, 4])
def test_edited_copies_link_as_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(word_sets, "FEW", few)
    texts = planted(6, 25, 6) | {1000 + i: t for i, t in enumerate(["", None, "  ", "a b", "A  b", "a b c"])}
    got = {r["doc_id"]: r["component_id"] for r in word_sets.near_duplicates(frame(spark, texts)).collect()}
    assert got == plain_parts(texts)


def test_stage_drops_copies_with_a_few_edited_words(spark):
    texts = planted(20, 2, 0)
    for i in range(1, 40, 2):  # two edits of 150 words: similarity 136 / 156 = 0.87
        words = texts[i].split()
        words[40], words[90] = "changed", "words"
        texts[i] = " ".join(words)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 40, 2))


def template_group(members, own, words=200):
    """Texts of one template; each has `own` words of its own, far enough apart to cost five shingles each."""
    rng, out = np.random.default_rng(11), {}
    base = [f"t{i}" for i in range(words)]
    for m in range(members):
        text = list(base)
        for at in rng.choice(np.arange(0, words - 5, 5), own, replace=False):
            text[at + 2] = f"m{m}x{at}"
        out[m] = " ".join(text)
    return out


def counted_pairs(spark, texts):
    docs = frame(spark, texts)
    nodes = word_sets._keyed(docs).select("node").distinct()
    sets = word_sets._sets(docs, nodes).cache()
    return word_sets._prefix_pairs(nodes.withColumn("c", word_sets.F.col("node")), sets), sets, docs


def test_large_group_below_the_threshold_makes_no_pairs(spark):
    texts = template_group(300, 6)  # 30 of 196 shingles are a member's own: similarity about 0.73
    pairs, _, docs = counted_pairs(spark, texts)
    assert pairs.distinct().count() <= len(texts)  # of 44,850
    assert len({r["component_id"] for r in word_sets.near_duplicates(docs).collect()}) == len(texts)


@pytest.mark.parametrize("own", [1, 3, 4, 5])
def test_prefixes_lose_no_similar_pair(spark, own):
    texts = template_group(40, own) | {1000 + i: t for i, t in planted(3, 12, 5).items()}
    texts |= {2000 + i: " ".join(f"z{j}" for j in range(n)) for i, n in enumerate((5, 6, 7, 100, 110, 120, 125, 130))}
    pairs, sets, _ = counted_pairs(spark, texts)
    names = {r["node"]: set(r["words"]) for r in sets.collect()}
    ids = sorted(names)
    close = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 9 * len(names[a] & names[b]) >= 4 * (len(names[a]) + len(names[b]))}
    found = {(min(r), max(r)) for r in pairs.distinct().collect()}
    assert close <= found


def test_many_pairs_of_one_node_spread(spark, monkeypatch):
    monkeypatch.setattr(word_sets, "SHARE", 3)
    texts = planted(2, 40, 1)
    got = {r["doc_id"]: r["component_id"] for r in word_sets.near_duplicates(frame(spark, texts)).collect()}
    assert got == plain_parts(texts)


def test_odd_rows_of_the_stage(spark, odd_docs, no_docs):
    """Null and empty texts are one group, repeated rows and texts of the same words too; rows without an id stay."""
    rows = odd_docs.select("doc_id", "text")
    kept = word_sets.keep_one(rows).collect()
    by_id = {}
    for r in rows.collect():
        if r["doc_id"] is not None:
            by_id.setdefault(r["doc_id"], r["text"])
    first = plain_parts(by_id)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(first.values()))
    assert sum(r["doc_id"] is None for r in kept) == rows.where("doc_id IS NULL").count()
    assert word_sets.keep_one(no_docs).count() == 0


def edited_long_texts():
    """Ten groups of a long text and three copies with one changed word each."""
    rng, out = np.random.default_rng(7), {}
    for g in range(10):
        base = [f"l{g}x{i}" for i in rng.integers(0, 10**6, 3000)]
        for _ in range(4):
            out[len(out)] = " ".join(base)
            base = [*base]
            base[rng.integers(0, 3000)] = f"e{len(out)}"
    return out


def test_trie_links_without_a_band(spark, monkeypatch):
    """Fingerprints within two bits are candidates by the trie; of those, texts below 0.8 stay apart."""
    monkeypatch.setattr(word_sets, "band_keys", lambda hashes: np.zeros(0, np.int64))
    texts = edited_long_texts() | {100 + i: " ".join(["same"] * 40 + [f"own{i}"] * i) for i in (2, 40)}
    fps = {i: simhash_trie.fingerprint(t.encode()) for i, t in texts.items()}
    near = {(i, j) for i in texts for j in texts if i < j and (fps[i] ^ fps[j]).bit_count() <= 2}
    sets = {i: plain_set(t) for i, t in texts.items()}
    close = {(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    want = plain_components(sorted(close), sorted(texts))
    got = {r["doc_id"]: r["component_id"] for r in word_sets.near_duplicates(frame(spark, texts)).collect()}
    assert got == want and len(close) >= 10


def test_dense_group_gives_one_trie_pair_per_text(spark):
    texts = {i: t for i, t in enumerate(edited_long_texts().values())}
    classes = word_sets._keyed(frame(spark, texts))
    pairs = word_sets._trie_pairs(classes.select("node", "fp")).collect()
    assert 10 <= len(pairs) <= len(texts)
    twins = spark.createDataFrame([(i, 5) for i in range(200)], "node long, fp long")
    assert word_sets._trie_pairs(twins).count() == 199


def on_disk(spark):
    """Tables in the checkpoint folder, and shuffle files."""
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {p for p in [*folder.glob("rdd-*"), *folder.glob("rounds-*/*")] if p.is_dir()}, {n for n in names if n.startswith("shuffle_")}


@pytest.mark.parametrize("nodes, tables", [(200, 4), (2, 1)])
def test_rounds_hold_the_disk_of_one(spark, nodes, tables):
    """A path takes several rounds, a pair none; the last table stays, shuffle files go without the driver's garbage collection."""
    links = spark.createDataFrame([(i, i + 1) for i in range(nodes - 1)], "u long, v long")
    (held, shuffled), rounds = on_disk(spark), Rounds(spark)
    parts = components(links, rounds)
    deadline = time.time() + 20  # block managers delete behind the query
    while on_disk(spark)[1] - shuffled and time.time() < deadline:
        time.sleep(0.2)
    now, left = on_disk(spark)
    assert len(now - held) == 1 and not left - shuffled
    assert rounds.written >= tables and (nodes > 2 or rounds.written == 1)
    assert {tuple(r) for r in parts.collect()} == {(i, 0) for i in range(nodes)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_near_duplicates_drop_the_tables_of_their_rounds(spark):
    held, _ = on_disk(spark)
    texts = planted(6, 25, 6)
    found = word_sets.near_duplicates(frame(spark, texts))
    assert len(on_disk(spark)[0] - held) == 5  # rows, classes, shared, sets, named
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == plain_parts(texts)
