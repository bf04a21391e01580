import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import line_runs, order_minhash, simhash_trie
from pagewright.llm.components import components

SF = "/root/testdata/sf0.001"


# --- SimHash ----------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_fingerprint_of_odd_texts(monkeypatch):
    texts = ["", "a", "A b", "The THE the", "Ä ä\x0bb \x0c c d", "x y z x y z x y z", "😀 " * 40]
    want = [plain_fingerprint(t) for t in texts]
    assert [simhash_trie.fingerprint(t.encode()) for t in texts] == want
    monkeypatch.setattr(simhash_trie, "WORDS_AT_ONCE", 4)
    assert [simhash_trie.fingerprint(t.encode()) for t in texts] == want


def near_values(seed, centres, copies):
    rng = np.random.default_rng(seed)
    values = set()
    for base in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(copies):
            x = int(base) << 1 | int(rng.integers(0, 2))
            for _ in range(rng.integers(0, 5)):
                x ^= 1 << int(rng.integers(0, 64))
            values.add(x & (1 << 64) - 1)
    return np.array(sorted(values), np.uint64)


def brute_pairs(values):
    v = [int(x) for x in values]
    return {(v[i], v[j]) for i in range(len(v)) for j in range(i + 1, len(v)) if (v[i] ^ v[j]).bit_count() <= 2}


@pytest.mark.parametrize("at_once", [1 << 18, 16])
def test_trie_pairs_walk_finds_all(monkeypatch, at_once):
    monkeypatch.setattr(simhash_trie, "PAIRS_AT_ONCE", at_once)
    values = near_values(3, 8, 40)
    found = [(int(values[a]), int(values[b])) for i, j in simhash_trie.trie_pairs(values, np.zeros(len(values)), list(range(63, -1, -1))) for a, b in zip(i, j)]
    assert len(found) == len(set(found)) and {(min(p), max(p)) for p in found} == brute_pairs(values)


def test_near_pairs_once_each(spark):
    values = near_values(4, 30, 30)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long").repartition(5)
    found = [tuple(sorted(int(np.int64(x).view(np.uint64)) for x in r)) for r in simhash_trie.near_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(values)


def test_components_of_chains_stars_and_doubles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    clean = [(a, b) for a, b in links if a is not None and a != b]
    assert got == plain_components(clean, {x for link in clean for x in link})


def test_near_duplicates_whole_table(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {i: plain_fingerprint(t) for i, t in small.items()}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = plain_components(links, ids)
    rows = simhash_trie.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == [(i, f"{fps[i]:016x}", want[i]) for i in ids]
    assert sorted(r["doc_id"] for r in simhash_trie.keep_one(docs).collect()) == sorted(set(want.values()))


def test_a_document_without_id_still_links(spark, monkeypatch):
    values = {b"a": 0b0011, b"b": 0b1111, b"c": 0b111111}
    spark_docs = spark.createDataFrame([(5, "a"), (None, "b"), (9, "c"), (None, "d")], "doc_id long, text string")
    fps = spark_docs.select("doc_id", F.when(F.col("text") == "a", values[b"a"]).when(F.col("text") == "b", values[b"b"])
                            .when(F.col("text") == "c", values[b"c"]).otherwise(1 << 40).alias("fp"))
    monkeypatch.setattr(simhash_trie, "fingerprints", lambda docs: fps)
    got = {r["fingerprint"]: r["component_id"] for r in simhash_trie.near_duplicates(spark_docs).collect()}
    assert [got[f"{v:016x}"] for v in values.values()] == [5, 5, 5] and got[f"{1 << 40:016x}"] is None


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = simhash_trie.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0} and {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"0" * 16}
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert simhash_trie.near_duplicates(no_docs).count() == 0
    kept = simhash_trie.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [0, 3, 5, 6, 7, 8, 9, 10]


# --- repeated runs of lines -----------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_dedup(rows, least):
    """Every stretch of lines with enough words that has an earlier copy goes."""
    units = {i: [(p, x, len(WORD.findall(x))) for p, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t in rows}
    stretches = {i: [(s, e) for s in range(len(u)) for e in range(s, len(u)) if sum(x[2] for x in u[s:e + 1]) >= least] for i, u in units.items()}
    first = {}
    for i, _ in sorted(rows):
        for s, e in stretches[i]:
            first.setdefault(tuple(x[1] for x in units[i][s:e + 1]), (i, s))
    out = {}
    for i, t in rows:
        gone = set()
        for s, e in stretches[i]:
            if first[tuple(x[1] for x in units[i][s:e + 1])] < (i, s):
                gone |= {x[0] for x in units[i][s:e + 1]}
        left = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        out[i] = left if WORD.search(left) or not gone else ""
    return out


@pytest.mark.parametrize("least", [1, 3, 8, 13])
def test_runs_match_brute_force_on_random_lines(spark, least):
    rng = np.random.default_rng(least)
    lines = ["a", "b c", "d e f", "", "  ", "g h i j k", "l", "m n o p q r s t u v"]
    rows = [(i, "\n".join(lines[k] for k in rng.integers(0, len(lines), rng.integers(1, 12)))) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_runs.delete_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    assert got == plain_dedup(rows, least)


def test_runs_whole_table(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in line_runs.delete_repeated_runs(docs).collect()} == plain_dedup(sorted(small.items()), line_runs.MIN_WORDS)


def test_runs_odd_rows(spark, odd_docs, no_docs):
    out = line_runs.delete_repeated_runs(odd_docs)
    assert sorted(out.columns) == sorted({*odd_docs.columns, "n_lines", "n_removed"})
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    text = {}
    for r in rows:
        text.setdefault(r["doc_id"], []).append(r["text"])
    # Null ids come first, so the null row's line is the first copy only of itself; id 3 keeps both of its equal rows.
    assert text[0] == [None] and text[1] == [""] and len(set(text[3])) == 1 and text[3][0] and text[4] == [""]
    assert [r["n_lines"] for r in rows if r["doc_id"] in (0, 1)] in ([0, 1], [1, 0])
    assert line_runs.delete_repeated_runs(no_docs).count() == 0


def test_runs_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = line_runs.delete_repeated_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# --- Order MinHash ----------------------------------------------------------------------

def plain_sketch(text):
    """Minima by sorting all numbered k-mers for every hash function."""
    h = order_minhash.kmers(text.encode())
    if not len(h):
        return np.zeros(order_minhash.M, np.uint32)
    out = []
    for a, b in zip(order_minhash._A, order_minhash._B):
        chosen = sorted(sorted(range(len(h)), key=lambda i: (int(h[i] * a + b), i))[:order_minhash.L])
        x = np.array([len(chosen)], np.uint64)
        for i in chosen:
            x = order_minhash._scramble(x * order_minhash._MIX + h[i])
        out.append(x[0] >> np.uint64(32))
    return np.array(out, np.uint32)


def test_sketch_matches_plain_minima(small, monkeypatch):
    texts = ["", "a", "a b", "a b c d", "x x x x x x x x", *list(small.values())[:12]]
    want = [plain_sketch(t) for t in texts]
    assert all((order_minhash.sketch(t.encode()) == w).all() for t, w in zip(texts, want))
    monkeypatch.setattr(order_minhash, "KMERS_AT_ONCE", 7)
    assert all((order_minhash.sketch(t.encode()) == w).all() for t, w in zip(texts, want))


def test_occurrences_are_numbered():
    h = order_minhash.kmers(b"a b c a b c a b c")
    assert len(h) == 7 and len(set(h.tolist())) == 7


def test_order_costs_likeness():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.permutation(300)]
    blocks = [words[i:i + 10] for i in range(0, 300, 10)]
    moved = [w for b in blocks[::-1] for w in b]
    own, other = (order_minhash.sketch(" ".join(x).encode()) for x in (words, moved))
    shared = len(set(order_minhash.kmers(" ".join(words).encode())) & set(order_minhash.kmers(" ".join(moved).encode()))) / 298
    assert shared > 0.75 and order_minhash.likeness(own, other) < 0.5
    close = order_minhash.sketch(" ".join(words[:280]).encode())
    assert order_minhash.likeness(own, close) > 0.7 and order_minhash.likeness(own, own) == 1


@pytest.mark.parametrize("slots", [1, 7, 64])
def test_neighbours_follow_the_ids(spark, small, slots):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    rows = {r["doc_id"]: r for r in order_minhash.fingerprint_documents(docs).collect()}
    placed = order_minhash.neighbouring(docs, slots).collect()
    assert sum(not r["extra"] for r in placed) == len(small) and sum(r["extra"] for r in placed) == len({r["slot"] for r in placed})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = sorted(small)
    assert sorted(rows) == ids
    for i, doc_id in enumerate(ids):
        own, following, r = small[doc_id], small[ids[(i + 1) % len(ids)]], rows[doc_id]
        changed = order_minhash.edited(own, following)
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (order_minhash.sketch(t.encode()) for t in (own, changed, following))
        assert r["fingerprint"] == order_minhash.text_of(a) and r["edited_fingerprint"] == order_minhash.text_of(b)
        assert r["near_edited"] == order_minhash.likeness(a, b) and r["near_next"] == order_minhash.likeness(a, c)


def test_fingerprints_odd_rows(spark, odd_docs, no_docs):
    rows = order_minhash.fingerprint_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert order_minhash.fingerprint_documents(no_docs).count() == 0
    one = order_minhash.fingerprint_documents(spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_text_ids_and_an_id_of_a_third_of_all_rows(spark):
    """Ids are sorted by their bytes; rows that repeat an id follow each other by their texts."""
    rng = np.random.default_rng(12)
    rows = [(f"d{i}ß" if i % 2 else f"D{i}", " ".join(f"w{k}" for k in rng.integers(0, 50, 12))) for i in range(40)] + [("hot", f"a{i} b c d e") for i in range(20)] + [(None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1].encode()))
    want = sorted((str(i), len(t), hashlib.sha256(order_minhash.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in order_minhash.fingerprint_documents(docs).collect())
    assert got == want
