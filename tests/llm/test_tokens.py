import hashlib
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from pagewright.llm import byte_bpe, packing, token_counts

ODD_TEXTS = ["", " ", "  a", "a b  c   d", "x\n\n y\t z ", "it's we'll I'M", "a\x1cb \x1d c", "😀😀 😀", "ab" * 700, "0 1 22  333", "ß é à",
             "a\u0085b \u0085 c", "  x　y", "<|endoftext|> q", "nfc é ΑΣ ΑΣ. Σ"]


# --- token counts -------------------------------------------------------------

def brute_count(word, scores, longest):
    best = [0]
    for end in range(1, len(word) + 1):
        options = [best[s] + scores[word[s:end]] for s in range(max(0, end - longest), end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode())
            options.append(best[end - 1] + token_counts.step(n * token_counts._BYTE_SCORE, n))
        best.append(max(options))
    return token_counts.count_of(best[-1])


def test_trie_counts_match_plain_dynamic_programming(small, monkeypatch):
    path = token_counts.vocabulary()
    scores, longest = token_counts.pieces(path)
    texts = list(small.values())[:60] + ODD_TEXTS + ["ж" * 600, "qu" * 200 + "😀"]
    want = [(len(t.split()), sum(brute_count("▁" + w, scores, longest) for w in t.split())) for t in texts]
    assert token_counts.Trie(path).counts(texts) == want
    monkeypatch.setattr(token_counts, "NODES", 50)  # a new trie again and again
    monkeypatch.setattr(token_counts, "KNOWN_WORDS", 20)
    tight = token_counts.Trie(path)
    assert [x for t in texts for x in tight.counts([t])] == want


def test_trie_scores_a_shared_prefix_once():
    trie = token_counts.Trie(token_counts.vocabulary())
    trie.insert("▁reading")
    nodes = len(trie.forward)
    trie.insert("▁reader")
    assert len(trie.forward) == nodes + 2


def test_token_counts_odd_rows(odd_docs, no_docs):
    rows = token_counts.count_tokens(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert token_counts.count_tokens(no_docs).count() == 0


# --- packing --------------------------------------------------------------------

def test_best_fill_is_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(200):
        stock = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, rng.integers(1, 5))}
        capacity = int(rng.integers(1, 60))
        total, used = packing.best_fill(stock, capacity)
        brute = max(s for s in (sum(k * c for k, c in zip(stock, cs)) for cs in product(*(range(n + 1) for n in stock.values()))) if s <= capacity)
        assert total == brute == sum(k * c for k, c in used.items()) and all(c <= stock[k] for k, c in used.items())


def check_pieces(rows, texts):
    """Every id of every document row in exactly one piece; sequences full and without gaps."""
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    assert set(by_doc) == set(want)
    for doc_id, copies in want.items():
        if len({tuple(c) for c in copies}) > 1:  # rows of one null id cannot be told apart
            assert sum(r["length"] for r in by_doc[doc_id]) == sum(map(len, copies))
            continue
        covered = defaultdict(int)
        for r in by_doc[doc_id]:
            part = copies[0][r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] and r["doc_tokens"] == len(copies[0])
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            for i in range(r["start"], r["start"] + r["length"]):
                covered[i] += 1
        assert covered == {i: len(copies) for i in range(len(copies[0]))}
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    return len(by_sequence)


def test_packing_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5, "doc_id")
    rows = packing.pack(docs).collect()
    n = check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n == -(-sum(r["length"] for r in rows) // packing.WINDOW)  # no fewer windows could hold the ids


def test_packing_odd_rows(odd_docs, no_docs):
    check_pieces(packing.pack(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert packing.pack(no_docs).count() == 0


def test_word_ids_are_the_text_ids(small, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 200)
    own, library = packing.WordTokenizer(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary())
    texts = ODD_TEXTS + list(small.values())[:40]
    for text, ids in zip(texts, packing.tokens([t.encode() for t in texts], own)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [1], text
    monkeypatch.setattr(packing, "TEXT_AT_ONCE", 50)
    for text, ids in zip(texts, packing.tokens([t.encode() for t in texts], own)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [1], text


# --- byte-level BPE ---------------------------------------------------------------

@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.vocabulary()), special_tokens={})


def test_bpe_matches_the_library(small, reference_bpe, monkeypatch):
    texts = ODD_TEXTS + list(small.values())[:60]
    want = [(np.array(reference_bpe.encode_ordinary(t), "<u4").tobytes(), t.encode()) for t in texts]
    assert byte_bpe.ByteBpe(byte_bpe.vocabulary()).many(texts) == want
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 50)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(byte_bpe, "WORDS_AT_ONCE", 7)
    tight = byte_bpe.ByteBpe(byte_bpe.vocabulary())
    assert [x for t in texts[:40] for x in tight.many([t])] == want[:40]


def test_bpe_long_words_match_the_query(reference_bpe):
    rank_of = byte_bpe.ranks(byte_bpe.vocabulary())
    for word in ("ab" * 400, "thethe" * 90, "Donaudampfschiff" * 30, "é" * 200, "aaaaabaaaa" * 50):
        assert byte_bpe.contract_long(word.encode(), rank_of) == reference_bpe.encode_ordinary(word)


def test_pieces_give_the_text_back():
    for text in ODD_TEXTS:
        assert "".join(byte_bpe.pieces_of(text)) == text


def test_bpe_documents(odd_docs, no_docs, reference_bpe):
    rows = byte_bpe.encode_documents(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"] is not None}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            ids = reference_bpe.encode_ordinary(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode_documents(no_docs).count() == 0


def test_every_letter_before_a_mark_equals_the_library():
    """Letters that stop to be letters once they are in lower case, such as U+0130, take the mark into their token group."""
    tokenizer = packing.WordTokenizer(packing.vocabulary())
    library = Tokenizer.from_file(packing.vocabulary())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    words = [f"a{c}{packing.MARKS[i % len(packing.MARKS)].decode()}" for i, c in enumerate(letters)] + ["İYİ. ev", "KİŞİ,", "TEKLİFİ!", "ΑΣ.", "Σ!", "eÉ,", "x" * 70 + ","]
    for at in range(0, len(words), 20_000):
        part = words[at:at + 20_000]
        want = [x.ids for x in library.encode_batch_fast(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.many([w.encode() for w in part])] == want


def test_word_tokenizer_equals_the_library_on_mixed_text():
    rng = np.random.default_rng(4)
    pool = list("abcdeABC .,!'s\n\t0123") * 40 + [chr(c) for c in range(0xC0, 0x600)] + [chr(c) for c in range(0x300, 0x340)] + list("日本語한국😀ﬁ")
    texts = ["".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 60))) for _ in range(3000)]
    library = Tokenizer.from_file(packing.vocabulary())
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokenizer(packing.vocabulary()).many([t.encode() for t in texts])] == want
