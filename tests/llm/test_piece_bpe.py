import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from pagewright.llm import piece_bpe

from .conftest import SF

ODD = ["", "\n", " ", "  ", "a  b", " a", "a ", "▁", "▁▁a", "a\tb\x00c", "<s></s><unk>", "<0x41>", "𝔘ñïç", "日本語テキスト", "áe", "\r\n\r\n", "x" * 300, "ab" * 200 + " z",
       "   " * 50, "�", "😀😀 😀", "e.g. i.e. 3.14", "İYİ. ev", " ①ﬁ　ｶﾞ  ²½ ", "ﬃ ㍿Å", "  　 ", "İI  ß"]


def odd_texts(n):
    rng = random.Random(5)
    alphabet = "abcde  \n\t.,!▁éñ日本語한국😀́<>s/0x4"
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    anything = ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(32, 126)])) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return ODD + mixed + anything


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(piece_bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.vocabulary())


def test_ids_and_spans_equal_the_library(model, library, small):
    texts = odd_texts(800) + list(small.values())[:80]
    for text, got in zip(texts, model.encode([(t or "").encode() for t in texts])):
        want = library.encode_as_proto(text or "")
        assert got.ids.tolist() == [1, *(p.id for p in want.pieces), 2]
        assert list(zip(got.starts[1:-1].tolist(), got.ends[1:-1].tolist())) == [(p.begin, p.end) for p in want.pieces], text


def test_decoding_equals_the_library(model, library):
    rng = random.Random(8)
    lists = [[rng.randrange(32000) for _ in range(rng.randint(1, 12))] for _ in range(800)] + [[rng.randint(3, 258) for _ in range(8)] for _ in range(300)] \
        + [[rng.choice([1, 2, 0, 259, 260, 28705, 9, 230]) for _ in range(6)] for _ in range(300)] + [[]]
    assert [model.decode(x) for x in lists] == [library.decode(x) for x in lists]


def test_queue_and_matrix_agree(model):
    rng = random.Random(2)
    units = ["".join(rng.choice("▁etaoinshr.,é") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    width = sorted(units, key=len)
    assert model.matrix(width) == [model.spell(model.queue(u)) for u in width]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps_and_alignment_equal_the_library(rule, squeeze):
    """The library's own compiled maps of several hundred kilobytes, longest prefixes and removed spaces included."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    spec = proto.normalizer_spec
    mine = object.__new__(piece_bpe.PieceModel)
    mine.chars, mine.dummy, mine.squeeze, mine.escape = piece_bpe.CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
    for text in odd_texts(400):
        clean, places = mine.normalise(text.encode())
        want, offsets = normalizer.normalize(text, with_offsets=True)
        assert clean.decode() == want
        byte_at, char_at = [0], [0]
        for c in text:
            byte_at.append(byte_at[-1] + len(c.encode()))
        for c in want:
            char_at.append(char_at[-1] + len(c.encode()))
        assert [int(places[i]) for i in char_at] == [byte_at[o] for o in offsets]


def test_small_tables_change_no_result(monkeypatch, small):
    texts = [(t or "").encode() for t in list(small.values())[:30]]
    plain = [x.ids.tolist() for x in piece_bpe.PieceModel(piece_bpe.vocabulary()).encode(texts)]
    for name, value in (("UNITS", 10), ("UNITS_AT_ONCE", 3), ("MATRIX_CHARS", 4), ("CACHED_UNIT_CHARS", 3), ("TEXT_AT_ONCE", 500)):
        monkeypatch.setattr(piece_bpe, name, value)
    assert [x.ids.tolist() for x in piece_bpe.PieceModel(piece_bpe.vocabulary()).encode(texts)] == plain


def test_documents_give_the_library_digests(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in piece_bpe.encode_documents(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        x = got[r["doc_id"]]
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_and_spans_of_a_table(spark, odd_docs, no_docs):
    encoded = piece_bpe.encode_spans(odd_docs)
    texts = sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in piece_bpe.decode_ids(encoded).collect()) == texts
    by_id = {i: t.encode() for _, i, t in texts if i is not None}
    for r in encoded.where("doc_id is not null").collect():
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        covered = sorted({(a, b) for a, b in zip(r["starts"], r["ends"]) if a < b})
        assert b"".join(by_id[r["doc_id"]][a:b] for a, b in covered) == by_id[r["doc_id"]]
    assert piece_bpe.encode_spans(no_docs).count() == 0 and piece_bpe.encode_documents(no_docs).count() == 0


def test_registry_has_the_new_queries():
    import __spark_entry__ as entry_module

    assert all(any(n.startswith(f"op{i}_") for n in entry_module.queries()) for i in (11, 12, 13))
