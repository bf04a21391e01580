import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import langid, quality_rules, quality_zstd
from pagewright.llm.common import sample_texts, spread_pieces

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_holds_out_and_separates(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_zstd.quality_scores(docs, quality_zstd.fit(docs, labels)).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.95


def test_quality_learns_only_from_its_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert quality_zstd.fit(docs, labels) == quality_zstd.fit(docs, flipped)


def test_quality_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        rows = quality_zstd.quality_scores(odd_docs, quality_zstd.fit(odd_docs, labels)).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1  # null is empty
    assert quality_zstd.quality_scores(no_docs, quality_zstd.fit(no_docs, odd_labels)).count() == 0
    kept = quality_zstd.keep_good(odd_docs, quality_zstd.fit(odd_docs, no_labels))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()  # nothing known, nothing rejected


def test_dictionaries_hold_what_comes_late_in_a_text():
    head = lambda i: f"head {i} ".encode() * 200
    good = [[head(i)] for i in range(3000)]
    bad = [[head(i) + b"LATE JUNK %d " % i * 100] for i in range(3000)]  # junk begins after 196 bytes, the share of a text
    model = quality_zstd.fit_texts(good, bad)
    assert model.bad.count(b"LATE JUNK") > 2000 and b"LATE JUNK" not in model.good and len(model.bad) <= quality_zstd.DICT_BYTES


def test_share_of_a_text():
    data = bytes(range(256)) * 4
    assert quality_zstd.spread_share([data[:300], data[300:]], 2000) == data
    assert quality_zstd.spread_share([data], 400) == data[:100] + data[308:408] + data[616:716] + data[924:]


def test_sample_spreads_over_the_text():
    data = bytes(range(256)) * 100
    pieces = spread_pieces(data)
    assert len(pieces) == 4 and pieces[0] == data[:2048] and data.endswith(pieces[-1])
    assert b"".join(spread_pieces(data[:5000])) == data[:5000]


def test_repeated_ids_give_one_text_each(spark, monkeypatch):
    rows = [(3, f"text {i % 7}", "en") for i in range(200)] + [(i, f"own {i}", "en") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    chosen = spark.createDataFrame([(3, "en")] * 5 + [(111, "en")], "doc_id long, lang string")
    got = sample_texts(docs, chosen, "lang")
    assert [(k, i) for k, i, _ in got] == [("en", 111), ("en", 3)] and got == sample_texts(docs.repartition(2), chosen, "lang")
    taken = []
    monkeypatch.setattr(langid, "sample_texts", lambda docs, chosen, key: taken.extend(r["doc_id"] for r in chosen.collect()) or [])
    langid.fit(docs, 20)
    assert len(taken) == len(set(taken)) == 20


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows) and len(rows) == docs.count()
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) / len(unseen) > 0.98
    assert not any(r["rejected"] for r in rows)


def test_language_rejects_what_is_far(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, _, rejected = langid.classify(["Это совсем другой язык и другие буквы " * 20, "12345 !!", ""], langid.fit(docs))
    assert rejected == [True, True, True] and langs[1:] == ["und", "und"] and langs[0] != "und"


def test_language_rejects_short_foreign_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    foreign = ["Привет мир", "Это короткий текст", "Это короткий текст на русском языке", "Καλημέρα σας φίλοι μου"]
    assert langid.classify(foreign, model)[2] == [True] * 4
    own = [" ".join(r["text"].split()[5:5 + n]) for r in docs.orderBy("doc_id").limit(100).collect() for n in (2, 4, 8)]
    own = [x for x in own if sum(c.isalpha() for c in x) > 5]
    assert len(own) > 200 and sum(langid.classify(own, model)[2]) <= len(own) / 100


def test_language_fit_holds_one_language_dense_at_full_size():
    assert langid.DIMS == 1 << 14 and langid.SAMPLE_PER_LANG == 600
    samples = [(f"l{i % 30:02}", f"{chr(97 + i % 26)}{chr(97 + i % 17)}o words of text number {chr(97 + i % 13)}") for i in range(3000)]
    langid._letters()
    tracemalloc.start()
    model = langid.fit_texts(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.langs) == 30 and peak < 3000 * langid.DIMS * 4 / 3  # a third of all vectors


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Größe und naïve Wörter, 12 mal. " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert (langid.counts(text) == whole).all()


def test_language_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = langid.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[0]["lang_pred"] == by_id[1]["lang_pred"] == by_id[10]["lang_pred"] == "und" and by_id[0]["rejected"]
    assert langid.predict(no_docs, langid.fit(no_docs)).count() == 0
    assert langid.keep_known(odd_docs, model).columns == odd_docs.columns


def brute_repeat(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= {i, i + 1, i + 2}
    return len(inside)


def test_rule_base_counts():
    for text in ("", "a", "a b c a b c", "a a a a a", "x y z\nx y z\n\n\nx y z", "ä# $ |x|\n \n \nq", "one two three four one two three"):
        data = text.encode()
        words = data.split()
        lines = text.split("\n")
        full = [x for x in lines if x.split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"),
                sum(x in lines[:i] for i, x in enumerate(lines) if x.split()), brute_repeat(words))
        assert quality_rules.base_counts(data) == want, (text, full)


def test_rule_corpus_counts_cover_everything(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    raw = quality_rules.corpus_counts(docs)
    assert raw.sum() == sum(max(0, len(t.encode()) - 3) for t in small.values())


def test_rules_keep_good_and_reject_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()}
    good = [rows[r["doc_id"]] for r in labels.where("quality = 1").collect() if not rows[r["doc_id"]]["base_failed"]]
    bad = [rows[r["doc_id"]] for r in labels.where("quality = 0").collect()]
    assert sum(r["kept"] for r in good) / len(good) > 0.97
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.8


def test_rules_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        rows = quality_rules.judge(odd_docs, quality_rules.fit(odd_docs, labels)).collect()
        assert len(rows) == odd_docs.count()
        assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (0, 1, 2, 6))
    assert quality_rules.judge(no_docs, quality_rules.fit(no_docs, no_labels)).count() == 0


def test_rules_learn_from_every_trusted_text_whole(spark):
    """Long texts, of which a sample would read pieces only; all of them against plain counts."""
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{k}" for k in rng.integers(0, 300, 60 if i % 3 else 6000)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    half = {r[0]: r[1] % 2 for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    trusted = [i for i in texts if i % 2 == 1 and zlib.crc32(str(i).encode()) % 3 != 1]
    raw, target = (sum(quality_rules.gram_counts(texts[i].encode()) for i in ids) for ids in (texts, [i for i in trusted if half[i] == 0]))
    log = lambda c: np.log((c + 1) / (c.sum() + quality_rules.BUCKETS))
    model = quality_rules.fit(docs, labels)
    assert np.allclose(model.ratio, log(target) - log(raw))
    rest = [quality_rules.mean_ratio(texts[i].encode(), model.ratio) for i in trusted if half[i] == 1]
    assert model.threshold == pytest.approx(np.quantile(rest, quality_rules.LOST_GOOD))


def test_quantile_is_that_of_numpy(spark):
    values = np.random.default_rng(3).normal(size=501)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    for share in (0.0, 0.002, 0.5, 1.0):
        assert quality_rules.quantile(df, share) == pytest.approx(np.quantile(values, share))
    assert quality_rules.quantile(df.limit(0), 0.5) is None
