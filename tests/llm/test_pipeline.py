"""The pipeline against its stages done plainly in Python, and the query registry."""

import corpus_pipeline
import __spark_entry__ as entry_module
from pagewright.llm import langid, line_runs, quality_zstd

from .test_duplicates import plain_dedup
from .test_tokens import check_pieces
from .test_word_sets import plain_parts

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "line dedup", "near-dedup", "packing"]

    model = quality_zstd.fit(docs, labels)
    want = {r["doc_id"]: r["text"] for r in docs.collect() if quality_zstd.score_of((r["text"] or "").encode(), model) >= 0.5}
    good = stages["quality"](spark, docs, SF).cache()
    assert good.columns == COLUMNS and {r["doc_id"]: r["text"] for r in good.collect()} == want and len(want) < docs.count()

    known = langid.fit(good)
    want = {i: t for i, t in want.items() if not langid.classify([t], known)[2][0]}
    spoken = stages["language"](spark, good, SF).cache()
    assert spoken.columns == COLUMNS and {r["doc_id"]: r["text"] for r in spoken.collect()} == want

    want = plain_dedup(sorted(want.items()), line_runs.MIN_WORDS)
    shorter = stages["line dedup"](spark, spoken, SF).cache()
    rows = shorter.collect()
    assert shorter.columns == COLUMNS and {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)

    want = {i: want[i] for i in set(plain_parts(want).values())}
    single = stages["near-dedup"](spark, shorter, SF).cache()
    assert single.columns == COLUMNS and {r["doc_id"]: r["text"] for r in single.collect()} == want

    check_pieces(stages["packing"](spark, single, SF).collect(), sorted(want.items()))
    by_doc = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
    assert set(by_doc) == set(want)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs.select(*COLUMNS, "score", "row"), no_docs.select(*COLUMNS, "score", "row")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_all_queries_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
