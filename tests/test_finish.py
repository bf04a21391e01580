"""Runs to the end: ledger, erased pictures, and a stream that breaks between its results."""

import os
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import plugins as V
from pagewright.plans import finish as N
from pagewright.schema import RunConfig, StyleConfig
from pagewright.sources.files import read_images, read_pixels
from pagewright.sources.ledger import Ledger
from pagewright.sources.png import encode_png, patched_pages
from pagewright.streaming.intake import page_stream, start_intake

from .test_files import page, patch_engine, png

CONFIG, STYLE = RunConfig(provider="openai"), StyleConfig()


def counted(factory, log, kind):
    def model():
        work = factory()

        def call(x):
            open(f"{log}/{kind}-{os.getpid()}-{time.time_ns()}", "w").close()
            return work(x)

        return call

    return model


def test_half_a_unit_is_never_seen(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "store"))
    assert ledger.read("rows") is None
    ledger.publish("a", {"rows": spark.range(3), "more": spark.range(1)})
    ledger.step("b", "rows", lambda: spark.range(100))  # not closed
    assert ledger.read("rows").count() == 3 and not ledger.closed("b")
    calls = []
    assert ledger.step("b", "rows", lambda: calls.append(1) or spark.range(7)).count() == 100 and not calls
    ledger.close("b")
    ledger.close("b")
    assert ledger.read("rows").count() == 103
    ledger.publish("b", {"rows": spark.range(999)})  # closed: nothing happens
    assert ledger.read("rows").count() == 103


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "store"))
    ledger.publish("v1", {"pages": spark.range(5)}, replaces=True)
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        ledger.publish("v2", {"pages": broken}, replaces=True)
    assert ledger.read("pages").count() == 5 and len(os.listdir(tmp_path / "store" / "pages")) == 1
    ledger.publish("v2", {"pages": spark.range(2)}, replaces=True)
    assert ledger.read("pages").count() == 2
    ledger.publish("v3", {"pages": spark.range(4)})
    assert ledger.read("pages").count() == 6
    ledger.compact("pages", "c", lambda df: df.distinct())
    assert ledger.read("pages").count() == 4 and len(ledger.folders("pages")) == 1


def test_two_attempts_at_one_result_count_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "store"))
    spark.range(3).write.parquet(str(tmp_path / "x"))
    spark.range(3).write.parquet(str(tmp_path / "y"))
    ledger._note("u", "rows", str(tmp_path / "x"))
    ledger._note("u", "rows", str(tmp_path / "y"))
    ledger.close("u")
    assert ledger.read("rows").count() == 3


def test_pictures_are_put_together_again(spark, tmp_path):
    rng = np.random.default_rng(1)
    shapes = {"a.png": (150, 80), "b.png": (1, 1), "c.png": (64, 3)}
    pictures = {n: rng.integers(0, 256, (*s, 3)).astype(np.uint8) for n, s in shapes.items()}
    for n, img in pictures.items():
        (tmp_path / n).write_bytes(encode_png(img.shape[1], img.shape[0], img.tobytes()))
    images = read_images(spark, str(tmp_path))
    rows = [(r.page_id, r.name) for r in images.select("page_id", "name").collect()]
    names = dict((n, i) for i, n in rows)
    spots = [(names["a.png"], 3, 100, 1, 2, 3), (names["a.png"], 79, 149, 4, 5, 6), (names["b.png"], 0, 0, 7, 8, 9)]
    changed = spark.createDataFrame(spots, "page_id string, x int, y int, b int, g int, r int")
    out = tmp_path / "out"
    out.mkdir()
    made = patched_pages(images, changed).collect()
    assert {r.page_id for r in made} == {names["a.png"], names["b.png"]}  # a page without a change has no row
    for r in made:
        (out / os.path.basename(r.page_id)).write_bytes(r.content)
    pictures["a.png"][100, 3], pictures["a.png"][149, 79], pictures["b.png"][0, 0] = (1, 2, 3), (4, 5, 6), (7, 8, 9)
    for r in read_images(spark, str(out)).collect():
        assert bytes(r.data) == pictures[r.name].tobytes()


def test_a_folder_to_the_end(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    for i in (1, 2, 10):
        (source / f"p{i}.png").write_bytes(png(page(i)))
    (source / "blank.png").write_bytes(png(np.full((70, 30, 3), 99)))
    (source / "bad.png").write_bytes(b"not a picture")
    log, ledger = tempfile.mkdtemp(), Ledger(spark, str(tmp_path / "store"))

    def run():
        N.run_unit(spark, str(source), ledger, "u1", 1, CONFIG, STYLE, counted(V.echo_translator, log, "translate"), counted(patch_engine(), log, "ocr"))

    run()
    pages = {r.name: r.status for r in N.stored_pages(ledger).collect()}
    assert pages == {"p1.png": "completed", "p2.png": "failed", "p10.png": "completed", "blank.png": "completed", "bad.png": "failed"}
    assert {(os.path.basename(r.page_name), r.translated_text) for r in N.stored_blocks(ledger).collect()} == {("p1.png", "HELLO"), ("p10.png", "HELLO")}
    artifacts = N.stored_artifacts(ledger).collect()
    assert {(os.path.basename(r.page_name), r.kind) for r in artifacts} == {("p1.png", "erased"), ("p10.png", "erased")} and all(r.render_hash for r in artifacts)
    out = tmp_path / "erased"
    out.mkdir()
    for r in artifacts:
        (out / os.path.basename(r.page_name)).write_bytes(r.content)
    for r in read_pixels(read_images(spark, str(out))).groupBy("page_id").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n")).collect():
        assert r.n == 80 * 150 and r.lo >= 235 and r.hi <= 245  # the dark patch is gone
    calls = len(os.listdir(log))
    run()
    assert len(os.listdir(log)) == calls == 3 + 2


@pytest.mark.parametrize("broken", ["answers", "blocks", "artifacts"])
def test_a_stream_that_breaks_between_results_sends_no_page_again(spark, tmp_path, broken):
    source = tmp_path / "pages"
    source.mkdir()
    for i in (1, 10):
        (source / f"p{i}.png").write_bytes(png(page(i)))
    log, ledger, checkpoint = tempfile.mkdtemp(), Ledger(spark, str(tmp_path / "store")), str(tmp_path / "ck")
    state = {"break": True}
    real = ledger.step

    def step(unit, name, build, replaces=False):
        out = real(unit, name, build, replaces)
        if name == broken and state["break"]:
            raise RuntimeError("killed")
        return out

    ledger.step = step
    work = N.to_the_end(ledger, CONFIG, STYLE, counted(V.echo_translator, log, "translate"), counted(patch_engine(), log, "ocr"))

    def run():
        query = start_intake(page_stream(spark, str(source)), work, checkpoint, available_now=True)
        try:
            query.awaitTermination(300)
        except Exception:  # the batch was killed
            return False
        return query.exception() is None

    assert not run()
    assert ledger.read("blocks") is None and ledger.read("artifacts") is None  # nothing is visible yet
    state["break"] = False
    assert run()
    kinds = [f.split("-")[0] for f in os.listdir(log)]
    assert (kinds.count("ocr"), kinds.count("translate")) == (2, 2)  # once per page
    assert N.stored_blocks(ledger).count() == 2 and len(ledger.folders("blocks")) == len(ledger.folders("artifacts")) == 1
    (source / "p3.png").write_bytes(png(page(3)))
    assert run() and N.stored_blocks(ledger).count() == 3 and N.stored_artifacts(ledger).count() == 3
