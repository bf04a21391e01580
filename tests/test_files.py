"""Folders, images, sinks, plug-ins and the batch run, on files written by the test."""

import base64
import json
import os
import struct
import tempfile
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import plugins as V
from pagewright.operators import raster as R
from pagewright.operators.manifest import orphans
from pagewright.plans.translate import lay_out, translate_folder
from pagewright.schema import BLOCK_FIELDS, RunConfig, StyleConfig
from pagewright.sources import files as S
from pagewright.sources import sinks as K


def png(img, alpha=False):
    """A PNG of an array in RGB (grey if two-dimensional)."""
    if img.ndim == 2:
        kind, flat = 0, img[..., None]
    else:
        kind, flat = (6, np.dstack([img, np.full(img.shape[:2], 255)])) if alpha else (2, img)
    h, w = img.shape[:2]
    raw = b"".join(b"\0" + flat[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def page(seed):
    """A light page of 80 by 150 with a dark patch at (20, 70) of 30 by 12."""
    img = np.full((150, 80, 3), 240)
    img[70:82, 20:50] = (10, 20, 200 + seed)
    return img


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    cache = root / "translation_cache"
    cache.mkdir()
    for i in (1, 2, 10):
        (root / f"p{i}.png").write_bytes(png(page(i)))
    (root / "blank.png").write_bytes(png(np.full((70, 30, 3), 99)))
    (root / "grey.PNG").write_bytes(png(page(0)[..., 0]))
    (root / "alpha.png").write_bytes(png(page(0), alpha=True))
    (root / "bad.png").write_bytes(b"not a picture")
    (root / "p1.png_erased.png").write_bytes(png(page(1)))
    (root / "notes.txt").write_text("x")
    block = {"id": "b0", "original_text": "x", "translated_text": "y", "ymin": 1, "xmin": 2, "ymax": 3, "xmax": 4,
             "text_color": "#000000", "bg_color": "#ffffff", "font_size_pct": 2.0, "type": "bubble"}
    (cache / "p1.png_blocks.json").write_text(json.dumps([block, {**block, "id": "b1"}]))
    (root / "p1.png_blocks.json").write_text("[]")
    (cache / "p2.png_blocks.json").write_text("[1,")
    (root / "p2.png_blocks.json").write_text(json.dumps([block]))
    (root / "p10.png_blocks.json").write_text(json.dumps([block]))
    return str(root)


def test_scan_and_listing(spark, folder):
    names = {r.name for r in S.scan_pages(spark, folder).collect()}
    assert names == {"p1.png", "p2.png", "p10.png", "blank.png", "grey.PNG", "alpha.png", "bad.png"}
    scan = S.scan_pages(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan  # names are listed without reading any picture
    listed = {(r.file_name, r.location): (r.kind, r.owner) for r in S.list_artifacts(spark, folder).collect()}
    assert listed[("p1.png_blocks.json", "cache")] == ("blocks", "p1.png")
    assert listed[("p1.png_erased.png", "root")] == ("erased", "p1.png")
    assert listed[("notes.txt", "root")] == (None, None)


def test_block_cache(spark, folder):
    cache = S.read_block_cache(spark, folder)
    # The broken cache file of p2 hides the good one in the root.
    assert {r.name: r.has_ocr_cache for r in cache.collect()} == {"p1.png": True, "p2.png": False, "p10.png": True}
    blocks = [(r.name, r.ordinal, r.block_id, r.xmin) for r in S.cached_blocks(cache).orderBy("name", "ordinal").collect()]
    assert blocks == [("p1.png", 0, "b0", 2.0), ("p1.png", 1, "b1", 2.0), ("p10.png", 0, "b0", 2.0)]


def test_images(spark, folder):
    images = S.read_images(spark, folder)
    got = {r.name: (r.width, r.height, r.n_channels, r.status, r.error) for r in images.drop("data").collect()}
    assert got["p1.png"] == (80, 150, 3, "idle", None)
    assert got["grey.PNG"][:3] == (80, 150, 1) and got["alpha.png"][:3] == (80, 150, 4)
    assert got["bad.png"] == (None, None, None, "failed", "Failed to decode image")
    dims = S.read_content(spark, folder).select("name", *[v.alias(k) for k, v in S.png_dims(F.col("content")).items()]).collect()
    assert {r.name: (r.width, r.height) for r in dims}["p10.png"] == (80, 150)
    assert {r.name: r.width for r in dims}["bad.png"] is None


@pytest.mark.parametrize("name, seed", [("p2.png", 2), ("alpha.png", 0), ("grey.PNG", None)])
def test_pixels_and_crops(spark, folder, name, seed):
    images = S.read_images(spark, folder).where(F.col("name") == name)
    want = page(seed or 0)[..., ::-1] if seed is not None else np.repeat(page(0)[..., :1], 3, axis=2)
    out = np.zeros_like(want)
    for r in S.read_pixels(images).collect():
        out[r.y, r.x] = (r.b, r.g, r.r)
    assert (out == want).all()
    rects = images.select("page_id", F.lit(3).alias("ordinal"), F.lit(15).alias("x0"), F.lit(60).alias("y0"), F.lit(55).alias("x1"),
                          F.lit(140).alias("y1"))
    crop = np.zeros((80, 40, 3), int)
    rows = S.read_crops(images, rects).collect()
    for r in rows:
        crop[r.y, r.x] = (r.b, r.g, r.r)
    assert len(rows) == 3200 and (crop == want[60:140, 15:55]).all()


def test_solid_pages(spark, folder):
    images = S.read_images(spark, folder)
    got = {r.page_id.rsplit("/", 1)[1]: r.is_solid for r in S.solid_pages(images).collect()}
    assert got["blank.png"] is True and got["p1.png"] is False and "bad.png" not in got
    by_rows = {r.page_id: r.is_solid for r in R.is_solid(S.read_pixels(images), ["page_id"]).collect()}
    assert by_rows == {r.page_id: r.is_solid for r in S.solid_pages(images).collect()}


def test_base64_is_one_line(spark):
    df = spark.createDataFrame([(bytearray(range(200)), "")], "content binary, media_type string")
    row = S.with_base64(df).head()
    assert row.base64 == base64.b64encode(bytes(range(200))).decode() and row.mime == "image/jpeg"


def stored_blocks(spark, text, n=25):
    return spark.range(n).select(
        F.lit("p.png").alias("page_name"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("b"), "id").alias("block_id"),
        F.lit("o").alias("original_text"), F.lit(text).alias("translated_text"),
        *[F.col("id").cast("double").alias(c) for c in ("ymin", "xmin", "ymax", "xmax")], F.lit("#000000").alias("text_color"),
        F.lit("#ffffff").alias("bg_color"), F.lit(2.0).alias("font_size_pct"), F.lit("bubble").alias("type"))


def test_block_sink_keeps_newest(spark, tmp_path):
    path = str(tmp_path / "blocks")
    K.write_blocks(stored_blocks(spark, "first", 40), path, 1, part_rows=10)
    K.write_blocks(stored_blocks(spark, "second"), path, 2, part_rows=10)
    K.write_blocks(stored_blocks(spark, "second"), path, 2, part_rows=10)  # a repeated batch
    got = K.read_blocks(spark, path).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(25)) and {r.translated_text for r in got} == {"second"}
    assert set(got[0].asDict()) - {"page_name", "ordinal"} == set(BLOCK_FIELDS) - {"id"} | {"block_id"}


def test_emptied_pages_stay_empty(spark, tmp_path):
    path, pages = str(tmp_path / "blocks"), spark.createDataFrame([("p.png",), ("q.png",)], "page_name string")
    both = stored_blocks(spark, "first", 2).unionByName(stored_blocks(spark, "first", 3).withColumn("page_name", F.lit("q.png")))
    K.write_blocks(both, path, 1, pages)
    K.write_blocks(both.where("page_name = 'q.png'"), path, 2, pages)
    assert {r.page_name for r in K.read_blocks(spark, path).collect()} == {"q.png"}
    K.write_blocks(stored_blocks(spark, "third", 1), path, 3)  # no page list: nothing is said about q.png
    assert sorted(r.page_name for r in K.read_blocks(spark, path).collect()) == ["p.png", "q.png", "q.png", "q.png"]
    K.compact(spark, path, str(tmp_path / "compact"), ["page_name"])
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert compact.count() == 2
    assert K.read_blocks(spark, str(tmp_path / "compact")).count() == 4
    done = K.write_block_files(both.where("page_name = 'q.png'"), str(tmp_path), pages).collect()
    assert {r.error for r in done} == {None}
    assert (tmp_path / "translation_cache" / "p.png_blocks.json").read_text() == "[]"


def test_unwritable_pages_give_an_error_row(spark):
    done = K.write_block_files(stored_blocks(spark, "x", 2), "nowhere://bucket/folder").collect()
    assert len(done) == 1 and done[0].error


def test_block_files_and_cleanup(spark, tmp_path):
    folder = str(tmp_path)
    many = stored_blocks(spark, "many").withColumn("page_name", F.lit("a b.png"))
    one = stored_blocks(spark, "one", 1)
    written = K.write_block_files(many.unionByName(one), folder).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in written) == ["a b.png_blocks.json", "p.png_blocks.json"]
    assert {r.error for r in written} == {None}
    rows = S.cached_blocks(S.read_block_cache(spark, folder)).orderBy("name", "ordinal").collect()
    assert [(r.name, r.ordinal, r.block_id) for r in rows] == [("a b.png", i, f"b{i}") for i in range(25)] + [("p.png", 0, "b0")]
    pages = spark.createDataFrame([("p.png",)], "name string")
    gone = orphans(S.list_artifacts(spark, folder), pages)
    assert [r.error for r in K.delete_files(gone).collect()] == [None]
    assert [p.name for p in (tmp_path / "translation_cache").iterdir() if p.suffix == ".json"] == ["p.png_blocks.json"]
    missing = spark.createDataFrame([(folder + "/nothing.png",)], "path string")
    assert K.delete_files(missing).head().error is None


def test_artifact_sink(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    rows = lambda tag: spark.createDataFrame([("p", "erased", tag, bytearray(tag.encode()))],
                                             "page_name string, kind string, render_hash string, content binary")
    K.write_artifacts(rows("h1"), path, 1)
    K.write_artifacts(rows("h2"), path, 2)
    assert [r.render_hash for r in K.read_artifacts(spark, path).collect()] == ["h2"]
    assert [r.render_hash for r in K.read_artifacts(spark, path, False).collect()] == ["h2"]
    K.replace_pages(spark.range(3), str(tmp_path / "pages"))
    K.replace_pages(spark.range(2), str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 2


def patch_engine():
    """Stub OCR: one region where the test pages have their patch; fails on one page."""
    poison = png(page(2))

    def load():
        def detect(content):
            if content == poison:
                raise ValueError("engine fell over")
            return [{"text": " hello ", "box": [[18, 68], [52, 68], [52, 84], [18, 84]], "confidence": 0.9}]

        return detect

    return load


def test_batch_run(spark, folder):
    run = translate_folder(spark, folder, RunConfig(provider="openai"), V.echo_translator, patch_engine())
    pages = {r.name: (r.status, r.error, r.n_blocks) for r in run.pages.collect()}
    assert pages["blank.png"] == ("completed", None, 0)
    assert pages["bad.png"] == ("failed", "Failed to decode image", None)
    assert pages["p2.png"] == ("failed", "engine fell over", None)
    assert pages["p1.png"] == ("completed", None, 1)
    block = run.blocks.where(F.col("page_id").endswith("/p1.png")).head()
    assert (block.original_text, block.translated_text, block.type) == ("hello", "HELLO", "bubble")
    assert (block.text_color, block.bg_color) == ("#0a14c9", "#f0f0f0")
    vertical, horizontal = lay_out(run.blocks, StyleConfig())
    assert vertical.count() == 0 and horizontal.count() >= 4


def test_vision_and_unsupported_routes(spark, folder):
    def vision():
        return lambda payload: json.dumps({"blocks": [{"original_text": json.loads(payload)["mime"], "ymin": "5", "xmax": 200}]})

    run = translate_folder(spark, folder, RunConfig(provider="gemini"), vision, ocr_online=False)
    blocks = run.blocks.collect()
    assert len(blocks) == 5 and {(b.original_text, b.ymin, b.xmax, b.font_size_pct) for b in blocks} == {("image/png", 5.0, 100.0, 2.0)}
    run = translate_folder(spark, folder, RunConfig(provider="none"), vision)
    assert {r.error for r in run.pages.where("status = 'failed'").collect()} == {"Unsupported provider: none", "Failed to decode image"}


def test_a_second_run_sends_nothing(spark, folder, tmp_path):
    log = tempfile.mkdtemp()

    def counted(factory, kind):
        def model():
            work = factory()

            def call(x):
                open(f"{log}/{kind}-{os.getpid()}-{time.time_ns()}", "w").close()
                return work(x)

            return call

        return model

    store = str(tmp_path / "store")
    run = lambda: translate_folder(spark, folder, RunConfig(provider="openai"), counted(V.echo_translator, "translate"),
                                   counted(patch_engine(), "ocr"), store=store)
    first = run()
    assert "image" not in first.pages._jdf.queryExecution().optimizedPlan().toString().lower().replace("image_", "")
    want = sorted(map(tuple, first.pages.collect())), sorted(map(tuple, first.blocks.collect()))
    calls = len(os.listdir(log))
    assert calls
    second = run()
    again = sorted(map(tuple, second.pages.collect())), sorted(map(tuple, second.blocks.collect()))
    failed = first.pages.where("error = 'engine fell over'").count()
    assert again == want and len(os.listdir(log)) == calls + failed  # only pages that failed are tried again


def test_a_decoder_completes_what_spark_cannot_read(spark, tmp_path):
    (tmp_path / "a.webp").write_bytes(b"RIFFxxxxWEBP")
    (tmp_path / "b.webp").write_bytes(b"broken")
    (tmp_path / "c.png").write_bytes(png(page(1)))

    picture = page(3)[..., ::-1]

    def decoder():
        def decode(content):
            if content == b"broken":
                raise ValueError("no picture")
            return picture

        return decode

    run = translate_folder(spark, str(tmp_path), RunConfig(provider="openai"), V.echo_translator, patch_engine(), decoder=decoder)
    assert {r.name: (r.status, r.error) for r in run.pages.collect()} == {
        "a.webp": ("completed", None), "b.webp": ("failed", "Failed to decode image"), "c.png": ("completed", None)}
    assert {r.text_color for r in run.blocks.collect()} == {"#0a14cb", "#0a14c9"}


def test_translator_failures_stay_on_their_page(spark):
    def moody():
        def answer(payload):
            if "bad" in payload:
                raise RuntimeError("no answer")
            return payload

        return answer

    requests = spark.createDataFrame([(1, 0, "ok"), (2, 0, "bad"), (3, 0, "ok")], "page_id int, part int, payload string")
    got = {r.page_id: (r.raw, r.error) for r in V.run_translator(requests, moody).collect()}
    assert got == {1: ("ok", None), 2: (None, "no answer"), 3: ("ok", None)}


def test_inpainter_works_in_tiles(spark):
    img = np.full((40, 50, 3), 200)
    img[18:22, 18:22] = 0
    rows = [(1, x, y, *map(int, img[y, x])) for y in range(40) for x in range(50)]
    pixels = spark.createDataFrame(rows, "page_id int, x int, y int, b int, g int, r int")
    mask = pixels.where("b = 0").select("page_id", "x", "y")
    log = tempfile.mkdtemp()

    def model():
        open(f"{log}/{os.getpid()}-{time.time_ns()}", "w").close()  # one file per load

        def fill(image, hole):
            image = image.copy()
            image[hole] = 200
            return image

        return fill

    out = V.run_inpainter(pixels, mask.unionByName(mask), model, tile=20, halo=4).coalesce(1).collect()
    assert len(out) == 2000 and {(r.x, r.y) for r in out} == {(r[1], r[2]) for r in rows}
    assert {(r.b, r.g, r.r) for r in out} == {(200, 200, 200)}
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert 1 <= len(os.listdir(log)) <= int(tasks)


def test_inpainter_falls_back_where_the_model_fails(spark):
    pixels = spark.createDataFrame([(p, x, 0, 10 * p + x, 0, 0) for p in (1, 2) for x in range(5)], "page_id int, x int, y int, b int, g int, r int")
    mask = pixels.where("x = 0").select("page_id", "x", "y")

    def model():
        def fill(image, hole):
            if image[1:].sum() >= 0 and image[0, 1, 0] > 15:
                raise ValueError("out of memory")
            return np.full_like(image, 99)

        return fill

    got = {(r.page_id, r.x): r.b for r in V.run_inpainter(pixels, mask, model).collect()}
    assert got[1, 0] == 99 and got[2, 0] == 22 and got[1, 3] == 13


def test_default_fill_does_not_know_tiles(spark):
    """A page past the tile size has one fill, as a small one."""
    pixels = spark.range(600).select(F.lit(1).alias("page_id"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"),
                                     *[F.when(F.col("id") < 300, 10).otherwise(200).alias(c) for c in "bgr"])
    mask = pixels.where("x IN (0, 599)").select("page_id", "x", "y")
    assert {r.b for r in V.run_inpainter(pixels, mask).where("x IN (0, 599)").collect()} == {105}


def test_glyph_width_table(spark):
    rows = {r.char_class: r.em for r in V.glyph_widths(spark).collect()}
    assert rows["wide"] == 1.0 and rows["other"] == 0.5
    got = spark.range(1).select(V.text_width_px(F.lit("あim x"), F.lit(8.0))).head()[0]
    assert got == (1.0 + 0.25 + 0.875 + 0.25 + 0.5) * 8


def test_block_lists_of_dealt_blocks_are_not_shuffled_again(spark):
    rows = [(p, str(p), i, f"b{i}", "o", f"t{p}{i}", 1.0, 2.0, 3.0, 4.0, "#000000", "#ffffff", 2.0, "bubble") for p in range(20) for i in range(p % 4)]
    blocks = spark.createDataFrame(rows, "page_id int, page_name string, ordinal int, block_id string, original_text string, translated_text string, ymin double, "
                                         "xmin double, ymax double, xmax double, text_color string, bg_color string, font_size_pct double, type string")
    dealt = blocks.repartition(3, "page_id")
    plain, spared = K.block_lists(dealt, 1), K.block_lists(dealt, 1, dealt_by=["page_id"])
    assert spared.columns == plain.columns and sorted(spared.collect()) == sorted(plain.collect())
    shuffles = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") for df in (plain, spared)]
    assert shuffles == [2, 1]
