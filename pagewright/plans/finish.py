"""From pictures to stored results: translate, erase, fill, blend, hash and publish, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.blocks import visible_for
from ..operators.erase import erase_page, finish_inpaint
from ..operators.payload import render_hash
from ..operators.raster import CHANNELS
from ..plugins import run_inpainter
from ..schema import BLOCK, RunConfig, StyleConfig
from ..session import ensure_checkpoint_dir
from ..sources.files import read_crops, read_images
from ..sources.ledger import Ledger
from ..sources.png import patched_pages
from ..sources.sinks import block_lists, newest
from .translate import Run, translate_folder

AROUND = 64  # pixels round a block that its erasing may look at
BLOCK_LISTS, ARTIFACTS, PAGES = "blocks", "artifacts", "pages"  # names in a ledger


def _pixels_near(images: DataFrame, blocks: DataFrame, margin: int) -> DataFrame:
    """Pixels under the blocks and `margin` round them, each position once; no other byte of a picture becomes a row."""
    box = G.rect_int({c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}, F.col("width"), F.col("height"))
    rects = blocks.select("page_id", "ordinal", "width", "height", *[v.alias(k) for k, v in box.items()])
    grown = rects.select("page_id", "ordinal", F.greatest(F.lit(0), F.col("x0") - margin).alias("x0"), F.greatest(F.lit(0), F.col("y0") - margin).alias("y0"),
                         F.least("width", F.col("x1") + margin).alias("x1"), F.least("height", F.col("y1") + margin).alias("y1"))
    corner = grown.select("page_id", "ordinal", F.col("x0").alias("_x"), F.col("y0").alias("_y"))
    pixels = read_crops(images, grown).join(corner, ["page_id", "ordinal"])
    return pixels.select("page_id", (F.col("x") + F.col("_x")).alias("x"), (F.col("y") + F.col("_y")).alias("y"), *CHANNELS).dropDuplicates(["page_id", "x", "y"])


def erased_pictures(images: DataFrame, blocks: DataFrame, style: StyleConfig, inpainter: Callable | None = None,
                    fill: str = "around", margin: int = AROUND) -> DataFrame:
    """(page_id, width, height, content): PNG pictures without the text of their blocks.

    `blocks` carry the width and height of their page. Bubbles on an even
    ground are filled flat, the rest is inpainted, smoothed and blended in.
    Only pixels up to `margin` from a block are looked at, so the work grows
    with the text and not with the pages. Pages without a visible block have no row.
    """
    shown = visible_for(blocks, "erase", style.onomatopoeia_mode)
    pixels = _pixels_near(images, shown, margin).checkpoint()
    plan = erase_page(pixels, shown, style.onomatopoeia_mode)
    erased, mask = plan.pixels.checkpoint(), plan.mask.checkpoint()
    inpainted = run_inpainter(erased, mask, inpainter, fill=fill)
    feather = G.radii(F.col("width"), F.col("height"))["feather_radius"]
    sizes = shown.groupBy("page_id").agg(F.first("width").alias("width"), F.first("height").alias("height")).select(
        "page_id", F.col("width").alias("cw"), F.col("height").alias("ch"), feather.alias("feather_radius"))
    return patched_pages(images, finish_inpaint(erased, inpainted, mask, sizes))


def run_unit(spark: SparkSession, path: str | list[str], ledger: Ledger, unit: str, version: int, config: RunConfig, style: StyleConfig,
             translator: Callable, ocr_engine: Callable | None = None, ocr_online: bool = True, decoder: Callable | None = None,
             inpainter: Callable | None = None, fill: str = "around") -> None:
    """All pages of a folder (or of a list of files) to the end, once: pages, block lists and erased pictures of one unit.

    Every result is in the ledger before the next one is begun, so a unit that
    broke off goes on behind its last result: no page is sent to a plug-in
    again. Readers see the three tables when all of them are whole.
    """
    ensure_checkpoint_dir(spark)
    if ledger.closed(unit):
        return

    def keep(name: str, df: DataFrame) -> DataFrame:
        return ledger.step(unit, name, lambda: df)

    run: Run = translate_folder(spark, path, config, translator, ocr_engine, ocr_online, decoder=decoder, keep=keep)
    fresh = keep("fresh", run.blocks)
    pages = keep(PAGES, run.pages.withColumn("version", F.lit(version).cast("long")))
    done = pages.where(F.col("status") == "completed").select(F.col("page_id").alias("page_name"))
    keep(BLOCK_LISTS, block_lists(fresh.withColumn("page_name", F.col("page_id")), version, done))
    ledger.step(unit, ARTIFACTS, lambda: _artifacts(spark, path, fresh, style, version, decoder, inpainter, fill))
    ledger.close(unit)


def _artifacts(spark: SparkSession, path: str | list[str], blocks: DataFrame, style: StyleConfig, version: int,
               decoder: Callable | None, inpainter: Callable | None, fill: str) -> DataFrame:
    images = read_images(spark, path, decoder).where(F.col("data").isNotNull())
    pictures = erased_pictures(images, blocks, style, inpainter, fill)
    hashes = render_hash(blocks, style)
    return pictures.join(hashes, "page_id", "left").select(
        F.col("page_id").alias("page_name"), F.lit("erased").alias("kind"), "render_hash", "content", F.lit(version).cast("long").alias("version"))


def stored_pages(ledger: Ledger) -> DataFrame | None:
    """The newest row of every page."""
    rows = ledger.read(PAGES)
    return None if rows is None else newest(rows, "page_id").dropDuplicates(["page_id"])


def stored_blocks(ledger: Ledger) -> DataFrame | None:
    """The newest blocks of every page: page_name, ordinal and the block fields."""
    rows = ledger.read(BLOCK_LISTS)
    if rows is None:
        return None
    rows = newest(rows, "page_name").dropDuplicates(["page_name", "version", "part"])
    items = rows.select("page_name", (F.col("part") * F.col("part_rows")).alias("_base"),
                        F.posexplode(F.from_json("blocks_json", f"array<{BLOCK.simpleString()}>")).alias("_pos", "_b"))
    return items.select("page_name", (F.col("_base") + F.col("_pos")).alias("ordinal"),
                        *[F.col("_b")[f.name].alias("block_id" if f.name == "id" else f.name) for f in BLOCK.fields])


def stored_artifacts(ledger: Ledger) -> DataFrame | None:
    """The newest artifact per page and kind."""
    rows = ledger.read(ARTIFACTS)
    if rows is None:
        return None
    best = rows.groupBy("page_name", "kind").agg(F.max("version").alias("version"))
    return rows.join(best, ["page_name", "kind", "version"], "left_semi").dropDuplicates(["page_name", "kind"])


def to_the_end(ledger: Ledger, config: RunConfig, style: StyleConfig, translator: Callable, ocr_engine: Callable | None = None,
               **more) -> Callable[[DataFrame, int], None]:
    """Work for `streaming.intake.start_intake`: every micro-batch of new pages is a unit of the ledger.

    A batch that is repeated after a failure, under the same id, goes on where
    it broke off; one that was closed does nothing. The names of a batch's
    files come to the driver, as many as the stream's `max_files`.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        unit = f"batch{batch_id}"
        if ledger.closed(unit):
            return
        spark = batch.sparkSession
        files = ledger.step(unit, "files", lambda: batch.select("page_id", "name"))
        paths = sorted(r["page_id"] for r in files.select("page_id").collect())
        if paths:
            run_unit(spark, paths, ledger, unit, batch_id, config, style, translator, ocr_engine, **more)
        else:
            ledger.close(unit)

    return work
