"""A batch run over a folder: detect, colour, translate, lay out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import blocks as B
from ..operators import raster as R
from ..operators import replies as P
from ..operators.layout import fit_font, place_horizontal, place_vertical
from ..operators.payload import request_payload
from ..operators.ranking import union_all
from ..operators.routing import route
from ..plugins import run_ocr, run_translator
from ..schema import RunConfig, StyleConfig
from ..session import ensure_checkpoint_dir
from ..sources.files import page_facts, path_exists, read_content, read_crops, read_images, with_base64
from ..sources.sinks import read_blocks, write_blocks

PAGE = ["page_id", "name", "status", "progress", "error", "n_blocks"]
# Fixed values.
DEFAULT_COLOURS = {"text_color": "#000000", "bg_color": "#FFFFFF"}


@dataclass(frozen=True)
class Run:
    pages: DataFrame  # PAGE columns, every page of the folder once
    blocks: DataFrame  # all block fields of completed pages


def with_colours(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Adds text_color and bg_color, estimated from the pixels under each block."""
    box = G.rect_int({c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}, F.col("width"), F.col("height"))
    rects = blocks.select("page_id", "ordinal", *[v.alias(k) for k, v in box.items()])
    keys = ["page_id", "ordinal"]
    size = rects.select(*keys, (F.col("x1") - F.col("x0")).alias("cw"), (F.col("y1") - F.col("y0")).alias("ch"))
    found = R.block_colours(read_crops(images, rects).join(size, keys), keys)
    joined = blocks.join(found, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in DEFAULT_COLOURS.items()})


def checkpointed(name: str, df: DataFrame) -> DataFrame:
    return df.checkpoint()


def translate_folder(spark: SparkSession, path: str | list[str], config: RunConfig, translator: Callable,
                     ocr_engine: Callable | None = None, ocr_online: bool = True, store: str | None = None,
                     decoder: Callable | None = None, keep: Callable[[str, DataFrame], DataFrame] = checkpointed) -> Run:
    """Run all pages of a folder, or the pages of a list of files.

    Routes: with OCR, regions go to `translator` as text requests; a vision
    provider without OCR gets the base64 picture instead and answers with
    whole blocks. Blank pages complete at once and undecodable ones fail; an
    error on one page leaves the others alone.

    One pass over the pictures gives the facts of every page, a second one the
    colours under the blocks. Facts, answers and found blocks are checkpointed,
    so each page is decoded and sent once also if executors are lost later.

    `store` is a table of block lists (`sinks.write_blocks`): pages that it
    knows are taken from it and reach no plug-in, and what this run completes
    is added, pages without text as empty lists. A run that was cut short goes
    on from there when it is started again. `decoder` reads the pictures that
    Spark's image source cannot, such as WebP. `keep` holds what must not be
    computed twice, by name: checkpoints here, results of a unit in
    `plans.finish`, where a run that is started again reads them.
    """
    ensure_checkpoint_dir(spark)
    images = read_images(spark, path, decoder)
    facts = keep("facts", page_facts(images))
    stored, known = _stored(spark, store, facts)
    todo = facts.join(known, "page_id", "left_anti")
    broken = todo.where(F.col("status") == "failed")
    decoded = todo.where(F.col("status") != "failed")
    wanted = decoded.where(~F.coalesce("is_solid", F.lit(False)))
    content = read_content(spark, path).join(wanted.select("page_id"), "page_id", "left_semi")
    pages = route(content.withColumns({"provider": F.lit(config.provider), "ocr_online": F.lit(ocr_online)}))
    unsupported = pages.where(F.col("route").isNull()).select("page_id", "error")
    routed = pages.where(F.col("route").isNotNull()).drop("error")

    text_side, text_errors = _by_text(routed.where(F.col("route") != "vision"), images, decoded, translator, ocr_engine, keep)
    vision_side, vision_errors = _by_vision(routed.where(F.col("route") == "vision"), decoded, translator, keep)
    errors = union_all([unsupported, text_errors, vision_errors,
                        broken.select("page_id", "error")]).groupBy("page_id").agg(F.min("error").alias("error"))
    errors = errors.checkpoint()
    fresh = text_side.unionByName(vision_side).join(errors, "page_id", "left_anti")
    if store:
        completed = decoded.join(errors, "page_id", "left_anti").select(F.col("page_id").alias("page_name"))
        fresh = fresh.checkpoint()
        write_blocks(fresh.withColumn("page_name", F.col("page_id")), store, time.time_ns(), completed)
    blocks = fresh.unionByName(stored)

    counts = blocks.groupBy("page_id").agg(F.count("*").alias("n_blocks"))
    listed = facts.select("page_id", "name").join(errors, "page_id", "left").join(counts, "page_id", "left")
    failed = F.col("error").isNotNull()
    status = listed.select(
        "page_id", "name", F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.lit(100)).alias("progress"), "error",
        F.when(~failed, F.coalesce("n_blocks", F.lit(0))).alias("n_blocks"))
    return Run(status.select(*PAGE), blocks)


def _stored(spark: SparkSession, store: str | None, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks that the store has for the pages of this folder, and the ids of all pages it knows."""
    if not store or not path_exists(spark, store):
        none = facts.select(*[F.lit(None).cast(t).alias(c) for c, t in zip(BLOCK_COLUMNS, _BLOCK_TYPES)]).where(F.lit(False))
        return none, facts.select("page_id").where(F.lit(False))
    known = spark.read.parquet(store).select(F.col("page_name").alias("page_id")).distinct().join(
        facts.select("page_id"), "page_id", "left_semi").checkpoint()  # as of now, before this run writes
    blocks = read_blocks(spark, store).withColumnRenamed("page_name", "page_id").join(
        facts.select("page_id", "width", "height"), "page_id").select(*BLOCK_COLUMNS)
    return blocks.checkpoint(), known


BLOCK_COLUMNS = ["page_id", "ordinal", "block_id", "original_text", "translated_text", "ymin", "xmin", "ymax", "xmax",
                 "text_color", "bg_color", "font_size_pct", "type", "width", "height"]


def _by_text(content: DataFrame, images: DataFrame, facts: DataFrame, translator: Callable,
             ocr_engine: Callable | None, keep: Callable[[str, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    if ocr_engine is None:
        none = facts.select(*[F.lit(None).cast(t).alias(c) for c, t in zip(BLOCK_COLUMNS, _BLOCK_TYPES)]).where(F.lit(False))
        return none, content.select("page_id", F.lit("No OCR engine").alias("error"))
    replies = keep("replies", run_ocr(content, ocr_engine))
    regions = B.corners_to_bounds(B.read_ocr(replies.drop("error")))
    found = keep("found", with_colours(B.normalise(regions, facts), images))
    # A page without regions makes no request.
    answers = keep("answers", run_translator(request_payload(found), translator))
    parsed = P.parse_reply(answers, "translations")
    blocks = P.attach_translations(found, P.translations(parsed), ["part", "pos"]).select(*BLOCK_COLUMNS)
    unread = B.ocr_errors(replies.where(F.col("error").isNull()).drop("error")).select("page_id", "error")
    errors = union_all([replies.select("page_id", "error"), unread, parsed.select("page_id", "error")])
    return blocks, errors.where(F.col("error").isNotNull())


def _by_vision(content: DataFrame, facts: DataFrame, translator: Callable, keep: Callable[[str, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    media = F.concat(F.lit("image/"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    media = F.regexp_replace(media, "image/jpg", "image/jpeg")
    pictures = with_base64(content.select("page_id", "content", media.alias("media_type")))
    requests = pictures.select("page_id", F.lit(0).alias("part"), F.to_json(F.struct("mime", "base64")).alias("payload"))
    answers = keep("vision_answers", run_translator(requests, translator).drop("part"))
    parsed = P.parse_reply(answers, "blocks")
    blocks = P.repair_blocks(parsed).join(facts.select("page_id", "width", "height"), "page_id").select(*BLOCK_COLUMNS)
    return blocks, parsed.where(F.col("error").isNotNull()).select("page_id", "error")


_BLOCK_TYPES = ["string", "int", "string", "string", "string", "double", "double", "double", "double", "string", "string",
                "double", "string", "int", "int"]


def lay_out(blocks: DataFrame, style: StyleConfig) -> tuple[DataFrame, DataFrame]:
    """(glyphs of vertical blocks, lines of horizontal blocks) with their positions."""
    fitted = fit_font(blocks, style)
    return place_vertical(fitted), place_horizontal(fitted)
