"""Blocks of a page as JSON: translation requests, cache content, render hash.

A page is one document at any size. A caller whose service bounds its requests
passes `part_rows`; the parts are then separate valid requests of that many
blocks, and block ids keep them apart on the way back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import round_half_up, text_or
from ..schema import BLOCK_FIELDS, StyleConfig
from .ranking import ordered_parts


def request_payload(blocks: DataFrame, part_rows: int | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """(page_id, part, n_items, payload, …): id, text and rounded percents per block in order."""
    item = F.struct(
        F.col("block_id").alias("id"), F.col("original_text").alias("text"),
        *[round_half_up(F.col(c)).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    parts = ordered_parts(blocks, ["page_id"], "ordinal", item, "_items", part_rows, extra)
    return parts.withColumn("payload", F.to_json("_items")).drop("_items")


def block_struct(blocks: DataFrame) -> Column:
    """All stored fields of a block; the table's `block_id` is the stored `id`."""
    names = {"id": "block_id"}
    return F.struct(*[F.col(names.get(f, f)).alias(f) for f in BLOCK_FIELDS])


def blocks_json(blocks: DataFrame, key: str = "page_id", part_rows: int | None = None, dealt_by: Sequence[str] = ()) -> DataFrame:
    """(key, part, n_items, blocks_json): every stored field, in order.

    `dealt_by`: columns with one value per `key`. Blocks that are dealt to tasks by them already are not shuffled again.
    """
    parts = ordered_parts(blocks, [*dealt_by, key], "ordinal", block_struct(blocks), "_items", part_rows)
    return parts.select(key, "part", "n_items", F.to_json("_items").alias("blocks_json"))


def _number_text(value: float) -> str:
    """Numbers as a browser prints them: 1.0 is 1."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def style_text(style: StyleConfig) -> str:
    """The style part of the render hash: 15 fields, without the compression flag."""
    values = [style.font_family, style.font_size_scale, style.text_color_mode, style.custom_text_color,
              style.bg_color_mode, style.custom_bg_color, style.bg_opacity, style.text_shadow, style.text_stroke,
              style.stroke_color, style.stroke_width, style.font_bold, style.font_italic,
              style.auto_fit_font_size, style.onomatopoeia_mode]
    return "-".join(str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else _number_text(v)
                    for v in values)


def render_hash(blocks: DataFrame, style: StyleConfig, extra: Sequence[Column] = ()) -> DataFrame:
    """(page_id, render_hash, …) over style, text, colours and type; `extra` aggregates over page_id come along.

    Geometry and font size are not part of it; `layout_hash` includes them.
    """
    item = F.concat_ws("-", F.coalesce("translated_text", F.lit("")), F.coalesce("text_color", F.lit("")),
                       F.coalesce("bg_color", F.lit("")), text_or(F.col("type"), "bubble"))
    return _page_hash(blocks, item, style_text(style), "render_hash", extra)


def layout_hash(blocks: DataFrame, style: StyleConfig) -> DataFrame:
    """(page_id, layout_hash): as `render_hash`, with geometry, font size and escaped fields."""
    return _page_hash(blocks, F.to_json(block_struct(blocks)), style_text(style) + f"-{style.export_compressed}".lower(), "layout_hash")


def _page_hash(blocks: DataFrame, item: Column, prefix: str, name: str, extra: Sequence[Column] = ()) -> DataFrame:
    """SHA-256 over the style, the number of blocks and the sum of their digests.

    A block's digest covers its ordinal and its text, so order and content both
    count; four 60-bit words of it are summed. Sums are combined before the
    shuffle: no task holds the blocks of a page, and one rule fits every size.
    """
    digests = blocks.select("page_id", F.sha2(F.concat(F.col("ordinal").cast("string"), F.lit(":"), item), 256).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return digests.groupBy("page_id").agg(
        F.sha2(F.concat_ws("-", F.lit(prefix), F.count("*").cast("string"), *words), 256).alias(name), *extra)
