"""Model replies: extract, check, repair, attach to blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import array_of, envelope_text, field_number, field_text, with_json
from ..functions.names import block_id
from ..functions.semantics import clamp, number_or, text_or
from .ranking import last_wins

BAD_JSON = "JSON parse failed"
BAD_SHAPE = "Invalid response structure"
EMPTY_REPLY = "Empty response"


def open_envelope(df: DataFrame, provider: str, envelope: str = "envelope") -> DataFrame:
    """Chat answer to `raw` reply text and `error`."""
    text = envelope_text(F.col(envelope), provider)
    empty = text.isNull() | (text == "")
    return df.select(*[c for c in df.columns if c != envelope],
                     F.when(~empty, text).alias("raw"), F.when(empty, F.lit(EMPTY_REPLY)).alias("error"))


def parse_reply(df: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """`items` (array of variants under `key`) and `error`; exactly one of them is set."""
    parsed = with_json(df, raw, "_v").withColumn("items", array_of(F.col("_v"), key))
    error = F.when(F.col("_v").isNull(), F.lit(BAD_JSON)).when(F.col("items").isNull(), F.lit(BAD_SHAPE))
    if "error" in df.columns:
        error = F.coalesce(F.col("error"), error)
    return parsed.withColumn("error", error).drop("_v", raw)


def explode_items(parsed: DataFrame) -> DataFrame:
    """One row per reply item with its position.

    The outer form keeps the optimizer from testing `items` before the explode,
    which would parse every reply twice.
    """
    keep = [c for c in parsed.columns if c not in ("items", "error")]
    return parsed.select(*keep, F.posexplode_outer("items").alias("pos", "item")).where(F.col("pos").isNotNull())


def translations(parsed: DataFrame) -> DataFrame:
    """Text-only replies: (…, pos, block_id, translated_text, type)."""
    rows = explode_items(parsed)
    item = F.col("item")
    return rows.select(*[c for c in rows.columns if c != "item"],
                       field_text(item, "id").alias("block_id"),
                       F.coalesce(field_text(item, "translated_text"), F.lit("")).alias("translated_text"),
                       text_or(field_text(item, "type"), "bubble").alias("type"))


def repair_blocks(parsed: DataFrame) -> DataFrame:
    """Vision replies: one full block per item, gaps filled with the fixed defaults."""
    rows = explode_items(parsed)
    item = F.col("item")
    return rows.select(
        *[c for c in rows.columns if c not in ("item", "pos")],
        F.col("pos").alias("ordinal"),
        block_id(F.col("page_id"), F.col("pos")).alias("block_id"),
        text_or(field_text(item, "original_text"), "").alias("original_text"),
        text_or(field_text(item, "translated_text"), "").alias("translated_text"),
        *[clamp(field_number(item, c), 0.0, 100.0).alias(c) for c in ("ymin", "xmin", "ymax", "xmax")],
        text_or(field_text(item, "text_color"), "#FFFFFF").alias("text_color"),
        text_or(field_text(item, "bg_color"), "#000000").alias("bg_color"),
        number_or(field_number(item, "font_size_pct"), 2.0).alias("font_size_pct"),
        text_or(field_text(item, "type"), "bubble").alias("type"))


def attach_translations(blocks: DataFrame, items: DataFrame, order: list[str]) -> DataFrame:
    """Left join on page and block id; of equal ids the last in `order` counts.

    A block without an item keeps its original text and its own type (or
    bubble); an item with an empty text gives an empty text.
    """
    chosen = last_wins(items.select("page_id", "block_id", *order, "translated_text", "type"),
                       ["page_id", "block_id"], order)
    right = chosen.select("page_id", "block_id", F.col("translated_text").alias("_text"), F.col("type").alias("_type"),
                          F.lit(True).alias("_found"))
    joined = blocks.join(right, ["page_id", "block_id"], "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    own = text_or(F.col("type"), "bubble") if "type" in blocks.columns else F.lit("bubble")
    keep = [c for c in blocks.columns if c not in ("translated_text", "type")]
    return joined.select(*keep, F.when(found, F.col("_text")).otherwise(F.col("original_text")).alias("translated_text"),
                         F.when(found, F.col("_type")).otherwise(own).alias("type"))
