"""Detected text regions: four engine shapes into one block table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.names import block_id
from ..functions.semantics import browser_trim
from ..schema import BBOX_LINE, OCR_REPLY

DETECTED = ["text", "box", "confidence"]


def _whole_corners(box: Column) -> Column:
    """Corners as whole pixels, fractions dropped."""
    return F.transform(box, lambda p: F.transform(F.slice(p, 1, 2), lambda v: v.cast("int")))


def _explode_items(df: DataFrame, items: Column) -> DataFrame:
    """One row per item with its `ordinal`; a page without items gives no row."""
    keep = [c for c in df.columns if not c.startswith("_")]
    # The outer form keeps the optimizer from parsing once more in a filter before the explode.
    out = df.select(*keep, F.posexplode_outer(items).alias("ordinal", "_item")).where(F.col("ordinal").isNotNull())
    return out.select(*keep, "ordinal", *[F.col("_item")[c].alias(c) for c in DETECTED])


def read_ocr(df: DataFrame, json_col: str = "reply") -> DataFrame:
    """Canonical reply JSON to one row per region. A reply that is no JSON or has another shape gives no rows; see `ocr_errors`."""
    return _explode_items(df.withColumn("_r", F.from_json(json_col, OCR_REPLY)).drop(json_col), F.col("_r.blocks"))


def ocr_errors(df: DataFrame, json_col: str = "reply") -> DataFrame:
    """Pages whose reply `read_ocr` cannot read, with the reason; they never fail the job.

    The same parse decides both: a reply without a list of blocks is an error,
    an empty list is a page without text. A missing reply is one too.
    """
    bad = df.where(F.from_json(json_col, OCR_REPLY)["blocks"].isNull())
    return bad.withColumn("error", F.lit("Invalid OCR reply")).drop(json_col)


def from_parallel_arrays(df: DataFrame) -> DataFrame:
    """Shape with `rec_texts`, `rec_scores`, `rec_polys`: no score is 1.0, no polygon drops the entry."""
    entries = F.transform(F.col("rec_texts"), lambda text, i: F.struct(
        text.alias("text"),
        F.get(F.col("rec_polys"), i).alias("box"),
        F.when(i < F.size("rec_scores"), F.get(F.col("rec_scores"), i)).otherwise(F.lit(1.0)).alias("confidence")))
    kept = F.filter(entries, lambda e: e["box"].isNotNull())
    whole = F.transform(kept, lambda e: F.struct(e["text"].alias("text"), _whole_corners(e["box"]).alias("box"),
                                                 e["confidence"].alias("confidence")))
    return _explode_items(df.withColumn("_e", whole).drop("rec_texts", "rec_scores", "rec_polys"), F.col("_e"))


def _from_lines(df: DataFrame, json_col: str, text: Callable[[Column], Column],
                confidence: Callable[[Column], Column]) -> DataFrame:
    lines = F.from_json(json_col, "array<array<string>>")
    parsed = F.transform(lines, lambda line: F.struct(
        text(line).alias("text"),
        _whole_corners(F.from_json(F.get(line, F.lit(0)), "array<array<double>>")).alias("box"),
        confidence(line).alias("confidence")))
    return _explode_items(df.withColumn("_e", parsed).drop(json_col), F.col("_e"))


def from_nested_lines(df: DataFrame, json_col: str = "lines") -> DataFrame:
    """Shape `[[bbox, [text, confidence]], ...]`."""

    def pair(line: Column) -> Column:
        return F.from_json(F.get(line, F.lit(1)), "array<string>")

    return _from_lines(df, json_col, lambda line: F.get(pair(line), F.lit(0)),
                       lambda line: F.get(pair(line), F.lit(1)).try_cast("double"))


def from_flat_lines(df: DataFrame, json_col: str = "lines") -> DataFrame:
    """Shape `[[bbox, text, confidence], ...]`."""
    return _from_lines(df, json_col, lambda line: F.get(line, F.lit(1)),
                       lambda line: F.get(line, F.lit(2)).try_cast("double"))


def from_bbox_lines(df: DataFrame, json_col: str = "lines") -> DataFrame:
    """Shape with axis-aligned `bbox` per line; blank lines go before numbering."""
    lines = F.from_json(json_col, f"array<{BBOX_LINE.simpleString()}>")
    kept = F.filter(lines, lambda line: F.coalesce(browser_trim(line["text"]) != "", F.lit(False)))
    keep = [c for c in df.columns if c != json_col]
    out = df.select(*keep, F.posexplode_outer(kept).alias("ordinal", "_l")).where(F.col("ordinal").isNotNull())
    return out.select(*keep, "ordinal", F.col("_l.text").alias("text"),
                      *[F.col(f"_l.bbox.{c}").alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")])


def corners_to_bounds(df: DataFrame, box: str = "box") -> DataFrame:
    """Replace the corner list by px0, py0, px1, py1."""
    bounds = G.poly_to_box(F.col(box))
    return df.select(*[c for c in df.columns if c != box], *[v.alias(f"p{k}") for k, v in bounds.items()])


def normalise(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions in pixels plus page sizes to blocks in percent.

    `regions`: page_id, ordinal, text, px0, py0, px1, py1 and whatever else;
    `pages`: page_id, width, height. The page side has one row per page, so a
    page with very many regions is split by the adaptive skew join.
    """
    px = {k: F.col(f"p{k}") for k in ("x0", "y0", "x1", "y1")}
    w, h = px["x1"] - px["x0"], px["y1"] - px["y0"]
    width, height = F.col("width"), F.col("height")
    joined = regions.join(pages.select("page_id", "width", "height"), "page_id")
    extra = [c for c in regions.columns if c not in ("page_id", "ordinal", "text", "px0", "py0", "px1", "py1")]
    return joined.select(
        "page_id", "ordinal",
        block_id(F.col("page_id"), F.col("ordinal")).alias("block_id"),
        browser_trim(F.col("text")).alias("original_text"),
        *[v.alias(k) for k, v in G.pct_box(px["x0"], px["y0"], px["x1"], px["y1"], width, height).items()],
        G.font_pct(w, h, height).alias("font_size_pct"),
        G.is_vertical_box(w, h).alias("is_vertical"),
        "width", "height", *extra)


def drop_degenerate(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")))


def drop_blank(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.where(browser_trim(F.col(text)) != "")


def visible_for(blocks: DataFrame, stage: str, onomatopoeia_mode: str) -> DataFrame:
    """Blocks a stage works on: `cover`, `text` or `erase`. A null type counts as bubble."""
    return blocks.where(is_visible(stage, onomatopoeia_mode))


def is_visible(stage: str, onomatopoeia_mode: str) -> Column:
    hidden = ("ignore", "transparent") if stage == "cover" else ("ignore",)
    return F.coalesce(F.col("type"), F.lit("bubble")) != "onomatopoeia" if onomatopoeia_mode in hidden else F.lit(True)


def empty_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages without any block: complete, nothing to translate."""
    done = pages.join(blocks.select("page_id").distinct(), "page_id", "left_anti")
    return done.withColumns({"status": F.lit("completed"), "progress": F.lit(100)})
