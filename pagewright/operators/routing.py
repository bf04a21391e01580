"""Which pages are worked on, and by which route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Providers by what they accept.
VISION_PROVIDERS = ("gemini", "openai", "custom")
TEXT_PROVIDERS = ("gemini", "openai", "custom", "deepseek")


def work_list(pages: DataFrame) -> DataFrame:
    """Idle pages, and failed ones for another try."""
    return pages.where(F.col("status").isin("idle", "failed"))


def renderable(pages: DataFrame) -> DataFrame:
    """Completed pages with at least one block (`n_blocks`)."""
    return pages.where((F.col("status") == "completed") & (F.coalesce("n_blocks", F.lit(0)) > 0))


def page_by_id(pages: DataFrame, page_id: int | str) -> DataFrame:
    return pages.where(F.col("page_id") == F.lit(page_id))


def stale(pages: DataFrame, current: str = "render_hash", last: str = "last_rendered_hash") -> DataFrame:
    """Pages whose last rendering does not match the current hash."""
    return pages.where(~F.col(current).eqNullSafe(F.col(last)))


def split_blank(pages: DataFrame, solid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished blank pages, the rest). `solid`: page_id, is_solid."""
    flags = pages.join(solid.select("page_id", "is_solid"), "page_id", "left")
    is_blank = F.coalesce("is_solid", F.lit(False))
    changes = {"status": F.lit("completed"), "progress": F.lit(100), "has_ocr_cache": F.lit(False),
               "has_erased_cache": F.lit(False), "n_blocks": F.lit(0)}
    if "path" in pages.columns:
        changes["translated_path"] = F.col("path")
    return flags.where(is_blank).drop("is_solid").withColumns(changes), flags.where(~is_blank).drop("is_solid")


def route_of(provider: Column, ocr_online: Column) -> Column:
    """ocr+text, vision, lines+text, or null for an unsupported provider."""
    return (F.when(ocr_online & provider.isin(*TEXT_PROVIDERS), F.lit("ocr+text"))
            .when(~ocr_online & provider.isin(*VISION_PROVIDERS), F.lit("vision"))
            .when(~ocr_online & (provider == "deepseek"), F.lit("lines+text")))


def route(pages: DataFrame) -> DataFrame:
    """Adds `route` and `error`. `pages` carries provider and ocr_online."""
    chosen = route_of(F.col("provider"), F.coalesce("ocr_online", F.lit(False)))
    return pages.withColumn("route", chosen).withColumn(
        "error", F.when(F.col("route").isNull(),
                        F.concat(F.lit("Unsupported provider: "), F.coalesce("provider", F.lit("undefined")))))


def erase_route(blocks: DataFrame) -> DataFrame:
    """Flat fill for bubbles on an even background, else mask for inpainting. Needs is_uniform."""
    is_flat = (F.coalesce("type", F.lit("bubble")) == "bubble") & F.col("is_uniform")
    return blocks.withColumn("erase_route", F.when(is_flat, F.lit("flat")).otherwise(F.lit("inpaint")))
