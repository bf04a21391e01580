"""Page manifest and artifact cache: marks, merges, clean-up, export.

Names are unique in a folder only. Over many folders, pages and listing carry
the same folder columns, and `folder` names them: equal names of two folders
then never meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import artifact_kind, artifact_owner, export_name, natural_key
from ..schema import StyleConfig
from .ranking import last_wins, neighbours, row_numbers

# Fixed values. Best picture of a page first: (kind, location).
PREVIEW_ORDER = (("translated", "cache"), ("translated", "root"), ("erased", "cache"), ("erased", "root"))
STATUSES = ("idle", "processing", "completed", "failed")


def with_artifact_parts(listing: DataFrame) -> DataFrame:
    """Adds `kind` and `owner` to a listing with `file_name`; both null for an unknown suffix."""
    return listing.withColumns({"kind": artifact_kind(F.col("file_name")), "owner": artifact_owner(F.col("file_name"))})


def artifact_flags(listing: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    """One row per folder and owner: has_ocr_cache (blocks), has_erased_cache (either picture)."""
    known = with_artifact_parts(listing).where(F.coalesce("owner", F.lit("")) != "")
    return known.groupBy(*folder, "owner").agg(
        F.bool_or(F.col("kind") == "blocks").alias("has_ocr_cache"),
        F.bool_or(F.col("kind").isin("translated", "erased")).alias("has_erased_cache"))


def mark_cached(pages: DataFrame, listing: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    """Cached blocks make a page completed at 100 %; other pages start idle at 0."""
    flags = artifact_flags(listing, folder).withColumnRenamed("owner", "name")
    keep = [c for c in pages.columns if c not in ("status", "progress", "has_ocr_cache", "has_erased_cache")]
    has_blocks = F.coalesce("has_ocr_cache", F.lit(False))
    return pages.select(*keep).join(flags, [*folder, "name"], "left").select(
        *keep, F.when(has_blocks, F.lit("completed")).otherwise(F.lit("idle")).alias("status"),
        F.when(has_blocks, F.lit(100)).otherwise(F.lit(0)).alias("progress"),
        has_blocks.alias("has_ocr_cache"), F.coalesce("has_erased_cache", F.lit(False)).alias("has_erased_cache"))


def known_names(pages: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    return pages.select(*folder, "name").distinct()


def orphan_marks(listing: DataFrame, pages: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    """Adds `is_orphan`: the owner is known from the name but no page has it."""
    names = known_names(pages, folder).select(*folder, F.col("name").alias("owner"), F.lit(True).alias("_known"))
    marked = with_artifact_parts(listing).join(names, [*folder, "owner"], "left")
    has_owner = F.coalesce("owner", F.lit("")) != ""
    return marked.withColumn("is_orphan", has_owner & F.col("_known").isNull()).drop("_known")


def orphans(listing: DataFrame, pages: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    """The delete list. Nothing is deleted here."""
    owned = with_artifact_parts(listing).where(F.coalesce("owner", F.lit("")) != "")
    return owned.join(known_names(pages, folder).withColumnRenamed("name", "owner"), [*folder, "owner"], "left_anti")


def cleanup_summary(listing: DataFrame, pages: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    return orphan_marks(listing, pages, folder).agg(F.count_if("is_orphan").alias("deleted"),
                                            F.count_if(~F.col("is_orphan")).alias("kept"))


def best_artifact(pages: DataFrame, listing: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    """`translated_path` by PREVIEW_ORDER for completed pages, `erased_path` cache before root."""
    files = with_artifact_parts(listing).withColumn("path", F.concat_ws("/", "location", "file_name"))
    rank = F.lit(None).cast("int")
    for i, (kind, location) in enumerate(PREVIEW_ORDER):
        rank = F.when((F.col("kind") == kind) & (F.col("location") == location), F.lit(i)).otherwise(rank)
    ranked = files.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = ranked.groupBy(*folder, F.col("owner").alias("name")).agg(
        F.min_by("path", F.struct("_rank", "path")).alias("translated_path"),
        F.min(F.when(F.col("kind") == "erased", F.struct("_rank", "path"))).getField("path").alias("erased_path"))
    completed = F.when(F.col("status") == "completed", F.col("translated_path"))
    return pages.join(best, [*folder, "name"], "left").withColumn("translated_path", completed)


def display_path(pages: DataFrame) -> DataFrame:
    """The translated picture of a completed page, else the original."""
    shown = F.when((F.col("status") == "completed") & (F.coalesce("translated_path", F.lit("")) != ""),
                   F.col("translated_path")).otherwise(F.col("path"))
    return pages.withColumn("display_path", shown)


def merge_pages(pages: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace fields of updated pages; cache flags stay set once they were set."""
    changed = [c for c in updates.columns if c != "page_id"]
    right = updates.select("page_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changed])
    hit = F.coalesce(F.col("_hit"), F.lit(False))

    def value(c: str):
        if c not in changed:
            return F.col(c)
        if c in ("has_ocr_cache", "has_erased_cache"):
            return F.coalesce(F.col(f"_{c}"), F.lit(False)) | F.coalesce(F.col(c), F.lit(False))
        return F.when(hit, F.col(f"_{c}")).otherwise(F.col(c))

    return pages.join(right, "page_id", "left").select(*[value(c).alias(c) for c in pages.columns])


def append_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    return pages.unionByName(new)


def remove_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    return pages.join(ids.select("page_id").distinct(), "page_id", "left_anti")


def struct_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, n_changed, is_stale): blocks at the same position that differ in geometry or type."""
    fields = ["xmin", "xmax", "ymin", "ymax", "type"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("page_id", "ordinal", F.struct(*fields).alias(tag))

    pairs = side(old, "o").join(side(new, "n"), ["page_id", "ordinal"], "full")
    return pairs.groupBy("page_id").agg(
        F.count_if(~F.col("o").eqNullSafe(F.col("n"))).alias("n_changed"),
        F.bool_or(~F.col("o").eqNullSafe(F.col("n"))).alias("is_stale"))


def status_counts(pages: DataFrame) -> DataFrame:
    """One row. A status outside STATUSES counts only in the total."""
    return pages.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def import_summary(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.coalesce("has_ocr_cache", F.lit(False))).alias("cached"))


def filter_media(files: DataFrame, media_type: str = "media_type") -> DataFrame:
    return files.where(F.col(media_type).startswith("image/"))


def media_summary(files: DataFrame, media_type: str = "media_type") -> DataFrame:
    """How many uploads are images, and the error to report when none is."""
    counted = files.agg(F.count_if(F.coalesce(F.col(media_type).startswith("image/"), F.lit(False))).alias("accepted"),
                        F.count("*").alias("offered"))
    return counted.withColumn("error", F.when(F.col("accepted") == 0, F.lit("No image files")))


def natural_order(pages: DataFrame, chapter: list[str] | None = None) -> DataFrame:
    """Adds `page_rank` from 1 in natural name order (then page_id), per chapter or over all pages."""
    keyed = pages.withColumn("_key", natural_key(F.col("name")))
    return row_numbers(keyed, chapter or [], ["_key", "page_id"], "page_rank").drop("_key")


def page_neighbours(ranked: DataFrame, chapter: list[str] | None = None) -> DataFrame:
    """Adds prev_page, next_page and whether they exist, from `page_rank`."""
    out = neighbours(ranked, chapter or [], "page_rank", "page_id", "prev_page", "next_page")
    return out.withColumns({"has_prev": F.col("prev_page").isNotNull(), "has_next": F.col("next_page").isNotNull()})


def export_manifest(pages: DataFrame, style: StyleConfig, folder: Sequence[str] = ()) -> DataFrame:
    """Completed pages with a block list, by archive entry; of equal entries the last page counts.

    `pages`: page_id, name, status, n_blocks (null: no list), render_hash,
    last_rendered_hash, has_translated. Order is natural name order, then page_id.
    """
    ready = pages.where((F.col("status") == "completed") & F.col("n_blocks").isNotNull())
    reusable = F.lit(not style.export_compressed) & F.coalesce("has_translated", F.lit(False)) & \
        F.col("render_hash").eqNullSafe(F.col("last_rendered_hash"))
    entries = ready.select(
        *folder, export_name(F.col("name"), style.export_compressed).alias("entry_name"), "page_id", "name", "n_blocks",
        F.when(reusable, F.lit("reuse")).otherwise(F.lit("render")).alias("action"),
        F.lit("image/webp" if style.export_compressed else "image/png").alias("content_type"))
    return last_wins(entries, [*folder, "entry_name"], [natural_key(F.col("name")), "page_id"])
