"""Round trips through stored tables and files; each writes to a new folder beside the session's checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.raster import CHANNELS
from ..session import ensure_checkpoint_dir
from ..sources import files as S
from ..sources import sinks as K
from ..sources.ledger import Ledger
from ..sources.png import patched_pages
from . import finish as N
from .block_queries import BOX
from .fixtures import Tables
from .oracle_views import with_views
from .registry import query
from .source_queries import GREY, images


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/round-trip-{uuid.uuid4().hex}"


ROUNDED = (*BOX, "font_size_pct")


@query("written_blocks", with_views(("fx_blocks",), """
SELECT CAST(page_id AS VARCHAR) AS page_name, CAST(ordinal AS BIGINT) AS ordinal, block_id, original_text, translated_text, round(ymin, 6) AS ymin, round(xmin, 6) AS xmin,
  round(ymax, 6) AS ymax, round(xmax, 6) AS xmax, text_color, bg_color, round(font_size_pct, 6) AS font_size_pct, type FROM fx_blocks
WHERE page_id % 7 <> 0 AND (page_id % 3 <> 0 OR ordinal < 1)"""))
def written_blocks(t: Tables) -> DataFrame:
    """Two versions of all block lists, the second with shorter and emptied pages, and a third that never became visible."""
    blocks, ledger = t["fx_blocks"].withColumn("page_name", F.col("page_id").cast("string")), Ledger(t.spark, _folder(t))
    ledger.publish("1", {N.BLOCK_LISTS: K.block_lists(blocks, 1, dealt_by=["page_id"])})
    decided = blocks.where("page_id % 3 = 0 OR page_id % 7 = 0")
    ledger.publish("2", {N.BLOCK_LISTS: K.block_lists(decided.where("page_id % 7 <> 0 AND ordinal < 1"), 2, decided.select("page_name"), dealt_by=["page_id"])})
    ledger.step("3", N.BLOCK_LISTS, lambda: K.block_lists(blocks.limit(0), 3, blocks.select("page_name")))
    return N.stored_blocks(ledger).withColumns({"ordinal": F.col("ordinal").cast("long"), **{c: F.round(c, 6) for c in ROUNDED}})


@query("cached_block_files", """
SELECT s_name AS name, true AS has_ocr_cache, CAST(pos AS INT) AS ordinal, concat('b', CAST(pos AS VARCHAR)) AS block_id, concat(s_name, ' ', CAST(pos AS VARCHAR)) AS original_text,
  CAST(pos * 10 AS DOUBLE) AS ymin
FROM (SELECT s_name, unnest(range(s_suppkey % 4)) AS pos FROM supplier)""")
def cached_block_files(t: Tables) -> DataFrame:
    """One cached list per supplier as a file, written and read again; every fourth list is empty."""
    folder = _folder(t)
    pages = t["supplier"].select(F.col("s_name").alias("page_name"), (F.col("s_suppkey") % 4).cast("int").alias("n"))
    listed = pages.where("n > 0").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    blocks = listed.select("page_name", "ordinal", F.concat(F.lit("b"), F.col("ordinal").cast("string")).alias("block_id"),
                           F.concat_ws(" ", "page_name", F.col("ordinal").cast("string")).alias("original_text"), F.lit("").alias("translated_text"),
                           (F.col("ordinal") * 10.0).alias("ymin"), *[F.lit(1.0).alias(c) for c in ("xmin", "ymax", "xmax")],
                           F.lit("#000000").alias("text_color"), F.lit("#FFFFFF").alias("bg_color"), F.lit(2.0).alias("font_size_pct"), F.lit("bubble").alias("type"))
    failed = K.write_block_files(blocks, folder, pages.select("page_name")).where("error IS NOT NULL").count()
    if failed:
        raise OSError(f"{failed} files could not be written")
    cache = S.read_block_cache(t.spark, folder)
    found = S.cached_blocks(cache).select("name", "ordinal", "block_id", "original_text", "ymin")
    return cache.select("name", "has_ocr_cache").join(found, "name").select("name", "has_ocr_cache", "ordinal", "block_id", "original_text", "ymin")


@query("written_artifacts", """
SELECT c_name AS page_name, 'erased' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE c_name END AS content, CASE WHEN c_custkey % 2 = 0 THEN 'h2' ELSE 'h1' END AS render_hash FROM customer
UNION ALL SELECT c_name, 'translated', c_mktsegment, 'h2' FROM customer WHERE c_custkey % 5 = 0""")
def written_artifacts(t: Tables) -> DataFrame:
    """Artifact records in two versions; the newest per page and kind is read."""
    ledger = Ledger(t.spark, _folder(t))

    def records(kind: str, content, render_hash: str, version: int, where: str = "true") -> DataFrame:
        return t["customer"].where(where).select(F.col("c_name").alias("page_name"), F.lit(kind).alias("kind"), F.lit(render_hash).alias("render_hash"),
                                                 F.encode(content, "UTF-8").alias("content"), F.lit(version).cast("long").alias("version"))

    ledger.publish("1", {N.ARTIFACTS: records("erased", F.col("c_name"), "h1", 1)})
    second = records("erased", F.lit("second"), "h2", 2, "c_custkey % 2 = 0").unionByName(records("translated", F.col("c_mktsegment"), "h2", 2, "c_custkey % 5 = 0"))
    ledger.publish("2", {N.ARTIFACTS: second})
    return N.stored_artifacts(ledger).select("page_name", "kind", F.decode("content", "UTF-8").alias("content"), "render_hash")


@query("replaced_pages", with_views(("fx_pages",), "SELECT page_id, name, status FROM fx_pages WHERE status = 'completed'"))
def replaced_pages(t: Tables) -> DataFrame:
    """The manifest of a newly opened folder replaces the old one in one step."""
    ledger, pages = Ledger(t.spark, _folder(t)), t["fx_pages"].select("page_id", "name", "status")
    ledger.publish("first", {"manifest": pages}, replaces=True)
    ledger.publish("second", {"manifest": pages.where("status = 'completed'")}, replaces=True)
    return ledger.read("manifest")


@query("decoded_pages", with_views((), """
SELECT page_id || '.png' AS name, x, y, CASE WHEN x = 0 AND y = 0 THEN 1 ELSE v END AS b, CASE WHEN x = 0 AND y = 0 THEN 2 ELSE v END AS g,
  CASE WHEN x = 0 AND y = 0 THEN 3 ELSE v END AS r FROM grey""", GREY))
def decoded_pages(t: Tables) -> DataFrame:
    """Every picture with one changed pixel as a PNG file, decoded again."""
    pages, folder = images(t), _folder(t)
    spots = pages.select("page_id", *[F.lit(v).alias(c) for c, v in zip(("x", "y", *CHANNELS), (0, 0, 1, 2, 3))])
    files = patched_pages(pages, spots).select(F.concat("page_id", F.lit(".png")).alias("name"), "content")
    failed = K.write_files(files, folder).where("error IS NOT NULL").count()
    if failed:
        raise OSError(f"{failed} files could not be written")
    decoded = S.read_images(t.spark, folder)
    return S.read_pixels(decoded).join(decoded.select("page_id", "name"), "page_id").select("name", "x", "y", *CHANNELS)
