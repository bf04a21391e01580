"""Queries over images, stored block lists and plug-ins, on inputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import payload as P
from ..plugins import run_ocr, text_width_px
from ..schema import BLOCK, StyleConfig
from ..sources import files as S
from .block_queries import BOX
from .fixtures import Tables
from .layout_queries import em_sql
from .oracle_views import with_views
from .registry import query


def images(t: Tables) -> DataFrame:
    """Every crop as a decoded grey image of 8 by 8, as the image source gives it."""
    pixels = F.transform("embedding", lambda e: F.lpad(F.hex(F.floor(
        F.least(F.greatest((e.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0)))), 2, "0"))
    return t["embeddings"].select(
        F.col("vec_id").cast("string").alias("page_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("n_channels"),
        F.unhex(F.array_join(pixels, "")).alias("data"))


GREY = (("grey", """SELECT CAST(vec_id AS VARCHAR) AS page_id, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y,
    CAST(floor(least(greatest((CAST(e AS DOUBLE) + 0.5e0) * 255, 0), 255)) AS INT) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings)"""),)


@query("image_pixels", with_views((), "SELECT page_id, x, y, v AS b, v AS g, v AS r FROM grey", GREY))
def image_pixels(t: Tables) -> DataFrame:
    return S.read_pixels(images(t))


@query("image_crops", with_views((), """
SELECT page_id, ordinal, x - x0 AS x, y - y0 AS y, v AS b, v AS g, v AS r FROM grey, (VALUES (0, 1, 2, 7, 8), (1, 3, 0, 8, 3)) a(ordinal, x0, y0, x1, y1)
WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""", GREY))
def image_crops(t: Tables) -> DataFrame:
    """Two rectangles per image, on strips of three rows."""
    rects = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ordinal", "x0", "y0", "x1", "y1"), r)])
                                for r in ((0, 1, 2, 7, 8), (1, 3, 0, 8, 3))]))
    pages = images(t)
    return S.read_crops(pages, pages.select("page_id", rects.alias("q")).select("page_id", "q.*"), rows=3)


@query("image_solid", with_views((), """
SELECT p.page_id, bool_and(abs(p.v - f.v) <= 90) AS is_solid FROM grey p JOIN grey f ON p.page_id = f.page_id AND f.x = 0 AND f.y = 0 GROUP BY p.page_id""", GREY))
def image_solid(t: Tables) -> DataFrame:
    """With a wide tolerance, so that both answers occur."""
    return S.solid_pages(images(t), 90)


@query("png_dims", with_views(("fx_pages",), """
SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN width ELSE -1 END AS width, CASE WHEN page_id % 5 <> 4 THEN height ELSE -1 END AS height FROM fx_pages"""))
def png_dims(t: Tables) -> DataFrame:
    """PNG headers with the size of each page; every fifth file is something else."""
    def number(c: str):
        return F.lpad(F.hex(c), 8, "0")

    magic = F.when(F.col("page_id") % 5 == 4, F.lit("FFD8FFE000104A46")).otherwise(F.lit(S.PNG_MAGIC))
    header = F.unhex(F.concat(magic, F.lit("0000000D49484452"), number("width"), number("height"), F.lit("0802000000")))
    dims = S.png_dims(F.col("content"))
    return t["fx_pages"].select("page_id", header.alias("content")).select(
        "page_id", *[F.coalesce(v, F.lit(-1)).alias(k) for k, v in dims.items()])


@query("stored_blocks", with_views(("fx_blocks",), """
SELECT page_id AS name, ordinal, block_id, original_text, translated_text, round(ymin, 6) AS ymin, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax,
  round(xmax, 6) AS xmax, text_color, bg_color, round(font_size_pct, 6) AS font_size_pct, type FROM fx_blocks"""))
def stored_blocks(t: Tables) -> DataFrame:
    """Block lists to JSON and back."""
    stored = P.blocks_json(t["fx_blocks"], "page_id")
    lists = stored.select(F.col("page_id").alias("name"), "part", F.from_json("blocks_json", f"array<{BLOCK.simpleString()}>").alias("blocks"))
    return S.cached_blocks(lists).withColumns({c: F.round(c, 6) for c in (*BOX, "font_size_pct")})


@query("layout_hash", with_views(("fx_blocks",), """
SELECT page_id, sha256(concat_ws('-', 'Outfit-1-original-#FFFFFF-original-#000000-90-true-false-#000000-2-true-false-true-ignore-false', CAST(count(*) AS VARCHAR),
  """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)) + """)) AS layout_hash FROM (
  SELECT page_id, sha256(concat(CAST(ordinal AS VARCHAR), ':', CAST(to_json(
      {'id': block_id, 'original_text': original_text, 'translated_text': translated_text, 'ymin': floor(ymin), 'xmin': floor(xmin),
       'ymax': floor(ymax), 'xmax': floor(xmax), 'text_color': text_color, 'bg_color': bg_color,
       'font_size_pct': floor(font_size_pct), 'type': coalesce(type, 'bubble')}) AS VARCHAR))) AS h
  FROM fx_blocks) GROUP BY page_id"""))
def layout_hash(t: Tables) -> DataFrame:
    """Whole percents keep the printed numbers equal in both engines."""
    whole = t["fx_blocks"].withColumns({c: F.floor(c).cast("double") for c in (*BOX, "font_size_pct")})
    return P.layout_hash(whole.withColumn("type", F.coalesce("type", F.lit("bubble"))), StyleConfig())


@query("text_widths", f"""
SELECT doc_id, (length(text) * 0e0 + {em_sql('text')}) * 16e0 AS width_px FROM documents""")
def text_widths(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", text_width_px(F.col("text"), F.lit(16.0)).alias("width_px"))


def length_engine():
    """Stub OCR: one region whose right edge is the number of bytes; every tenth length fails."""

    def detect(content: bytes) -> list[dict]:
        if len(content) % 10 == 0:
            raise ValueError("no regions")
        n = len(content)
        return [{"text": f"{n} bytes", "box": [[1, 2], [n, 2], [n, 9], [1, 9]], "confidence": 0.5}]

    return detect


@query("stub_ocr", """
SELECT doc_id AS page_id, 0 AS ordinal, n || ' bytes' AS text, 0.5e0 AS confidence, 1e0 AS px0, 2e0 AS py0, CAST(n AS DOUBLE) AS px1, 9e0 AS py1
FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) WHERE n % 10 <> 0""")
def stub_ocr(t: Tables) -> DataFrame:
    """Pictures through the OCR plug-in; a page on which the engine fails gives no regions."""
    content = t["documents"].select(F.col("doc_id").alias("page_id"), F.encode("text", "UTF-8").alias("content"))
    return B.corners_to_bounds(B.read_ocr(run_ocr(content, length_engine).drop("error")))
