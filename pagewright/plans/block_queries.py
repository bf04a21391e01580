"""Queries over detected blocks and their geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import lookups as L
from ..functions import semantics as S
from ..functions.names import natural_key
from ..operators import blocks as B
from ..operators import payload as P
from ..operators import ranking as K
from ..operators.layout import resolve_style
from ..schema import StyleConfig
from ..sources.files import with_base64
from .fixtures import Tables
from .oracle_views import SPACE, clamp_sql, trim_sql, with_views
from .registry import query


def r6(column, name: str | None = None):
    rounded = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return rounded.alias(name or column)


BOX = ("xmin", "ymin", "xmax", "ymax")
BOX_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in BOX)


@query("clamp_values", f"""
SELECT l_orderkey, l_linenumber, round({clamp_sql('v')}, 6) AS clamped
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN CAST('NaN' AS DOUBLE)
      ELSE l_extendedprice / 400 - 30 END AS v FROM lineitem)""")
def clamp_values(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    value = F.when(n == 1, None).when(n == 2, float("nan")).otherwise(F.col("l_extendedprice") / 400 - 30)
    return t["lineitem"].select("l_orderkey", "l_linenumber", r6(S.clamp(value, 0.0, 100.0), "clamped"))


@query("default_values", """
SELECT event_id, CASE event_id % 3 WHEN 2 THEN event_type ELSE '#FFFFFF' END AS text_value,
  CASE WHEN event_id % 4 = 3 AND value <> 0 THEN value ELSE 2e0 END AS number_value FROM events""")
def default_values(t: Tables) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 3 == 0, "").when(e % 3 == 2, F.col("event_type"))
    number = F.when(e % 4 == 0, 0.0).when(e % 4 == 2, float("nan")).when(e % 4 == 3, F.col("value"))
    return t["events"].select("event_id", S.text_or(text, "#FFFFFF").alias("text_value"),
                              S.number_or(number, 2.0).alias("number_value"))


@query("trim_text", with_views(("fx_ocr",), f"""
SELECT page_id, ordinal, {trim_sql("concat(chr(12288), text, chr(160), chr(65279))")} AS text FROM fx_ocr"""))
def trim_text(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("　"), "text", F.lit(" ﻿"))
    return t["fx_ocr"].select("page_id", "ordinal", S.browser_trim(padded).alias("text"))


@query("ocr_blocks", with_views(("fx_blocks", "fx_ocr"), f"""
SELECT b.page_id, b.ordinal, b.block_id, b.original_text, {', '.join(f'round(b.{c}, 6) AS {c}' for c in BOX)},
  round(b.font_size_pct, 6) AS font_size_pct, b.is_vertical, round(o.confidence, 6) AS confidence
FROM fx_blocks b JOIN fx_ocr o ON b.page_id = o.page_id AND b.ordinal = o.ordinal"""))
def ocr_blocks(t: Tables) -> DataFrame:
    """Reply JSON to blocks in percent."""
    corners = F.array(*[F.array(x, y) for x, y in (("px0", "py0"), ("px1", "py0"), ("px1", "py1"), ("px0", "py1"))])
    reply = F.to_json(F.struct(F.array(F.struct("text", corners.alias("box"), "confidence")).alias("blocks")))
    replies = t["fx_ocr"].select("page_id", F.col("ordinal").alias("line"), reply.alias("reply"))
    regions = B.corners_to_bounds(B.read_ocr(replies)).drop("ordinal").withColumnRenamed("line", "ordinal")
    blocks = B.normalise(regions, t["fx_pages"])
    return blocks.select("page_id", "ordinal", "block_id", "original_text", *[r6(c) for c in BOX],
                         r6("font_size_pct"), "is_vertical", r6("confidence"))


SHAPES = ("'{\"error\":\"x\"}'", "'[]'", "'{\"blocks\":[]}'", "'no json'", "CAST(NULL AS STRING)", "'{\"blocks\":[{\"text\":\"a\"}]}'")


@query("ocr_errors", """
SELECT event_id AS page_id, 'Invalid OCR reply' AS error FROM events WHERE event_id % 6 IN (0, 1, 3, 4)""")
def ocr_errors(t: Tables) -> DataFrame:
    """Replies of a wrong shape, an empty list, no JSON and no reply at all among good ones."""
    reply = F.element_at(F.array(*map(F.expr, SHAPES)), (F.col("event_id") % 6 + 1).cast("int"))
    return B.ocr_errors(t["events"].select(F.col("event_id").alias("page_id"), reply.alias("reply")))


@query("ocr_parallel_arrays", """
SELECT o_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1 AS INT) AS ordinal,
  text, round(confidence, 6) AS confidence, px0, py0, px1, py1
FROM (
  SELECT o_orderkey, 0 AS i, o_orderpriority AS text, 0.5e0 AS confidence, CAST(o_orderkey % 50 AS INT) AS px0, 10 AS py0,
    CAST(o_orderkey % 50 AS INT) + 30 AS px1, 40 AS py1 FROM orders
  UNION ALL
  SELECT o_orderkey, 1, o_orderstatus, 1e0, 5, 6, 25, 36 FROM orders WHERE o_orderkey % 3 <> 0
)""")
def ocr_parallel_arrays(t: Tables) -> DataFrame:
    """Three texts, one score, two polygons of which one may be missing."""
    k = (F.col("o_orderkey") % 50).cast("double")

    def poly(x0, y0, x1, y1):
        return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))

    first = poly(k + 0.9, F.lit(10.5), k + 30.9, F.lit(40.2))
    second = F.when(F.col("o_orderkey") % 3 != 0, poly(F.lit(5.1), F.lit(6.0), F.lit(25.0), F.lit(36.9)))
    arrays = t["orders"].select(
        F.col("o_orderkey").alias("page_id"),
        F.array("o_orderpriority", "o_orderstatus", F.lit("x")).alias("rec_texts"),
        F.array(F.lit(0.5)).alias("rec_scores"), F.array(first, second).alias("rec_polys"))
    rows = B.corners_to_bounds(B.from_parallel_arrays(arrays))
    return rows.select("page_id", "ordinal", "text", r6("confidence"), "px0", "py0", "px1", "py1")


LINES_SQL = """
SELECT o_orderkey AS page_id, i AS ordinal, CASE i WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS text,
  CASE i WHEN 0 THEN 0.75e0 ELSE 0.5e0 END AS confidence, CAST(o_orderkey % 90 AS INT) + i AS px0, 3 AS py0,
  CAST(o_orderkey % 90 AS INT) + 40 + i AS px1, 21 AS py1
FROM orders, (VALUES (0), (1)) v(i)"""


def _lines(t: Tables, nested: bool) -> DataFrame:
    """Line lists as JSON: `[[bbox, [text, score]], …]` or `[[bbox, text, score], …]`."""
    def line(i: int, text: str, score: str):
        k = (F.col("o_orderkey") % 90).cast("int") + i
        left, right = k.cast("string"), (k + 40).cast("string")
        tail = F.concat(F.lit('"'), text, F.lit(f'",{score}'))
        return F.concat(F.lit("[[["), left, F.lit(".5,3],["), right, F.lit(".5,3],["), right, F.lit(".2,21.8],["), left,
                        F.lit(".9,21]],"), F.concat(F.lit("["), tail, F.lit("]")) if nested else tail, F.lit("]"))

    both = F.concat(F.lit("["), line(0, "o_orderpriority", "0.75"), F.lit(","), line(1, "o_orderstatus", "0.5"), F.lit("]"))
    return t["orders"].select(F.col("o_orderkey").alias("page_id"), both.alias("lines"))


@query("ocr_nested_lines", LINES_SQL)
def ocr_nested_lines(t: Tables) -> DataFrame:
    return B.corners_to_bounds(B.from_nested_lines(_lines(t, True))).select(
        "page_id", "ordinal", "text", "confidence", "px0", "py0", "px1", "py1")


@query("ocr_flat_lines", LINES_SQL)
def ocr_flat_lines(t: Tables) -> DataFrame:
    return B.corners_to_bounds(B.from_flat_lines(_lines(t, False))).select(
        "page_id", "ordinal", "text", "confidence", "px0", "py0", "px1", "py1")


@query("ocr_bbox_lines", """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 0 AND i = 2 THEN 1 ELSE i END AS ordinal,
  CASE i WHEN 0 THEN o_orderpriority WHEN 1 THEN ' b ' ELSE o_orderstatus END AS text,
  CAST(10 * i AS DOUBLE) AS px0, 2e0 AS py0, CAST(o_orderkey % 300 AS DOUBLE) AS px1, 30e0 AS py1
FROM orders, (VALUES (0), (1), (2)) v(i) WHERE NOT (o_orderkey % 4 = 0 AND i = 1)""")
def ocr_bbox_lines(t: Tables) -> DataFrame:
    """The middle line is blank (an ideographic space) on every fourth page."""
    right = (F.col("o_orderkey") % 300).cast("double")

    def line(i: int, text):
        box = F.struct(F.lit(10.0 * i).alias("x0"), F.lit(2.0).alias("y0"), right.alias("x1"), F.lit(30.0).alias("y1"))
        return F.struct(text.alias("text"), box.alias("bbox"))

    middle = F.when(F.col("o_orderkey") % 4 == 0, F.lit("　")).otherwise(F.lit(" b "))
    lines = F.to_json(F.array(line(0, F.col("o_orderpriority")), line(1, middle), line(2, F.col("o_orderstatus"))))
    return B.from_bbox_lines(t["orders"].select(F.col("o_orderkey").alias("page_id"), lines.alias("lines")))


@query("block_ordinals", """
SELECT page_id, conv_id, turn, CAST(row_number() OVER (PARTITION BY page_id ORDER BY conv_id, turn, role, text) - 1 AS INT) AS ordinal
FROM (SELECT conv_id % 50 AS page_id, conv_id, turn, role, text FROM conversations)""")
def block_ordinals(t: Tables) -> DataFrame:
    rows = t["conversations"].withColumn("page_id", F.col("conv_id") % 50)
    return K.with_ordinal(rows, ["page_id"], ["conv_id", "turn", "role", "text"]).select(
        "page_id", "conv_id", "turn", "ordinal")


@query("block_neighbours", with_views(("fx_blocks",), """
SELECT page_id, ordinal, block_id, lag(block_id) OVER w AS prev_block, lead(block_id) OVER w AS next_block
FROM fx_blocks WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)"""))
def block_neighbours(t: Tables) -> DataFrame:
    blocks = t["fx_blocks"].select("page_id", "ordinal", "block_id")
    return K.neighbours(blocks, ["page_id"], "ordinal", "block_id", "prev_block", "next_block")


RECT_INT_SQL = """
  greatest(0, least(CAST(trunc(xmin / 100e0 * width) AS INT), width - 1)) AS ix0,
  greatest(0, least(CAST(trunc(ymin / 100e0 * height) AS INT), height - 1)) AS iy0,
  greatest(0, least(CAST(trunc(xmax / 100e0 * width) AS INT), width)) AS ix1,
  greatest(0, least(CAST(trunc(ymax / 100e0 * height) AS INT), height)) AS iy1"""


@query("block_rects", with_views(("fx_blocks",), f"""
SELECT page_id, ordinal, round(xmin / 100 * width, 6) AS x, round(ymin / 100 * height, 6) AS y,
  round(xmax / 100 * width - xmin / 100 * width, 6) AS w, round(ymax / 100 * height - ymin / 100 * height, 6) AS h,
  {RECT_INT_SQL} FROM fx_blocks"""))
def block_rects(t: Tables) -> DataFrame:
    box = {c: F.col(c) for c in BOX}
    exact = G.rect_float(box, F.col("width"), F.col("height"))
    whole = G.rect_int(box, F.col("width"), F.col("height"))
    return t["fx_blocks"].select("page_id", "ordinal", *[r6(v, k) for k, v in exact.items()],
                                 *[v.alias(f"i{k}") for k, v in whole.items()])


@query("radii", with_views(("fx_pages",), """
SELECT page_id, greatest(1, CAST(trunc(side * 0.002e0) AS INT)) AS bubble_radius,
  greatest(2, CAST(trunc(side * 0.004e0) AS INT)) AS sfx_radius,
  greatest(2, CAST(trunc(side * 0.003e0) AS INT)) AS feather_radius
FROM (SELECT page_id, greatest(width, height) * 5 AS side FROM fx_pages)"""))
def radii(t: Tables) -> DataFrame:
    out = G.radii(F.col("width") * 5, F.col("height") * 5)
    return t["fx_pages"].select("page_id", *[v.alias(k) for k, v in out.items()])


@query("font_px", with_views(("fx_blocks",), """
SELECT page_id, ordinal, round(greatest(8e0, CASE WHEN ordinal % 4 = 0 THEN 2e0 ELSE font_size_pct END * height / 100 * 1.5e0), 6) AS font_px
FROM fx_blocks"""))
def font_px(t: Tables) -> DataFrame:
    """Every fourth block has no size of its own."""
    pct = F.when(F.col("ordinal") % 8 == 0, F.lit(0.0)).when(F.col("ordinal") % 4 != 0, F.col("font_size_pct"))
    return t["fx_blocks"].select("page_id", "ordinal", r6(G.font_px0(pct, F.col("height"), 1.5), "font_px"))


@query("drag_boxes", with_views(("fx_blocks",), f"""
SELECT page_id, ordinal,
  round(CASE WHEN mx1 > 100 THEN 100 - sw ELSE mx0 END, 6) AS move_xmin, round(CASE WHEN mx1 > 100 THEN 100 ELSE mx1 END, 6) AS move_xmax,
  round(CASE WHEN my1 > 100 THEN 100 - sh ELSE my0 END, 6) AS move_ymin, round(CASE WHEN my1 > 100 THEN 100 ELSE my1 END, 6) AS move_ymax,
  round(least(100e0, greatest(xmin + 2, xmax + dx)), 6) AS size_xmax, round(least(100e0, greatest(ymin + 2, ymax + dy)), 6) AS size_ymax
FROM (SELECT *, xmax - xmin AS sw, ymax - ymin AS sh,
    CASE WHEN xmin + dx < 0 THEN 0 ELSE xmin + dx END AS mx0, CASE WHEN xmin + dx < 0 THEN xmax - xmin ELSE xmax + dx END AS mx1,
    CASE WHEN ymin + dy < 0 THEN 0 ELSE ymin + dy END AS my0, CASE WHEN ymin + dy < 0 THEN ymax - ymin ELSE ymax + dy END AS my1
  FROM (SELECT *, CAST(page_id % 61 - 30 AS DOUBLE) AS dx, CAST(page_id % 41 - 20 AS DOUBLE) AS dy FROM fx_blocks))"""))
def drag_boxes(t: Tables) -> DataFrame:
    box = {c: F.col(c) for c in BOX}
    dx = (F.col("page_id") % 61 - 30).cast("double")
    dy = (F.col("page_id") % 41 - 20).cast("double")
    moved, sized = G.move_box(box, dx, dy), G.resize_box(box, dx, dy)
    return t["fx_blocks"].select("page_id", "ordinal", *[r6(moved[c], f"move_{c}") for c in BOX],
                                 r6(sized["xmax"], "size_xmax"), r6(sized["ymax"], "size_ymax"))


@query("visible_blocks", with_views(("fx_blocks",), """
SELECT stage, mode, page_id, count(*) AS n FROM fx_blocks,
  (VALUES ('cover','ignore'),('cover','transparent'),('cover','normal'),('text','ignore'),('text','transparent'),
          ('erase','ignore'),('erase','normal')) v(stage, mode)
WHERE NOT (coalesce(type, 'bubble') = 'onomatopoeia'
  AND (mode = 'ignore' OR (mode = 'transparent' AND stage = 'cover')))
GROUP BY stage, mode, page_id"""))
def visible_blocks(t: Tables) -> DataFrame:
    """Blocks per page that each stage works on, for each sound-effect mode."""
    cases = [("cover", "ignore"), ("cover", "transparent"), ("cover", "normal"), ("text", "ignore"),
             ("text", "transparent"), ("erase", "ignore"), ("erase", "normal")]
    counts = t["fx_blocks"].groupBy("page_id").agg(F.array(*[F.count_if(B.is_visible(stage, mode)) for stage, mode in cases]).alias("_n"))
    cells = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(mode).alias("mode"), F.col("_n")[i].alias("n")) for i, (stage, mode) in enumerate(cases)])
    return counts.select("page_id", F.explode(cells).alias("c")).select("c.stage", "c.mode", "page_id", "c.n").where("n > 0")


@query("drop_degenerate", with_views(("fx_blocks",), f"""
SELECT page_id, ordinal, {BOX_SQL} FROM fx_blocks WHERE xmax > xmin AND ymax > ymin"""))
def drop_degenerate(t: Tables) -> DataFrame:
    return B.drop_degenerate(t["fx_blocks"]).select("page_id", "ordinal", *[r6(c) for c in BOX])


@query("drop_blank", with_views(("fx_ocr",), """
SELECT page_id, ordinal, text FROM fx_ocr WHERE ordinal % 3 <> 1"""))
def drop_blank(t: Tables) -> DataFrame:
    text = F.when(F.col("ordinal") % 3 == 1, F.lit(" 　\n")).otherwise(F.col("text"))
    return B.drop_blank(t["fx_ocr"].select("page_id", "ordinal", text.alias("text")))


@query("empty_pages", with_views(("fx_pages", "fx_ocr"), """
SELECT page_id, name, 'completed' AS status, 100 AS progress FROM fx_pages
WHERE page_id NOT IN (SELECT page_id FROM fx_ocr)"""))
def empty_pages(t: Tables) -> DataFrame:
    return B.empty_pages(t["fx_pages"], t["fx_ocr"]).select("page_id", "name", "status", "progress")


PAYLOAD_SQL = """'[' || string_agg(CAST(to_json({{'id': block_id, 'text': original_text,
    'xmin': CAST(floor(xmin + 0.5e0) AS INT), 'ymin': CAST(floor(ymin + 0.5e0) AS INT),
    'xmax': CAST(floor(xmax + 0.5e0) AS INT), 'ymax': CAST(floor(ymax + 0.5e0) AS INT)}}) AS VARCHAR), ',' ORDER BY ordinal) || ']'"""
PAYLOAD = PAYLOAD_SQL.replace("{{", "{").replace("}}", "}")


@query("request_payload", with_views(("fx_blocks",), f"""
SELECT page_id, CAST(0 AS INT) AS part, count(*) AS n_items, {PAYLOAD} AS payload FROM fx_blocks GROUP BY page_id, part"""))
def request_payload(t: Tables) -> DataFrame:
    return P.request_payload(t["fx_blocks"])


@query("ready_requests", with_views(("fx_blocks",), f"""
SELECT page_id, CAST(0 AS INT) AS part, count(*) AS n_items, count(*) FILTER (WHERE is_vertical) AS n_vertical, {PAYLOAD} AS payload
FROM fx_blocks WHERE xmax > xmin AND ymax > ymin AND coalesce(type, 'bubble') <> 'onomatopoeia' GROUP BY page_id, part"""))
def ready_requests(t: Tables) -> DataFrame:
    """Flagship: pages with their usable blocks as requests, and how many are vertical."""
    usable = B.visible_for(B.drop_degenerate(t["fx_blocks"]), "text", "ignore")
    return P.request_payload(usable, extra=[F.count_if("is_vertical").alias("n_vertical")]).select(
        "page_id", "part", "n_items", "n_vertical", "payload")


@query("blocks_json", with_views(("fx_blocks",), """
SELECT page_id, CAST(0 AS INT) AS part, count(*) AS n_items, '[' || string_agg(CAST(to_json(
  {'id': block_id, 'original_text': original_text, 'translated_text': translated_text, 'ymin': round(ymin, 3), 'xmin': round(xmin, 3),
   'ymax': round(ymax, 3), 'xmax': round(xmax, 3), 'text_color': text_color, 'bg_color': bg_color,
   'font_size_pct': round(font_size_pct, 3), 'type': coalesce(type, 'bubble')}) AS VARCHAR), ',' ORDER BY ordinal) || ']' AS blocks_json
FROM fx_blocks GROUP BY page_id, part"""))
def blocks_json(t: Tables) -> DataFrame:
    rounded = t["fx_blocks"].withColumns({c: F.round(c, 3) for c in (*BOX, "font_size_pct")})
    return P.blocks_json(rounded.withColumn("type", F.coalesce("type", F.lit("bubble"))))


STYLE_TEXT = "Outfit-1-original-#FFFFFF-original-#000000-90-true-false-#000000-2-true-false-true-ignore-"
# The style, the number of blocks and the summed words of the block digests.
HASH_SQL = f"""
SELECT page_id, count(*) AS n_blocks, sha256(concat_ws('-', '{STYLE_TEXT.removesuffix('-')}', CAST(count(*) AS VARCHAR),
  {', '.join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))})) AS render_hash
FROM (SELECT page_id, sha256(concat(CAST(ordinal AS VARCHAR), ':', concat_ws('-', coalesce(translated_text, ''), coalesce(text_color, ''),
        coalesce(bg_color, ''), coalesce(type, 'bubble')))) AS h FROM fx_blocks) GROUP BY page_id"""


@query("render_hash", with_views(("fx_blocks",), f"SELECT page_id, render_hash FROM ({HASH_SQL})"))
def render_hash(t: Tables) -> DataFrame:
    return P.render_hash(t["fx_blocks"], StyleConfig())


@query("styled_blocks", with_views(("fx_blocks",), """
SELECT page_id, ordinal, '#FF0000' AS fill_color, bg_color AS cover_color, 0.9e0 AS cover_alpha, '#00FF00' AS stroke, 2 AS stroke_px
FROM fx_blocks"""))
def styled_blocks(t: Tables) -> DataFrame:
    style = StyleConfig(text_color_mode="custom", custom_text_color="#FF0000", text_stroke=True, stroke_color="#00FF00",
                        stroke_width=0)
    return resolve_style(t["fx_blocks"], style).select(
        "page_id", "ordinal", "fill_color", "cover_color", "cover_alpha", "stroke", "stroke_px")


@query("lang_packs", """
SELECT doc_id, lang, CASE lang WHEN 'ja' THEN 'jpn+jpn_vert+eng' WHEN 'zh' THEN 'chi_sim+eng' WHEN 'en' THEN 'eng'
  WHEN 'ko' THEN 'kor+eng' WHEN 'auto' THEN 'eng+chi_sim+jpn+jpn_vert' ELSE 'eng+chi_sim' END AS lang_pack
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ja' WHEN 1 THEN 'ko' WHEN 2 THEN 'auto' ELSE lang END AS lang FROM documents)""")
def lang_packs(t: Tables) -> DataFrame:
    d = F.col("doc_id") % 5
    lang = F.when(d == 0, "ja").when(d == 1, "ko").when(d == 2, "auto").otherwise(F.col("lang"))
    return t["documents"].select("doc_id", lang.alias("lang"), L.ocr_lang_pack(lang).alias("lang_pack"))


@query("default_models", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'deepseek-chat' WHEN 2 THEN 'gpt-4o-mini'
  ELSE 'gemini-2.5-flash' END AS model FROM events""")
def default_models(t: Tables) -> DataFrame:
    provider = F.element_at(F.array(*[F.lit(p) for p in ("openai", "deepseek", "custom", "gemini")]),
                            (F.col("event_id") % 4 + 1).cast("int"))
    return t["events"].select("event_id", L.default_model(provider).alias("model"))


@query("run_progress", """
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 10 + floor(p / 100e0 * 60 + 0.5e0) WHEN 1 THEN 40 + floor(p / 100e0 * 50 + 0.5e0)
  WHEN 2 THEN 75 ELSE -1 END AS INT) AS progress
FROM (SELECT event_id, least(value, 100e0) AS p FROM events)""")
def run_progress(t: Tables) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in ("ocr", "lines", "ocr_done", "other")]),
                         (F.col("event_id") % 4 + 1).cast("int"))
    progress = L.progress_of(stage, F.least("value", F.lit(100.0)))
    return t["events"].select("event_id", F.coalesce(progress, F.lit(-1)).alias("progress"))


@query("image_payload", """
SELECT doc_id, to_base64(encode(text)) AS base64, CASE WHEN doc_id % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime
FROM documents""")
def image_payload(t: Tables) -> DataFrame:
    rows = t["documents"].select("doc_id", F.encode("text", "UTF-8").alias("content"),
                                 F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 2 == 1, "image/png").alias("media_type"))
    return with_base64(rows).select("doc_id", "base64", "mime")


@query("natural_keys", """
WITH folded AS (SELECT doc_id, source, translate(lower(concat(source, '_', lang, doc_id, '-p0', doc_id % 7, ' (x).png')),
    ' _-,;:!?.''"()[]{}@*/\\&#%`^+<=>|~$', concat(""" + ", ".join(f"chr({i + 1})" for i in range(33)) + """)) AS name FROM documents)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(name, '(\\d+|\\D+)', 1), lambda r: CASE WHEN regexp_matches(r, '^\\d')
  THEN concat(lpad(CAST(length(ltrim(r, '0')) AS VARCHAR), 10, '0'), ltrim(r, '0')) ELSE r END), '') AS sort_key FROM folded""")
def natural_keys(t: Tables) -> DataFrame:
    name = F.concat("source", F.lit("_"), "lang", F.col("doc_id").cast("string"), F.lit("-p0"),
                    (F.col("doc_id") % 7).cast("string"), F.lit(" (x).png"))
    return t["documents"].select("doc_id", natural_key(name).alias("sort_key"))
