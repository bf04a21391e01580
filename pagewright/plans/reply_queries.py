"""Queries over model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import replies as R
from ..operators import routing as W
from ..operators.payload import request_payload
from ..plugins import echo_translator, run_translator
from .block_queries import BOX, r6
from .fixtures import Tables
from .oracle_views import clamp_sql, trim_sql, with_views
from .registry import query

# The extraction steps in SQL: text, unfenced text, brace span, bracket span.
EXTRACT_SQL = (
    ("trimmed", f"SELECT event_id, page_id, {trim_sql('raw')} AS t FROM fx_replies"),
    ("unfenced", f"""SELECT *, CASE
        WHEN starts_with(t, '```json') THEN {trim_sql("regexp_replace(substr(t, 8), '```$', '')")}
        WHEN starts_with(t, '```') THEN {trim_sql("regexp_replace(substr(t, 4), '```$', '')")} ELSE t END AS c FROM trimmed"""),
    ("spans", r"""SELECT *, regexp_extract(c, '(\{.*\})', 1, 's') AS braces, regexp_extract(c, '(\[.*\])', 1, 's') AS brackets FROM unfenced"""),
    ("extracted", """SELECT event_id, page_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) WHEN json_valid(c) THEN CAST(c AS JSON)
        WHEN braces <> '' AND json_valid(braces) THEN CAST(braces AS JSON)
        WHEN braces <> '' AND json_valid(brackets) THEN CAST(brackets AS JSON) END AS j FROM spans"""),
    ("checked", """SELECT event_id, page_id, j, CASE WHEN j IS NULL THEN 'JSON parse failed'
        WHEN coalesce(json_type(j, '$.translations'), '') <> 'ARRAY' THEN 'Invalid response structure' END AS error FROM extracted"""),
    ("items", """SELECT event_id, page_id, pos, json_extract_string(item, '$.id') AS block_id,
        coalesce(json_extract_string(item, '$.translated_text'), '') AS translated_text,
        coalesce(nullif(json_extract_string(item, '$.type'), ''), 'bubble') AS type
      FROM (SELECT event_id, page_id, unnest(CAST(j->'$.translations' AS JSON[])) AS item,
              unnest(range(CAST(json_array_length(j, '$.translations') AS BIGINT))) AS pos FROM checked WHERE error IS NULL)"""),
)


@query("reply_extract", with_views(("fx_replies",), """
SELECT event_id, page_id, CASE WHEN error IS NULL THEN CAST(json_array_length(j, '$.translations') AS INT) ELSE 0 END AS n_items, error
FROM checked""", EXTRACT_SQL))
def reply_extract(t: Tables) -> DataFrame:
    parsed = R.parse_reply(t["fx_replies"], "translations")
    return parsed.select("event_id", "page_id", F.coalesce(F.array_size("items"), F.lit(0)).alias("n_items"), "error")


@query("reply_items", with_views(("fx_replies",), """
SELECT event_id, page_id, CAST(pos AS INT) AS pos, block_id, translated_text, type FROM items""", EXTRACT_SQL))
def reply_items(t: Tables) -> DataFrame:
    return R.translations(R.parse_reply(t["fx_replies"], "translations"))


@query("reply_envelopes", """
SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS raw,
  CASE WHEN event_id % 6 = 0 THEN 'Empty response' END AS error FROM events""")
def reply_envelopes(t: Tables) -> DataFrame:
    """Chat answers of two providers; every sixth is empty or has no choice."""
    e = F.col("event_id")
    text = F.when(e % 6 == 0, "").otherwise(F.col("event_type"))
    chat = F.struct(F.when(e % 12 != 0, F.array(F.struct(F.struct(text.alias("content")).alias("message")))).alias("choices"))
    parts = F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    rows = t["events"].select("event_id", F.to_json(chat).alias("chat"), F.to_json(parts).alias("parts"))
    first = R.open_envelope(rows.where(e % 2 == 0).select("event_id", F.col("chat").alias("envelope")), "openai")
    second = R.open_envelope(rows.where(e % 2 == 1).select("event_id", F.col("parts").alias("envelope")), "gemini")
    return first.unionByName(second)


@query("repair_blocks", f"""
SELECT event_id AS page_id, i AS ordinal, concat_ws('_', 'block', event_id, i) AS block_id,
  CASE WHEN i = 0 THEN event_type ELSE '' END AS original_text, '' AS translated_text,
  round(CASE WHEN i = 0 THEN {clamp_sql('value - 20')} ELSE 0e0 END, 6) AS ymin, CASE WHEN i = 0 THEN 12.5e0 ELSE 0e0 END AS xmin,
  CASE WHEN i = 0 THEN 100e0 ELSE 0e0 END AS ymax, CASE WHEN i = 0 THEN 0e0 ELSE 0e0 END AS xmax,
  CASE WHEN i = 0 THEN '#010203' ELSE '#FFFFFF' END AS text_color, '#000000' AS bg_color, 2e0 AS font_size_pct,
  CASE WHEN i = 0 THEN 'onomatopoeia' ELSE 'bubble' END AS type
FROM events, (VALUES (0), (1)) v(i)""")
def repair_blocks(t: Tables) -> DataFrame:
    """Vision replies with numbers as text, values out of range and an empty item."""
    raw = F.concat(F.lit('{"blocks":[{"original_text":"'), "event_type", F.lit('","ymin":"'), (F.col("value") - 20).cast("string"),
                   F.lit('","xmin":"12.5","ymax":101,"xmax":null,"text_color":"#010203","bg_color":"","font_size_pct":0,'
                         '"type":"onomatopoeia"},{}]}'))
    rows = R.repair_blocks(R.parse_reply(t["events"].select(F.col("event_id").alias("page_id"), raw.alias("raw")), "blocks"))
    return rows.withColumns({c: F.round(c, 6) for c in BOX})


@query("attach_translations", with_views(("fx_replies", "fx_ocr"), """
SELECT page_id, ordinal, block_id, CASE WHEN hit THEN new_text ELSE text END AS translated_text,
  CASE WHEN hit THEN new_type ELSE coalesce(kind, 'bubble') END AS type
FROM (SELECT o.page_id, o.ordinal, 'b' || o.ordinal AS block_id, o.text, o.kind, i.block_id IS NOT NULL AS hit,
        i.translated_text AS new_text, i.type AS new_type
      FROM fx_ocr o LEFT JOIN (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY page_id, block_id ORDER BY event_id DESC, pos DESC) = 1) i
        ON o.page_id = i.page_id AND i.block_id = 'b' || o.ordinal)""", EXTRACT_SQL))
def attach_translations(t: Tables) -> DataFrame:
    items = R.translations(R.parse_reply(t["fx_replies"], "translations"))
    blocks = t["fx_ocr"].select("page_id", "ordinal", F.concat(F.lit("b"), F.col("ordinal").cast("string")).alias("block_id"),
                                F.col("text").alias("original_text"), F.col("kind").alias("type"))
    return R.attach_translations(blocks, items, ["event_id", "pos"]).drop("original_text")


@query("stub_translate", with_views(("fx_blocks",), """
SELECT page_id, ordinal, block_id, upper(original_text) AS translated_text, 'bubble' AS type FROM fx_blocks"""))
def stub_translate(t: Tables) -> DataFrame:
    """Requests through the translator plug-in and back onto the blocks."""
    blocks = t["fx_blocks"].select("page_id", "ordinal", "block_id", "original_text", "type", *BOX)
    replies = run_translator(request_payload(blocks), echo_translator)
    items = R.translations(R.parse_reply(replies, "translations"))
    return R.attach_translations(blocks, items, ["part", "pos"]).select("page_id", "ordinal", "block_id", "translated_text", "type")


@query("page_routes", with_views(("fx_pages",), """
SELECT page_id, provider, ocr_online, CASE WHEN provider = 'other' THEN NULL WHEN ocr_online THEN 'ocr+text'
    WHEN provider = 'deepseek' THEN 'lines+text' ELSE 'vision' END AS route,
  CASE WHEN provider = 'other' THEN 'Unsupported provider: other' END AS error
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'gemini' WHEN 1 THEN 'openai' WHEN 2 THEN 'custom' WHEN 3 THEN 'deepseek' ELSE 'other' END AS provider,
  height % 4 = 0 AS ocr_online FROM fx_pages)"""))
def page_routes(t: Tables) -> DataFrame:
    provider = F.element_at(F.array(*[F.lit(p) for p in ("gemini", "openai", "custom", "deepseek", "other")]),
                            (F.col("page_id") % 5 + 1).cast("int"))
    return W.route(t["fx_pages"].select("page_id", provider.alias("provider"), (F.col("height") % 4 == 0).alias("ocr_online")))


@query("work_list", with_views(("fx_pages",), "SELECT page_id, name, status FROM fx_pages WHERE status IN ('idle', 'failed')"))
def work_list(t: Tables) -> DataFrame:
    return W.work_list(t["fx_pages"]).select("page_id", "name", "status")


@query("page_by_id", with_views(("fx_pages",), "SELECT * FROM fx_pages WHERE page_id = 7"))
def page_by_id(t: Tables) -> DataFrame:
    return W.page_by_id(t["fx_pages"], 7)
