"""Queries over text layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import layout as Y
from ..schema import StyleConfig
from .block_queries import r6
from .fixtures import Tables
from .oracle_views import CJK, SPACE, with_views
from .registry import query

# Sound effects carry the CJK texts of the fixture, so they must show.
STYLE = StyleConfig(onomatopoeia_mode="normal")


def em_sql(text: str) -> str:
    classes = ((TX.WIDE_CLASS, 0.5), ("[ijlI.,:;''!|()\\[\\] ]", -0.25), ("[mwMW@%]", 0.375), ("[A-HJ-LN-VX-Z]", 0.125))
    counts = [f"(length({text}) - length(regexp_replace({text}, '{c}', '', 'g'))) * {extra}e0" for c, extra in classes]
    return " + ".join([f"length({text}) * 0.5e0", *counts])


def px(column, name: str | None = None):
    """Six digits, ties up. Sizes are halved ten times, so ties do occur."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.floor(value * 1e6 + 0.5) / 1e6).alias(name or column)


RECTS = ("rects", f"""SELECT *, regexp_matches(translated_text, '{CJK}') AS is_cjk,
    greatest(8e0, font_size_pct * height / 100 * 1e0) AS font_px0, length(translated_text) AS n_chars
  FROM (SELECT *, xmin / 100 * width AS x, ymin / 100 * height AS y, xmax / 100 * width - xmin / 100 * width AS w,
          ymax / 100 * height - ymin / 100 * height AS h FROM fx_blocks) WHERE w > 0 AND h > 0""")
DIRECTED = ("directed", f"""SELECT *, CASE WHEN is_cjk AND h > w * 1.15e0 THEN 'vertical' ELSE 'horizontal' END AS layout_dir,
    CASE WHEN is_cjk THEN 0e0 ELSE 0.25e0 END AS gap,
    list_transform(CASE WHEN is_cjk THEN string_split(translated_text, '') ELSE regexp_split_to_array(translated_text, '{SPACE}+') END,
      lambda t: {{'n': 0, 'em': {em_sql('t')}, 'len': length(t)}}) AS tokens FROM rects""")


def room_sql(fs: str) -> str:
    return f"(h - {fs} * 0.4e0 * 2)"


def per_column_sql(fs: str) -> str:
    pitch, room = f"({fs} * 1.1e0)", room_sql(fs)
    k = f"floor({room} / {pitch})"
    return f"greatest(1, CASE WHEN ({k} + 1) * {pitch} <= {room} THEN {k} + 1 WHEN {k} * {pitch} > {room} THEN {k} - 1 ELSE {k} END)"


def fits_sql(fs: str) -> str:
    k = per_column_sql(fs)
    vertical = (f"ceil(n_chars / {k}) * ({fs} * 1.1e0) <= w - {fs} * 0.4e0 "
                f"AND least(n_chars, {k}) * {fs} * 1.1e0 <= {room_sql(fs)}")
    lines = f"""list_reduce(tokens, lambda s, t: CASE WHEN s.len > 0 AND (s.em + gap + t.em) * {fs} > w - {fs} * 0.4e0 * 2
      THEN {{'n': s.n + 1, 'em': t.em, 'len': t.len}}
      ELSE {{'n': s.n, 'em': CASE WHEN s.len > 0 THEN s.em + gap + t.em ELSE t.em END,
             'len': CASE WHEN s.len > 0 THEN s.len + 1 + t.len ELSE t.len END}} END, {{'n': 0, 'em': 0e0, 'len': CAST(0 AS BIGINT)}})"""
    horizontal = f"(SELECT (r.n + CASE WHEN r.len > 0 THEN 1 ELSE 0 END) * ({fs} * 1.2e0) <= h - {fs} * 0.4e0 * 1.5e0 FROM (SELECT {lines} AS r))"
    return f"CASE WHEN layout_dir = 'vertical' THEN {vertical} ELSE {horizontal} END"


def fit_steps(min_px: float) -> tuple[tuple[str, str], ...]:
    """Ten halvings as ten CTEs."""
    steps = [("fit_0", f"SELECT *, {min_px}e0 AS lo, font_px0 AS hi, {min_px}e0 AS best, {fits_sql('font_px0')} AS fits_first FROM directed")]
    for i in range(1, 11):
        mid = "((lo + hi) / 2)"
        steps.append((f"try_{i}", f"SELECT *, {mid} AS mid, {fits_sql(mid)} AS ok FROM fit_{i - 1}"))
        steps.append((f"fit_{i}", f"""SELECT * EXCLUDE (lo, hi, best, mid, ok), CASE WHEN ok THEN mid ELSE lo END AS lo,
            CASE WHEN ok THEN hi ELSE mid END AS hi, CASE WHEN ok THEN mid ELSE best END AS best FROM try_{i}"""))
    steps.append(("fitted", "SELECT *, CASE WHEN fits_first THEN font_px0 ELSE best END AS font_px FROM fit_10"))
    return (RECTS, DIRECTED, *steps)


@query("layout_dir", with_views(("fx_blocks",), """
SELECT page_id, ordinal, is_cjk, layout_dir, is_cjk AND (ymax - ymin) > (xmax - xmin) * 1.15e0 AS overlay_vertical FROM directed""",
                                (RECTS, DIRECTED)))
def layout_dir(t: Tables) -> DataFrame:
    blocks = Y.with_direction(Y.with_rect(t["fx_blocks"]))
    return blocks.select("page_id", "ordinal", "is_cjk", "layout_dir", Y.overlay_direction(blocks).alias("overlay_vertical"))


@query("cover_rects", with_views(("fx_blocks",), """
SELECT page_id, ordinal, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, bg_color AS cover_color, 0.9e0 AS cover_alpha
FROM rects WHERE coalesce(type, 'bubble') <> 'onomatopoeia'""", (RECTS,)))
def cover_rects(t: Tables) -> DataFrame:
    return Y.cover_rects(t["fx_blocks"], StyleConfig(onomatopoeia_mode="transparent")).select(
        "page_id", "ordinal", *[r6(c) for c in "xywh"], "cover_color", "cover_alpha")


@query("fit_font", with_views(("fx_blocks",), """
SELECT page_id, ordinal, layout_dir, floor((font_px) * 1e6 + 0.5e0) / 1e6 AS font_px FROM fitted""", fit_steps(TX.EXPORT_MIN_PX)))
def fit_font(t: Tables) -> DataFrame:
    return Y.fit_font(t["fx_blocks"], STYLE).select("page_id", "ordinal", "layout_dir", px("font_px"))


@query("fit_vertical", with_views(("fx_blocks",), """
SELECT page_id, ordinal, floor((font_px) * 1e6 + 0.5e0) / 1e6 AS font_px FROM fitted WHERE layout_dir = 'vertical'""", fit_steps(TX.VIEWER_MIN_PX)))
def fit_vertical(t: Tables) -> DataFrame:
    """The viewer's smaller least size, vertical blocks."""
    fitted = Y.fit_font(t["fx_blocks"], STYLE, TX.VIEWER_MIN_PX)
    return fitted.where(F.col("layout_dir") == "vertical").select("page_id", "ordinal", px("font_px"))


@query("place_vertical", with_views(("fx_blocks",), """
SELECT page_id, ordinal, CAST(floor(pos / k) AS INT) AS line, CAST(pos % CAST(k AS BIGINT) AS INT) AS spot, substr(translated_text, pos + 1, 1) AS glyph,
  floor((font_px) * 1e6 + 0.5e0) / 1e6 AS font_px,
  floor((x + w / 2 + ceil(n_chars / k) * (font_px * 1.1e0) / 2 - font_px * 1.1e0 / 2 - floor(pos / k) * (font_px * 1.1e0)) * 1e6 + 0.5e0) / 1e6 AS glyph_x,
  floor((y + h / 2 - least(k, n_chars - floor(pos / k) * k) * font_px * 1.1e0 / 2 + font_px * 1.1e0 / 2
    + (pos % CAST(k AS BIGINT)) * font_px * 1.1e0) * 1e6 + 0.5e0) / 1e6 AS glyph_y
FROM (SELECT *, unnest(range(n_chars)) AS pos FROM columned)""",
    fit_steps(TX.EXPORT_MIN_PX) + (("columned", f"SELECT *, {per_column_sql('font_px')} AS k FROM fitted WHERE layout_dir = 'vertical'"),)))
def place_vertical(t: Tables) -> DataFrame:
    placed = Y.place_vertical(Y.fit_font(t["fx_blocks"], STYLE))
    return placed.select("page_id", "ordinal", "line", "spot", "glyph", *[px(c) for c in ("font_px", "glyph_x", "glyph_y")])


# The lines themselves: the state keeps the open line and the finished text.
LINE_TOKENS = f"""list_transform(CASE WHEN is_cjk THEN string_split(txt, '') ELSE regexp_split_to_array(txt, '{SPACE}+') END,
      lambda t: {{'cur': t, 'em': {em_sql('t')}, 'done': '', 'n': 0}})"""


def lines_sql(tokens: str, fs: str, max_w: str) -> str:
    sep = "CASE WHEN is_cjk THEN '' ELSE ' ' END"
    return f"""list_reduce({tokens}, lambda s, t: CASE WHEN length(s.cur) > 0 AND (s.em + gap + t.em) * {fs} > {max_w}
      THEN {{'cur': t.cur, 'em': t.em, 'done': s.done || s.cur || chr(10), 'n': s.n + 1}}
      ELSE {{'cur': CASE WHEN length(s.cur) > 0 THEN s.cur || {sep} || t.cur ELSE t.cur END,
             'em': CASE WHEN length(s.cur) > 0 THEN s.em + gap + t.em ELSE t.em END, 'done': s.done, 'n': s.n}} END,
      {{'cur': '', 'em': 0e0, 'done': '', 'n': 0}})"""


@query("place_horizontal", with_views(("fx_blocks",), """
SELECT page_id, ordinal, line, line_text, font_px, line_x, line_y FROM (
  SELECT page_id, ordinal, CAST(i AS INT) AS line, string_split(txt_lines, chr(10))[i + 1] AS line_text, floor((font_px) * 1e6 + 0.5e0) / 1e6 AS font_px,
    floor((x + w / 2) * 1e6 + 0.5e0) / 1e6 AS line_x, y + h / 2 - n * (font_px * 1.2e0) / 2 + font_px * 1.2e0 / 2 + i * (font_px * 1.2e0) AS raw_y,
    floor((raw_y) * 1e6 + 0.5e0) / 1e6 AS line_y, y + h - font_px * 0.4e0 AS bottom
  FROM (SELECT *, unnest(range(n)) AS i FROM (
    SELECT *, CASE WHEN length(r.cur) > 0 THEN r.done || r.cur ELSE rtrim(r.done, chr(10)) END AS txt_lines,
      r.n + CASE WHEN length(r.cur) > 0 THEN 1 ELSE 0 END AS n FROM broken))) WHERE raw_y <= bottom""",
    fit_steps(TX.EXPORT_MIN_PX) + (
        ("broken", f"SELECT *, {lines_sql(LINE_TOKENS, 'font_px', '(w - font_px * 0.4e0 * 2)')} AS r "
                   "FROM (SELECT *, translated_text AS txt FROM fitted WHERE layout_dir = 'horizontal')"),)))
def place_horizontal(t: Tables) -> DataFrame:
    placed = Y.place_horizontal(Y.fit_font(t["fx_blocks"], STYLE))
    return placed.select("page_id", "ordinal", "line", "line_text", *[px(c) for c in ("font_px", "line_x", "line_y")])


@query("wrap_documents", f"""
WITH broken AS (SELECT doc_id, {lines_sql(LINE_TOKENS, '16e0', '480e0')} AS r
  FROM (SELECT doc_id, text AS txt, regexp_matches(text, '{CJK}') AS is_cjk,
          CASE WHEN regexp_matches(text, '{CJK}') THEN 0e0 ELSE 0.25e0 END AS gap FROM documents))
SELECT doc_id, CAST(r.n + CASE WHEN length(r.cur) > 0 THEN 1 ELSE 0 END AS INT) AS n_lines, sha256(r.done || r.cur) AS lines_hash FROM broken""")
def wrap_documents(t: Tables) -> DataFrame:
    """Whole documents broken into lines of 480 pixels at 16 pixels."""
    wrapped = Y.wrap_lines(t["documents"].select("doc_id", "text"), "text", F.lit(16.0), F.lit(480.0))
    return wrapped.select("doc_id", F.size("lines").alias("n_lines"),
                          F.sha2(F.array_join("lines", "\n"), 256).alias("lines_hash"))
