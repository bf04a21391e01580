"""The derived views of `fixtures` as SQL, for the DuckDB check."""

from __future__ import annotations

# Literals with an exponent are DOUBLE in DuckDB; plain decimals would be DECIMAL.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"[\x{4E00}-\x{9FA5}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clamp_sql(value: str, low: str = "0e0", high: str = "100e0") -> str:
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN {low} ELSE least(greatest({value}, {low}), {high}) END"


# view name -> (views it needs, SQL)
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_pages": ((), """
SELECT o_orderkey AS page_id,
  concat('ch', CAST(o_custkey % 20 AS STRING), '_p', CAST(o_orderkey % 400 AS STRING),
    CASE o_orderkey % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.webp' WHEN 3 THEN '.bmp' ELSE '.txt' END) AS name,
  CAST(600 + (o_orderkey % 7) * 100 AS INT) AS width,
  CAST(900 + (o_orderkey % 5) * 150 AS INT) AS height,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'idle' ELSE 'failed' END AS status
FROM orders"""),
    "fx_ocr": ((), """
SELECT page_id, ordinal, text, confidence, px0, py0, px0 + bw AS px1, py0 + bh AS py1, bw, bh, kind FROM (
  SELECT l_orderkey AS page_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS ordinal,
    CASE WHEN l_returnflag = 'R' THEN translate(p_name, 'aeiou', 'あえいおう') ELSE concat('  ', p_name, ' ') END AS text,
    1.0 - l_discount AS confidence,
    CAST((l_partkey * 37) % 560 AS INT) AS px0,
    CAST((l_suppkey * 91 + l_linenumber * 83) % 880 AS INT) AS py0,
    CAST(CASE WHEN l_quantity = 50 THEN 0 ELSE 10 + l_quantity * 4 END AS INT) AS bw,
    CAST(12 + (l_partkey * 13) % 240 AS INT) AS bh,
    CASE l_returnflag WHEN 'R' THEN 'onomatopoeia' WHEN 'A' THEN 'bubble' ELSE NULL END AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey) t"""),
    "fx_ocr_edited": (("fx_ocr",), """
SELECT page_id, ordinal, text, px0 + CASE WHEN page_id % 3 = 0 THEN 5 ELSE 0 END AS px0, py0,
  px1 + CASE WHEN page_id % 3 = 0 THEN 5 ELSE 0 END AS px1, py1,
  CASE WHEN page_id % 7 = 0 THEN 'bubble' ELSE kind END AS kind
FROM fx_ocr WHERE NOT (page_id % 5 = 0 AND ordinal >= 3)"""),
    "fx_artifacts": (("fx_pages",), """
SELECT concat(CASE WHEN page_id % 11 = 0 THEN 'gone_' ELSE '' END, name,
    CASE page_id % 4 WHEN 0 THEN '_blocks.json' WHEN 1 THEN '_erased.png' WHEN 2 THEN '_translated.png' ELSE '.tmp' END) AS file_name,
  CASE WHEN width % 200 = 0 THEN 'cache' ELSE 'root' END AS location
FROM fx_pages"""),
    "fx_replies": ((), """
SELECT event_id, user_id AS page_id, concat(
  CASE event_id % 5 WHEN 1 THEN concat('```json', chr(10)) WHEN 2 THEN concat('```', chr(10)) WHEN 3 THEN 'Sure: ' ELSE '' END,
  '{"translations":[{"id":"b', CAST(event_id % 7 AS STRING), '","translated_text":"', event_type,
  '"},{"id":"b', CAST((event_id * 3) % 7 AS STRING), '","translated_text":"","type":"onomatopoeia"}]',
  CASE event_id % 5 WHEN 4 THEN '' ELSE '}' END,
  CASE event_id % 5 WHEN 1 THEN concat(chr(10), '```') WHEN 2 THEN concat(chr(10), '```') WHEN 3 THEN ' done.' ELSE '' END) AS raw
FROM events"""),
    "fx_edits": ((), """
SELECT event_id AS seq, user_id AS page_id, concat('b', CAST(event_id % 4 AS STRING)) AS block_id, ts,
  CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'text_color' WHEN 'purchase' THEN 'move' WHEN 'signup' THEN 'type' ELSE 'delete' END AS op,
  props AS payload, value / 10 AS dx, (200 - value) / 10 AS dy
FROM events"""),
    "fx_pixels": ((), """
SELECT crop_id, label, x, y, CAST(floor(least(greatest((CAST(e AS DOUBLE) *
    (CASE WHEN label % 2 = 0 AND (x IN (0, 7) OR y IN (0, 7)) THEN 0.3e0 ELSE 1e0 END) + 0.5e0) * 255, 0), 255)) AS INT) AS gray
FROM (SELECT vec_id AS crop_id, label, CAST(floor(pos / 8) AS INT) AS y, CAST(pos % 8 AS INT) AS x, e
      FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings))"""),
    "fx_blocks": (("fx_pages", "fx_ocr"), f"""
SELECT page_id, ordinal, concat_ws('_', 'block', page_id, ordinal) AS block_id, {trim_sql('text')} AS original_text,
  {trim_sql('text')} AS translated_text,
  {clamp_sql('px0 / width * 100')} AS xmin, {clamp_sql('py0 / height * 100')} AS ymin,
  {clamp_sql('px1 / width * 100')} AS xmax, {clamp_sql('py1 / height * 100')} AS ymax,
  greatest(1.2e0, CASE WHEN bh > bw * 1.15e0 THEN bw ELSE bh END / height * 100) AS font_size_pct,
  bh > bw * 1.15e0 AS is_vertical, width, height, kind AS type,
  CASE WHEN ordinal % 2 = 0 THEN '#000000' ELSE '#112233' END AS text_color,
  CASE WHEN ordinal % 3 = 0 THEN '#ffffff' ELSE '#eeeecc' END AS bg_color
FROM fx_ocr JOIN fx_pages USING (page_id)"""),
    "fx_colour_pixels": (("fx_pixels",), """
SELECT crop_id, label, x, y, 255 - gray AS b, gray AS g, CAST(floor(gray / 2) AS INT) AS r FROM fx_pixels"""),
}


def with_views(names: tuple[str, ...], body: str, more: tuple[tuple[str, str], ...] = ()) -> str:
    """`body` after the named views (and what they need) and further CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEW_SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = [(n, VIEW_SQL[n][1]) for n in ordered] + list(more)
    head = ",\n".join(f"{n} AS ({sql})" for n, sql in ctes)
    return f"WITH RECURSIVE {head}\n{body}" if ctes else body
