"""Queries over edit logs and page events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits as D
from ..operators import payload as P
from ..schema import StyleConfig
from ..streaming.edits import invalidate_erased
from .block_queries import BOX, BOX_SQL
from .fixtures import Tables
from .oracle_views import with_views
from .registry import query


@query("debounced_edits", with_views(("fx_edits",), """
SELECT page_id, ts + INTERVAL 6 HOURS AS fire_at, seq, payload FROM (
  SELECT *, lead(ts) OVER (PARTITION BY page_id ORDER BY ts, seq) AS next_ts FROM fx_edits)
WHERE next_ts IS NULL OR next_ts > ts + INTERVAL 6 HOURS"""))
def debounced_edits(t: Tables) -> DataFrame:
    return D.debounce(t["fx_edits"], "payload", "6 hours")


@query("debounce_default", with_views(("fx_edits",), """
SELECT page_id, ts + INTERVAL 800 MILLISECONDS AS fire_at, seq, payload FROM (
  SELECT *, lead(ts) OVER (PARTITION BY page_id ORDER BY ts, seq) AS next_ts FROM fx_edits)
WHERE next_ts IS NULL OR next_ts > ts + INTERVAL 800 MILLISECONDS"""))
def debounce_default(t: Tables) -> DataFrame:
    return D.debounce(t["fx_edits"], "payload")


@query("latest_progress", """
SELECT user_id AS page_id, arg_max(CAST(trunc(value) AS INT), {'ts': ts, 'seq': event_id}) AS progress FROM events GROUP BY user_id""")
def latest_progress(t: Tables) -> DataFrame:
    return D.latest_progress(t["events"].select(F.col("user_id").alias("page_id"), "ts", F.col("event_id").alias("seq"),
                                                F.col("value").cast("int").alias("progress")))


STATE_SQL = """
SELECT page_id, CASE arg_max(event, o) WHEN 'finished' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'processing' END AS status,
  coalesce(arg_max(percent, o) FILTER (WHERE percent IS NOT NULL), 0) AS progress,
  CASE WHEN arg_max(event, o) = 'failed' THEN arg_max(props, o) END AS error, count(*) FILTER (WHERE event = 'started') AS attempts
FROM (SELECT *, {'ts': ts, 'seq': event_id} AS o,
        CASE event WHEN 'finished' THEN 100 WHEN 'started' THEN 0 WHEN 'progress' THEN CAST(trunc(value) AS INT) END AS percent
      FROM (SELECT *, user_id AS page_id, CASE event_type WHEN 'click' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'finished'
              WHEN 'signup' THEN 'failed' ELSE 'progress' END AS event FROM events))
GROUP BY page_id"""


def state_events(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    event = (F.when(kind == "click", "started").when(kind == "purchase", "finished").when(kind == "signup", "failed")
             .otherwise("progress"))
    return t["events"].select(F.col("user_id").alias("page_id"), "ts", F.col("event_id").alias("seq"), event.alias("event"),
                              F.col("value").alias("progress"), F.col("props").alias("error"))


@query("page_states", STATE_SQL)
def page_states(t: Tables) -> DataFrame:
    return D.page_state(state_events(t))


EDITED = (
    ("base", """SELECT page_id, 'b' || ordinal AS block_id, ordinal, xmin, ymin, xmax, ymax, translated_text, coalesce(type, 'bubble') AS type, text_color, bg_color, width, height FROM fx_blocks"""),
    ("log", """SELECT page_id, payload, dx, dy, {'ts': ts, 'seq': seq} AS o, CASE WHEN seq % 11 = 0 THEN 'n' || seq ELSE block_id END AS block_id,
        CASE WHEN seq % 11 = 0 THEN 'create' WHEN op = 'move' AND seq % 2 = 1 THEN 'resize' WHEN op = 'text_color' AND seq % 2 = 1 THEN 'bg_color' ELSE op END AS op
      FROM fx_edits"""),
    ("reduced", """SELECT page_id, block_id, arg_max(payload, o) FILTER (WHERE op = 'text') AS e_text, arg_max(payload, o) FILTER (WHERE op = 'text_color') AS e_color,
        arg_max(payload, o) FILTER (WHERE op = 'type') AS e_type, arg_max(payload, o) FILTER (WHERE op = 'bg_color') AS e_bg, min(o) FILTER (WHERE op = 'create') AS made,
        arg_max({'dx': dx, 'dy': dy, 'op': op}, o) FILTER (WHERE op IN ('move', 'resize')) AS e_move, bool_or(op = 'delete') AS gone
      FROM log GROUP BY page_id, block_id"""),
    ("moved", """SELECT *, xmax - xmin AS sw, ymax - ymin AS sh, CASE WHEN xmin + e_move.dx < 0 THEN 0 ELSE xmin + e_move.dx END AS mx0,
        CASE WHEN xmin + e_move.dx < 0 THEN xmax - xmin ELSE xmax + e_move.dx END AS mx1, CASE WHEN ymin + e_move.dy < 0 THEN 0 ELSE ymin + e_move.dy END AS my0,
        CASE WHEN ymin + e_move.dy < 0 THEN ymax - ymin ELSE ymax + e_move.dy END AS my1 FROM base LEFT JOIN reduced USING (page_id, block_id)"""),
    ("after", """SELECT page_id, block_id, ordinal, coalesce(e_text, translated_text) AS translated_text, coalesce(e_type, type) AS type, coalesce(e_color, text_color) AS text_color,
        coalesce(e_bg, bg_color) AS bg_color, width, height, CAST(NULL AS STRUCT(ts TIMESTAMP, seq BIGINT)) AS made,
        CASE WHEN e_move IS NULL OR e_move.op = 'resize' THEN xmin WHEN mx1 > 100 THEN 100 - sw ELSE mx0 END AS xmin, CASE WHEN e_move IS NULL THEN xmax WHEN e_move.op = 'resize' THEN least(100e0, greatest(xmin + 2, xmax + e_move.dx)) WHEN mx1 > 100 THEN 100 ELSE mx1 END AS xmax,
        CASE WHEN e_move IS NULL OR e_move.op = 'resize' THEN ymin WHEN my1 > 100 THEN 100 - sh ELSE my0 END AS ymin, CASE WHEN e_move IS NULL THEN ymax WHEN e_move.op = 'resize' THEN least(100e0, greatest(ymin + 2, ymax + e_move.dy)) WHEN my1 > 100 THEN 100 ELSE my1 END AS ymax
      FROM moved WHERE NOT coalesce(gone, false)
      UNION ALL
      SELECT r.page_id, r.block_id, NULL, '新文字框', 'bubble', '#FFFFFF', '#000000', s.width, s.height, r.made, 40e0, 60e0, 40e0, 48e0
      FROM reduced r LEFT JOIN (SELECT page_id, max(width) AS width, max(height) AS height FROM base GROUP BY page_id) s ON s.page_id = r.page_id
      WHERE r.made IS NOT NULL"""),
)


@query("apply_edits", with_views(("fx_blocks", "fx_edits"), f"""
SELECT page_id, block_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ordinal NULLS LAST, made, block_id) - 1 AS INT) AS ordinal,
  translated_text, type, text_color, bg_color, width, height, {BOX_SQL} FROM after""", EDITED))
def apply_edits(t: Tables) -> DataFrame:
    """Every drag in the log starts from the detected box. Every eleventh edit makes a new block."""
    return edited_blocks(t).withColumns({c: F.round(c, 6) for c in BOX})


def edited_blocks(t: Tables) -> DataFrame:
    blocks = t["fx_blocks"].select("page_id", F.concat(F.lit("b"), F.col("ordinal").cast("string")).alias("block_id"), "ordinal",
                                   *BOX, "translated_text", F.coalesce("type", F.lit("bubble")).alias("type"), "text_color",
                                   "bg_color", "width", "height")
    made = F.col("seq") % 11 == 0
    odd = F.col("seq") % 2 == 1
    op = (F.when(made, "create").when((F.col("op") == "move") & odd, "resize").when((F.col("op") == "text_color") & odd, "bg_color")
          .otherwise(F.col("op")))
    edited = t["fx_edits"].withColumns({"op": op, "block_id": F.when(made, F.concat(F.lit("n"), F.col("seq").cast("string"))).otherwise(F.col("block_id"))})
    edits = edited.select("page_id", "block_id", "ts", "seq", "op", F.col("payload").alias("value"), F.struct("op", "dx", "dy").alias("drag"))
    return D.apply_edits(blocks, edits)


@query("edited_stale_pages", with_views(("fx_blocks", "fx_edits"), """
SELECT page_id FROM (SELECT page_id, list({'o': ordinal, 't': translated_text, 'c': text_color, 'b': bg_color, 'k': type} ORDER BY ordinal) AS v FROM numbered GROUP BY page_id) n
FULL JOIN (SELECT page_id, list({'o': ordinal, 't': translated_text, 'c': text_color, 'b': bg_color, 'k': type} ORDER BY ordinal) AS v FROM base GROUP BY page_id) o USING (page_id)
WHERE n.v IS DISTINCT FROM o.v""", EDITED + (
    ("numbered", """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ordinal NULLS LAST, made, block_id) - 1 AS INT) AS ordinal,
        translated_text, text_color, bg_color, type FROM after"""),)))
def edited_stale_pages(t: Tables) -> DataFrame:
    """Edit log, then render hash: the pages that have to be rendered again, emptied and newly filled ones among them."""
    before, after = (P.render_hash(b, StyleConfig()).withColumnRenamed("render_hash", name)
                     for b, name in ((t["fx_blocks"], "old"), (edited_blocks(t), "new")))
    return before.join(after, "page_id", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("page_id")


def _step(low: str, high: str, delta: str) -> tuple[str, str]:
    """New ends of one axis after a move, and the new upper end after a resize."""
    size = f"(s.{high} - s.{low})"
    down = f"s.{low} + e.{delta} < 0"
    new_high = f"CASE WHEN {down} THEN {size} ELSE s.{high} + e.{delta} END"
    move_low = f"CASE WHEN {new_high} > 100 THEN 100 - {size} WHEN {down} THEN 0e0 ELSE s.{low} + e.{delta} END"
    move_high = f"CASE WHEN {new_high} > 100 THEN 100e0 ELSE {new_high} END"
    return (f"CASE WHEN e.op = 'resize' THEN s.{low} ELSE {move_low} END",
            f"CASE WHEN e.op = 'resize' THEN least(100e0, greatest(s.{low} + 2, s.{high} + e.{delta})) ELSE {move_high} END")


X_STEP, Y_STEP = _step("xmin", "xmax", "dx"), _step("ymin", "ymax", "dy")
FOLDED = (
    ("base", "SELECT page_id, 'b' || ordinal AS block_id, ordinal, xmin, ymin, xmax, ymax FROM fx_blocks"),
    ("drags", """SELECT page_id, block_id, list({'op': CASE op WHEN 'move' THEN 'move' ELSE 'resize' END, 'dx': CAST(dx - 5 AS DOUBLE), 'dy': CAST(dy - 10 AS DOUBLE),
        'xmin': 0e0, 'ymin': 0e0, 'xmax': 0e0, 'ymax': 0e0} ORDER BY ts, seq) AS steps FROM fx_edits WHERE op IN ('move', 'type') GROUP BY page_id, block_id"""),
    ("folded", f"""SELECT page_id, block_id, ordinal, list_reduce(coalesce(steps, []), lambda s, e: {{'op': e.op, 'dx': e.dx, 'dy': e.dy,
        'xmin': {X_STEP[0]}, 'ymin': {Y_STEP[0]}, 'xmax': {X_STEP[1]}, 'ymax': {Y_STEP[1]}}},
        {{'op': '', 'dx': 0e0, 'dy': 0e0, 'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}}) AS r FROM base LEFT JOIN drags USING (page_id, block_id)"""),
)


@query("folded_drags", with_views(("fx_blocks", "fx_edits"), """
SELECT page_id, block_id, ordinal, round(r.xmin, 6) AS xmin, round(r.ymin, 6) AS ymin, round(r.xmax, 6) AS xmax, round(r.ymax, 6) AS ymax FROM folded""", FOLDED))
def folded_drags(t: Tables) -> DataFrame:
    """Drags one after another: purchases move a block, sign-ups resize it."""
    blocks = t["fx_blocks"].select("page_id", F.concat(F.lit("b"), F.col("ordinal").cast("string")).alias("block_id"), "ordinal", *BOX)
    drags = t["fx_edits"].where(F.col("op").isin("move", "type")).select(
        "page_id", "block_id", "ts", "seq", F.when(F.col("op") == "move", "move").otherwise("resize").alias("op"),
        (F.col("dx") - 5).alias("dx"), (F.col("dy") - 10).alias("dy"))
    return D.fold_drags(blocks, drags).withColumns({c: F.round(c, 6) for c in BOX})


@query("created_blocks", """
SELECT user_id AS page_id, 'n' || event_id AS block_id, '' AS original_text, '新文字框' AS translated_text, 40e0 AS xmin, 60e0 AS xmax,
  40e0 AS ymin, 48e0 AS ymax, '#FFFFFF' AS text_color, '#000000' AS bg_color, 2.2e0 AS font_size_pct, 'bubble' AS type FROM events""")
def created_blocks(t: Tables) -> DataFrame:
    """A hand-made block for every event."""
    asked = t["events"].select(F.col("user_id").alias("page_id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("block_id"))
    return D.new_blocks(asked)


@query("invalidated_pages", with_views(("fx_ocr", "fx_ocr_edited"), """
SELECT page_id, count(*) AS n_changed FROM (
  SELECT coalesce(o.page_id, n.page_id) AS page_id FROM (SELECT *, true AS here FROM fx_ocr WHERE page_id IN (SELECT page_id FROM fx_ocr_edited)) o
  FULL JOIN (SELECT *, true AS here FROM fx_ocr_edited) n ON o.page_id = n.page_id AND o.ordinal = n.ordinal
  WHERE o.here IS DISTINCT FROM n.here OR o.px0 IS DISTINCT FROM n.px0 OR o.px1 IS DISTINCT FROM n.px1
    OR o.py0 IS DISTINCT FROM n.py0 OR o.py1 IS DISTINCT FROM n.py1 OR o.kind IS DISTINCT FROM n.kind)
GROUP BY page_id"""))
def invalidated_pages(t: Tables) -> DataFrame:
    """The edited blocks as one micro-batch against the stored ones."""
    names = {"px0": "xmin", "px1": "xmax", "py0": "ymin", "py1": "ymax", "kind": "type"}
    return invalidate_erased(t["fx_ocr_edited"].withColumnsRenamed(names), t["fx_ocr"].withColumnsRenamed(names))
