"""Edit logs and page events as batch tables. Streams use the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import ensure_checkpoint_dir
from .ranking import row_numbers, with_ordinal

BOX = ("xmin", "ymin", "xmax", "ymax")
# A block made by hand in the viewer.
NEW_BLOCK = {
    "original_text": "", "translated_text": "新文字框", "xmin": 40.0, "xmax": 60.0, "ymin": 40.0, "ymax": 48.0,
    "text_color": "#FFFFFF", "bg_color": "#000000", "font_size_pct": 2.2, "type": "bubble",
}
DEBOUNCE = "800 milliseconds"
CELLS_PER_BLOCK = 1024
DRAGS_PER_STEP = 100_000


def new_blocks(requests: DataFrame) -> DataFrame:
    """A hand-made block with the fixed defaults for each (page_id, block_id)."""
    return requests.select("page_id", "block_id", *[F.lit(v).alias(c) for c, v in NEW_BLOCK.items()])


def debounce(edits: DataFrame, payload: str, gap: str = DEBOUNCE, key: str = "page_id") -> DataFrame:
    """The last edit of each burst: (key, fire_at, seq, payload).

    An edit fires when its page has no other edit up to and including `gap`
    later. Within a cell of half a gap only the last edit can fire, so edits
    are first reduced to one row per page and cell, before the shuffle. The
    next edit is then looked up in blocks of CELLS_PER_BLOCK cells plus the
    first edit of the block after it: no window grows with the page.
    """
    gap_s = F.expr(f"INTERVAL {gap}")
    order = F.struct("ts", "seq")
    # Whole microseconds keep the cell borders exact.
    cell = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(int(_seconds(gap) * 500_000)))
    cells = edits.groupBy(key, cell.alias("_cell")).agg(
        F.min("ts").alias("_first"), F.max_by(F.struct("ts", "seq", payload), order).alias("_last"))
    cells = cells.withColumn("_block", F.floor(F.col("_cell") / CELLS_PER_BLOCK))
    starts = cells.groupBy(key, "_block").agg(F.min("_first").alias("_after"))
    following = starts.withColumn("_block", F.col("_block") - 1)
    inside = Window.partitionBy(key, "_block").orderBy("_cell")
    rows = cells.withColumn("_next", F.lead("_first").over(inside)).join(following, [key, "_block"], "left")
    next_ts, fire_at = F.coalesce("_next", "_after"), F.col("_last.ts") + gap_s
    return rows.where(next_ts.isNull() | (next_ts > fire_at)).select(
        key, fire_at.alias("fire_at"), "_last.seq", F.col(f"_last.{payload}"))


def _seconds(gap: str) -> float:
    amount, unit = gap.split()
    return float(amount) * {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def drag_box(start: dict[str, Column], op: Column, dx: Column, dy: Column) -> Column:
    """Box after a drag that began at `start`."""
    moved, resized = G.move_box(start, dx, dy), G.resize_box(start, dx, dy)
    return F.struct(*[F.when(op == "resize", resized[c]).otherwise(moved[c]).alias(c) for c in BOX])


def apply_edits(blocks: DataFrame, edits: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Blocks after an edit log.

    `edits`: page_id, block_id, ts, seq, op, value, and a `box` struct for
    move and resize: the box after the drag, as `drag_box` gives it. Where every
    drag starts from the box in `blocks`, a `drag` struct (op, dx, dy) takes its
    place, so the log need not be joined with the blocks before. Ops: text,
    type, text_color, bg_color, move, resize, create, delete. The last write
    per field counts, a deleted block stays deleted, a created one starts from
    NEW_BLOCK. The log is reduced per block before the shuffle, so a busy block
    is no hot task.

    Where `blocks` has an `ordinal`, created blocks stand at the end of their
    page in the order of their creation and deleted ones leave no gap. Where it
    has `width` and `height`, a created block takes those of its page: from
    `pages` (page_id, width, height) or else from the page's other blocks.
    """
    order = F.struct("ts", "seq")

    def last(ops: tuple[str, ...], value: str) -> Column:
        hit = F.col("op").isin(*ops)
        return F.max_by(F.when(hit, F.col(value)), F.when(hit, order))

    by_distance = "drag" in edits.columns
    reduced = edits.groupBy("page_id", "block_id").agg(
        last(("text",), "value").alias("e_translated_text"), last(("type",), "value").alias("e_type"),
        last(("text_color",), "value").alias("e_text_color"), last(("bg_color",), "value").alias("e_bg_color"),
        last(("move", "resize"), "drag" if by_distance else "box").alias("e_box"),
        F.bool_or(F.col("op") == "delete").alias("e_deleted"),
        F.min(F.when(F.col("op") == "create", order)).alias("e_created"))
    present = blocks.withColumn("_old", F.lit(True))
    joined = present.join(reduced, ["page_id", "block_id"], "full")
    old = F.coalesce(F.col("_old"), F.lit(False))
    kept = joined.where((old | F.col("e_created").isNotNull()) & ~F.coalesce("e_deleted", F.lit(False)))
    if by_distance:
        dragged = drag_box({c: F.col(c) for c in BOX}, *[F.col(f"e_box.{c}") for c in ("op", "dx", "dy")])
        kept = kept.withColumn("e_box", F.when(F.col("e_box").isNotNull(), dragged))

    def value(c: str) -> Column:
        base = F.when(old, F.col(c)).otherwise(F.lit(NEW_BLOCK[c])) if c in NEW_BLOCK else F.col(c)
        if c in BOX:
            return F.coalesce(F.col(f"e_box.{c}"), base)
        if c in ("translated_text", "type", "text_color", "bg_color"):
            return F.coalesce(F.col(f"e_{c}"), base)
        return base

    done = kept.select(*[value(c).alias(c) for c in blocks.columns], F.col("e_created").alias("_made"), (~old).alias("_new"))
    size = [c for c in ("width", "height") if c in blocks.columns]
    if size:
        known = (pages if pages is not None else blocks).groupBy("page_id").agg(*[F.max(c).alias(f"_{c}") for c in size])
        done = done.join(known, "page_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in size})
    if "ordinal" in blocks.columns:
        place = [F.col("_new"), F.when(~F.col("_new"), F.col("ordinal")), F.when(F.col("_new"), F.col("_made")), F.col("block_id")]
        most = blocks.select("page_id").unionByName(edits.where(F.col("op") == "create").select("page_id"))
        done = with_ordinal(done.withColumn("_place", F.struct(*place)).drop("ordinal"), ["page_id"], ["_place"], bound=most)
    return done.select(*blocks.columns)


def fold_drags(blocks: DataFrame, drags: DataFrame, part_rows: int = DRAGS_PER_STEP) -> DataFrame:
    """Boxes after drags that are known by their distances only.

    `drags`: page_id, block_id, ts, seq, op (move or resize), dx, dy. Each drag
    starts where the one before it ended, so they apply in (ts, seq) order. A
    block with more than `part_rows` drags takes several steps; no list grows
    past `part_rows`.
    """
    keys = ["page_id", "block_id"]
    cut = row_numbers(drags, keys, ["ts", "seq"], "_n").withColumn("_part", F.floor((F.col("_n") - 1) / part_rows))
    lists = cut.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(F.struct("_n", "op", "dx", "dy"))).alias("_drags"))
    last = lists.agg(F.max("_part")).head()[0]
    if last is None:
        return blocks
    if last > 0:
        ensure_checkpoint_dir(blocks.sparkSession)
        lists = lists.checkpoint()
    for part in range(last + 1):
        joined = blocks.join(lists.where(F.col("_part") == part).drop("_part"), keys, "left")
        box = F.aggregate(F.coalesce("_drags", F.array().cast("array<struct<_n:bigint,op:string,dx:double,dy:double>>")),
                          F.struct(*BOX), lambda s, d: drag_box({c: s[c] for c in BOX}, d["op"], d["dx"], d["dy"]))
        moved = joined.withColumn("_box", box)
        blocks = moved.select(*[F.col(f"_box.{c}").alias(c) if c in BOX else F.col(c) for c in blocks.columns])
        if part < last:
            blocks = blocks.checkpoint()
    return blocks


def latest_progress(events: DataFrame) -> DataFrame:
    """(page_id, progress) at the latest time."""
    return events.groupBy("page_id").agg(F.max_by("progress", F.struct("ts", "seq")).alias("progress"))


def page_state(events: DataFrame) -> DataFrame:
    """State per page from its events: status, progress, error, attempts.

    `events`: page_id, ts, seq, event (started, progress, finished, failed),
    progress, error. The last event decides; progress restarts at 0 with every
    start; each start is an attempt.
    """
    order = F.struct("ts", "seq")
    status = (F.when(F.col("event") == "finished", "completed").when(F.col("event") == "failed", "failed")
              .otherwise("processing"))
    percent = (F.when(F.col("event") == "finished", F.lit(100)).when(F.col("event") == "started", F.lit(0))
               .when(F.col("event") == "progress", F.col("progress").cast("int")))
    shown = percent.isNotNull()
    return events.groupBy("page_id").agg(
        F.max_by(status, order).alias("status"),
        F.coalesce(F.max_by(percent, F.when(shown, order)), F.lit(0)).alias("progress"),
        F.max_by(F.when(F.col("event") == "failed", F.coalesce("error", F.lit("Unknown error"))), order).alias("error"),
        F.count_if(F.col("event") == "started").alias("attempts"))
