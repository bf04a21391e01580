"""Layout of translated text inside blocks: direction, size, lines, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import breaks as BR
from ..functions import text as TX
from ..functions.semantics import has_cjk
from ..schema import StyleConfig
from .blocks import visible_for

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_rect(blocks: DataFrame) -> DataFrame:
    """Adds x, y, w, h in pixels and drops boxes without area."""
    rect = G.rect_float({c: F.col(c) for c in BOX}, F.col("width"), F.col("height"))
    return blocks.withColumns(rect).where((F.col("w") > 0) & (F.col("h") > 0))


def with_direction(blocks: DataFrame) -> DataFrame:
    """Adds is_cjk and layout_dir. Vertical takes CJK text in a box that is tall in pixels."""
    out = blocks.withColumn("is_cjk", has_cjk(F.col("translated_text")))
    tall = G.is_vertical_box(F.col("w"), F.col("h"))
    return out.withColumn("layout_dir", F.when(F.col("is_cjk") & tall, F.lit("vertical")).otherwise(F.lit("horizontal")))


def overlay_direction(blocks: DataFrame) -> Column:
    """The on-screen flag, which compares percents instead of pixels."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return has_cjk(F.col("translated_text")) & G.is_vertical_box(w, h)


def resolve_style(blocks: DataFrame, style: StyleConfig) -> DataFrame:
    """Adds fill, cover and stroke settings. The style is one record, so it enters as literals."""
    text = F.col("text_color") if style.text_color_mode == "original" else F.lit(style.custom_text_color)
    cover = {"original": F.col("bg_color"), "custom": F.lit(style.custom_bg_color)}.get(
        style.bg_color_mode, F.lit(None).cast("string"))
    return blocks.withColumns({
        "fill_color": text,
        "cover_color": cover,
        "cover_alpha": F.when(cover.isNotNull(), F.lit(style.bg_opacity / 100)),
        "stroke": F.lit(style.stroke_color or "#000000") if style.text_stroke else F.lit(None).cast("string"),
        "stroke_px": F.lit(int(style.stroke_width or 2)) if style.text_stroke else F.lit(None).cast("int"),
    })


def cover_rects(blocks: DataFrame, style: StyleConfig, erased: bool = False,
                cover_erased: bool = False) -> DataFrame:
    """Rectangles to paint under the text: x, y, w, h, cover_color, cover_alpha.

    On an erased background nothing is painted unless `cover_erased` is set or
    the style asks for its own colour.
    """
    rects = resolve_style(with_rect(visible_for(blocks, "cover", style.onomatopoeia_mode)), style)
    if erased and not cover_erased and style.bg_color_mode != "custom":
        return rects.where(F.lit(False))
    return rects.where(F.col("cover_color").isNotNull())


def fit_font(blocks: DataFrame, style: StyleConfig, min_px: float = TX.EXPORT_MIN_PX) -> DataFrame:
    """Adds font_px for every block that carries text, with x, y, w, h and layout_dir."""
    shown = with_direction(with_rect(visible_for(blocks, "text", style.onomatopoeia_mode)))
    # The explode holds the direction as a value. A filter on it would else repeat box and text in the join of
    # blocks and pages, in a method too long for the JVM to compile (8000 bytes), which is then interpreted.
    held = F.explode_outer(F.array(F.struct("is_cjk", "layout_dir")))
    shown = shown.select(*[c for c in shown.columns if c not in ("is_cjk", "layout_dir")], held.alias("_held")).select("*", "_held.*").drop("_held")
    first = G.font_px0(F.col("font_size_pct"), F.col("height"), style.font_size_scale)
    shown = shown.withColumn("font_px0", first)
    if not style.auto_fit_font_size:
        return shown.withColumn("font_px", F.col("font_px0"))
    fitted = BR.largest_font(F.col("translated_text"), F.col("is_cjk"), F.col("font_px0"), min_px, F.col("w"), F.col("h"), F.col("layout_dir") == "vertical")
    # A block without a text takes the least size.
    return shown.withColumn("font_px", F.coalesce(fitted, F.lit(float(min_px))))


def wrap_lines(blocks: DataFrame, text: str, font_px: Column, max_w: Column, out: str = "lines", is_cjk: Column | None = None) -> DataFrame:
    """Adds the lines of `text` as an array. `is_cjk` spares the look at the text where it is known."""
    return blocks.withColumn(out, BR.broken_lines(F.col(text), has_cjk(F.col(text)) if is_cjk is None else is_cjk, font_px, max_w))


def place_vertical(fitted: DataFrame) -> DataFrame:
    """One row per glyph of vertical blocks: column (from the right), glyph, x and y of its centre."""
    fs = F.col("font_px")
    tall = fitted.where(F.col("layout_dir") == "vertical").withColumns({
        "_n": F.length("translated_text"),
        "_k": TX.glyphs_per_column(fs, TX.column_room(fs, F.col("h")))})
    keys = ["page_id", "ordinal", "x", "y", "w", "h", "font_px", "_n", "_k"]
    glyphs = tall.select(*keys, F.posexplode_outer(F.split("translated_text", "")).alias("_pos", "glyph"))
    line = F.floor(F.col("_pos") / F.col("_k"))
    spot = F.col("_pos") - line * F.col("_k")
    column_w = fs * TX.COLUMN_PITCH
    n_cols = F.ceil(F.col("_n") / F.col("_k"))
    in_column = F.least(F.col("_k"), F.col("_n") - line * F.col("_k"))
    first_x = F.col("x") + F.col("w") / 2 + n_cols * column_w / 2 - column_w / 2
    first_y = F.col("y") + F.col("h") / 2 - in_column * fs * TX.COLUMN_PITCH / 2 + fs * TX.COLUMN_PITCH / 2
    return glyphs.select(
        "page_id", "ordinal", line.cast("int").alias("line"), spot.cast("int").alias("spot"), "glyph", "font_px",
        (first_x - line * column_w).alias("glyph_x"), (first_y + spot * fs * TX.COLUMN_PITCH).alias("glyph_y"))


def place_horizontal(fitted: DataFrame) -> DataFrame:
    """One row per line of horizontal blocks: centre x and y. Lines past the bottom padding are left out."""
    fs = F.col("font_px")
    # The explode keeps the font search and the line breaks in separate steps of the plan, so the search runs once.
    held = fitted.where(F.col("layout_dir") == "horizontal").withColumn("_px", F.explode_outer(F.array("font_px"))).drop("font_px").withColumnRenamed("_px", "font_px")
    flat = wrap_lines(held, "translated_text", fs,
                      F.col("w") - fs * TX.PADDING * 2, is_cjk=F.col("is_cjk"))
    # The outer explode and the coalesce below keep the optimizer from deriving "lines / font_px is not
    # null" filters under the fit, which would repeat the whole fit inside the filter.
    rows = flat.withColumn("_n", F.size("lines")).select(
        "page_id", "ordinal", "x", "y", "w", "h", "font_px", "_n", F.posexplode_outer("lines").alias("line", "line_text"))
    pitch = fs * TX.LINE_PITCH
    first_y = F.col("y") + F.col("h") / 2 - F.col("_n") * pitch / 2 + pitch / 2
    placed = rows.select("page_id", "ordinal", "line", "line_text", "font_px",
                         (F.col("x") + F.col("w") / 2).alias("line_x"),
                         (first_y + F.col("line") * pitch).alias("line_y"),
                         (F.col("y") + F.col("h") - fs * TX.PADDING).alias("_bottom"))
    return placed.where(F.coalesce(F.col("line_y") <= F.col("_bottom"), F.lit(False))).drop("_bottom")
