"""Fitting text into boxes: line breaks, columns, shrink to fit.

Horizontal line breaks use a small glyph width model in em (`GLYPH_EM`), since
no browser font is at hand. All widths are multiples of 1/8, so sums are exact.
Vertical text has a fixed pitch and needs no widths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import BROWSER_SPACE

# (name, characters, em). The classes do not overlap.
GLYPH_EM = (
    ("narrow", "ijlI.,:;'!|()[] ", 0.25),
    ("broad", "mwMW@%", 0.875),
    ("capital", "ABCDEFGHJKLNOPQRSTUVXYZ", 0.625),
)
WIDE_CLASS = r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]"
WIDE_EM = 1.0
OTHER_EM = 0.5
SPACE_EM = 0.25

# Ratios to the font size, and least sizes.
LINE_PITCH = 1.2
COLUMN_PITCH = 1.1
PADDING = 0.4
EXPORT_MIN_PX = 7.0
VIEWER_MIN_PX = 6.0
# The state of a line break in one double: finished lines * LINE_UNIT + width of the open line. Widths are cut
# at half a unit, eight million em, which is past any line, so a longer token counts as wider than the line.
LINE_UNIT = 2.0 ** 24
WIDEST = LINE_UNIT / 2
# Tokens per inner list while lines are collected, so that long texts copy little.
TOKENS_PER_STEP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_em(text: Column) -> Column:
    """Width of a text in em."""
    n = F.length(text)
    total = n * OTHER_EM + (n - F.length(F.regexp_replace(text, WIDE_CLASS, ""))) * (WIDE_EM - OTHER_EM)
    for _, chars, em in GLYPH_EM:
        total = total + (n - F.length(F.translate(text, chars, ""))) * (em - OTHER_EM)
    return total


def token_widths(text: Column, per_char: Column) -> Column:
    return F.transform(tokens(text, per_char), lambda t: t["em"])


def tokens(text: Column, per_char: Column) -> Column:
    """Words with their width, or single characters where `per_char` holds."""
    parts = F.when(per_char, F.split(text, "")).otherwise(F.split(text, f"{BROWSER_SPACE}+"))
    return F.transform(parts, lambda t: F.struct(t.alias("t"), text_em(t).alias("em")))


def count_lines(widths: Column, gap_em: Column, font_px: Column, max_w: Column) -> Column:
    """Number of lines of a greedy break; a token wider than the line stays whole.

    `widths` are the token widths in em. The state is one number, finished
    lines * LINE_UNIT + width of the open line, which spares a struct per
    token. Widths are eighths of an em, so it is exact. A line of width 0 is
    empty.
    """

    def step(s: Column, width: Column) -> Column:
        token = F.least(width, F.lit(WIDEST))
        done = F.floor(s / LINE_UNIT)
        open_em = s - done * LINE_UNIT
        is_open = open_em > 0
        # A line in progress keeps a separator before its next token, also before an empty one.
        return (F.when(~is_open, s + token)
                .when((open_em + gap_em + token) * font_px > max_w, (done + 1) * LINE_UNIT + token)
                .otherwise(s + gap_em + token))

    return F.aggregate(widths, F.lit(0.0), step, lambda s: F.ceil(s / LINE_UNIT))


def wrap_text(toks: Column, gap: Column, gap_em: Column, font_px: Column, max_w: Column) -> Column:
    """The lines of a greedy break as an array of texts."""

    def step(s: Column, token: Column) -> Column:
        empty_line = F.length(s["cur"]) == 0
        new_line = F.struct(token["t"].alias("cur"), token["em"].alias("em"),
                            F.concat(s["lines"], F.array(s["cur"])).alias("lines"))
        same = F.struct(
            F.when(empty_line, token["t"]).otherwise(F.concat(s["cur"], gap, token["t"])).alias("cur"),
            F.when(empty_line, token["em"]).otherwise(s["em"] + gap_em + token["em"]).alias("em"),
            s["lines"].alias("lines"))
        overflows = ~empty_line & ((s["em"] + gap_em + token["em"]) * font_px > max_w)
        return F.when(overflows, new_line).otherwise(same)

    no_lines = F.array().cast("array<string>")
    starts = F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1)), F.lit(TOKENS_PER_STEP))
    chunks = F.transform(starts, lambda i: F.slice(toks, i, F.lit(TOKENS_PER_STEP)))

    def chunk_step(s: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(s["cur"].alias("cur"), s["em"].alias("em"), no_lines.alias("lines")), step)
        return let(inner, lambda t: F.struct(t["cur"].alias("cur"), t["em"].alias("em"),
                                             F.concat(s["lines"], t["lines"]).alias("lines")))

    start = F.struct(F.lit("").alias("cur"), F.lit(0.0).alias("em"), no_lines.alias("lines"))
    return F.aggregate(chunks, start, chunk_step, lambda s: F.when(
        F.length(s["cur"]) > 0, F.concat(s["lines"], F.array(s["cur"]))).otherwise(s["lines"]))


def glyphs_per_column(font_px: Column, max_h: Column) -> Column:
    """Largest k with k * pitch <= max_h, at least 1.

    The division alone can be one off, so the products decide.
    """
    pitch = font_px * COLUMN_PITCH
    k = F.floor(max_h / pitch)
    return F.greatest(F.lit(1), F.when((k + 1) * pitch <= max_h, k + 1).when(k * pitch > max_h, k - 1).otherwise(k))


def column_room(font_px: Column, box_h: Column) -> Column:
    return box_h - font_px * PADDING * 2


def fits_vertical(n_chars: Column, font_px: Column, box_w: Column, box_h: Column) -> Column:
    max_h = column_room(font_px, box_h)
    k = glyphs_per_column(font_px, max_h)
    n_cols = F.ceil(n_chars / k)
    tallest = F.least(n_chars, k) * font_px * COLUMN_PITCH
    return (n_cols * (font_px * COLUMN_PITCH) <= box_w - font_px * PADDING) & (tallest <= max_h)


def fits_horizontal(widths: Column, gap_em: Column, font_px: Column, box_w: Column, box_h: Column) -> Column:
    padding = font_px * PADDING
    n_lines = count_lines(widths, gap_em, font_px, box_w - padding * 2)
    return n_lines * (font_px * LINE_PITCH) <= box_h - padding * 1.5


def shrink_to_fit(fits: Callable[[Column], Column], first_px: Column, min_px: float) -> Column:
    """The first size if it fits, else ten halvings between `min_px` and it."""

    def step(s: Column, _: Column) -> Column:
        return let((s["lo"] + s["hi"]) / 2, lambda mid: F.when(
            fits(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"), mid.alias("best"))).otherwise(
            F.struct(s["lo"].alias("lo"), mid.alias("hi"), s["best"].alias("best"))))

    start = F.struct(F.lit(float(min_px)).alias("lo"), first_px.alias("hi"), F.lit(float(min_px)).alias("best"))
    search = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step, lambda s: s["best"])
    return F.when(fits(first_px), first_px).otherwise(search)
