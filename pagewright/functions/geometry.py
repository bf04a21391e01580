"""Boxes in pixels and in percent of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import clamp

# Fixed values.
VERTICAL_RATIO = 1.15
MIN_FONT_PCT = 1.2
DEFAULT_FONT_PCT = 2.0


def poly_to_box(poly: Column) -> dict[str, Column]:
    """Axis-aligned bounds of an array of [x, y] corners."""
    xs = F.transform(poly, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(poly, lambda p: F.get(p, F.lit(1)))
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def to_pct(value: Column, dim: Column) -> Column:
    return value / F.nullif(dim, F.lit(0)) * 100


def is_vertical_box(w: Column, h: Column) -> Column:
    return h > w * VERTICAL_RATIO


def font_pct(w: Column, h: Column, page_h: Column) -> Column:
    """Short side of the glyph run as percent of the page height."""
    glyph = F.when(is_vertical_box(w, h), w).otherwise(h)
    return F.greatest(F.lit(MIN_FONT_PCT), to_pct(glyph, page_h))


def pct_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners to clamped percents."""
    return {
        "xmin": clamp(to_pct(x0, width), 0.0, 100.0),
        "ymin": clamp(to_pct(y0, height), 0.0, 100.0),
        "xmax": clamp(to_pct(x1, width), 0.0, 100.0),
        "ymax": clamp(to_pct(y1, height), 0.0, 100.0),
    }


def rect_float(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Percent box to exact pixels: x, y, w, h."""
    x0, y0 = box["xmin"] / 100 * width, box["ymin"] / 100 * height
    x1, y1 = box["xmax"] / 100 * width, box["ymax"] / 100 * height
    return {"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}


def rect_int(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Percent box to whole pixels inside the page: x0, y0, x1, y1 (ends excluded)."""

    def pixel(pct: Column, dim: Column, top: Column) -> Column:
        return F.greatest(F.lit(0), F.least((pct / 100.0 * dim).cast("int"), top.cast("int")))

    return {
        "x0": pixel(box["xmin"], width, width - 1),
        "y0": pixel(box["ymin"], height, height - 1),
        "x1": pixel(box["xmax"], width, width),
        "y1": pixel(box["ymax"], height, height),
    }


def font_px0(pct: Column, page_h: Column, scale: float) -> Column:
    """First font size in pixels, never below 8."""
    known = F.when(pct.isNull() | F.isnan(pct) | (pct == 0), F.lit(DEFAULT_FONT_PCT)).otherwise(pct)
    return F.greatest(F.lit(8.0), known * page_h / 100 * F.lit(float(scale)))


def radii(width: Column, height: Column) -> dict[str, Column]:
    """Dilation radius for bubbles and for sound effects, and feather radius."""
    side = F.greatest(width, height)

    def radius(share: float, least: int) -> Column:
        return F.greatest(F.lit(least), (side * share).cast("int"))

    return {"bubble_radius": radius(0.002, 1), "sfx_radius": radius(0.004, 2), "feather_radius": radius(0.003, 2)}


def move_box(box: dict[str, Column], dx: Column, dy: Column) -> dict[str, Column]:
    """Shift a percent box; it keeps its size and stays on the page."""

    def axis(low: Column, high: Column, delta: Column) -> tuple[Column, Column]:
        size = high - low
        new_low = F.when(low + delta < 0, F.lit(0.0)).otherwise(low + delta)
        new_high = F.when(low + delta < 0, size).otherwise(high + delta)
        return (F.when(new_high > 100, 100 - size).otherwise(new_low),
                F.when(new_high > 100, F.lit(100.0)).otherwise(new_high))

    xmin, xmax = axis(box["xmin"], box["xmax"], dx)
    ymin, ymax = axis(box["ymin"], box["ymax"], dy)
    return {"xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax}


def resize_box(box: dict[str, Column], dx: Column, dy: Column) -> dict[str, Column]:
    """Drag the lower right corner; at least 2 points remain, at most 100 is reached."""
    return {
        "xmin": box["xmin"],
        "ymin": box["ymin"],
        "xmax": F.least(F.lit(100.0), F.greatest(box["xmin"] + 2, box["xmax"] + dx)),
        "ymax": F.least(F.lit(100.0), F.greatest(box["ymin"] + 2, box["ymax"] + dy)),
    }
