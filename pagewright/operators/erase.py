"""Erase plan of a page: flat fills for bubbles, an inpaint mask for the rest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geometry as G
from . import raster as R
from .blocks import visible_for
from .overlap import overlap_groups
from .routing import erase_route

KEYS = ["page_id", "ordinal"]
COMPONENT_TILE = 256  # side of the tiles in which pixels find the component over them


@dataclass(frozen=True)
class ErasePlan:
    pixels: DataFrame  # page_id, x, y, b, g, r after the flat fills
    mask: DataFrame  # page_id, x, y of the pixels left to an inpainter
    routes: DataFrame  # page_id, ordinal, erase_route


def rects(blocks: DataFrame) -> DataFrame:
    """Whole-pixel rectangles with area, and the dilation radii of the page."""
    box = G.rect_int({c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}, F.col("width"), F.col("height"))
    radii = G.radii(F.col("width"), F.col("height"))
    out = blocks.select("page_id", "ordinal", F.coalesce("type", F.lit("bubble")).alias("type"),
                        *[v.alias(k) for k, v in box.items()], *[v.alias(k) for k, v in radii.items()])
    return out.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def erase_steps(pixels: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled pixels, mask, routes) for rectangles that do not overlap.

    Filled pixels holds only the positions that change.
    """
    crops = R.crop_pixels(pixels, areas)
    sizes = areas.select("page_id", "ordinal", "type", (F.col("x1") - F.col("x0")).alias("cw"),
                         (F.col("y1") - F.col("y0")).alias("ch"), "x0", "y0", "bubble_radius", "sfx_radius")
    sized = crops.join(sizes.select(*KEYS, "cw", "ch"), KEYS)
    bg = R.background(sized, KEYS)
    routed = erase_route(sizes.join(bg, KEYS)).withColumn(
        "radius", F.when(F.col("erase_route") == "flat", F.col("bubble_radius")).otherwise(F.col("sfx_radius")))
    grown = R.dilate(R.text_mask(crops, bg, KEYS), routed, KEYS)
    placed = grown.join(routed, KEYS).select(
        *KEYS, (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "erase_route",
        *[F.col(f"bg_{c}").alias(c) for c in R.CHANNELS])
    filled = placed.where(F.col("erase_route") == "flat").select("page_id", "x", "y", *R.CHANNELS)
    mask = placed.where(F.col("erase_route") == "inpaint").select("page_id", "x", "y").distinct()
    return filled, mask, routed.select(*KEYS, "erase_route")


def apply_fill(pixels: DataFrame, filled: DataFrame) -> DataFrame:
    place = ["page_id", "x", "y"]
    new = filled.select(*place, *[F.col(c).alias(f"_{c}") for c in R.CHANNELS])
    joined = pixels.join(new, place, "left")
    return joined.select(*place, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in R.CHANNELS])


def erase_order(areas: DataFrame) -> DataFrame:
    """Adds `bound` (the rectangle overlaps another one of its page), `component` and `step`.

    A component holds the rectangles that overlap directly or through others;
    it is null where nothing overlaps. Steps count its rectangles from 0 by
    ordinal, so blocks of equal step do not overlap and of two that do the later
    one has the later step.
    """
    groups = overlap_groups(areas)
    order = Window.partitionBy("page_id", "component").orderBy("ordinal")
    placed = groups.withColumn("step", F.row_number().over(order) - 1).withColumn("bound", F.lit(True))
    return areas.join(placed, KEYS, "left").withColumns({"bound": F.coalesce("bound", F.lit(False)), "step": F.coalesce("step", F.lit(0))})


def _pixels_of_components(pixels: DataFrame, bound: DataFrame, tile: int = COMPONENT_TILE) -> DataFrame:
    """(page_id, component, x, y, channels): every pixel under a bound rectangle once, however many lie over it.

    A pixel belongs to one component at most, as two that share a pixel are one.
    A tile paints the components of its rectangles and looks its pixels up.
    """
    def tiles(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.col(low) / tile), F.floor((F.col(high) - 1) / tile)))

    place = ["page_id", "_tx", "_ty"]
    cut = bound.withColumn("_tx", tiles("x0", "x1")).withColumn("_ty", tiles("y0", "y1"))
    listed = cut.select(*place, "component", *[F.least(F.greatest(F.col(c) - F.col(t) * tile, F.lit(0)), F.lit(tile)).cast("int").alias(c)
                                               for c, t in (("x0", "_tx"), ("x1", "_tx"), ("y0", "_ty"), ("y1", "_ty"))]).distinct()
    tiled = pixels.select("page_id", "x", "y", *R.CHANNELS, F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty"))
    under = tiled.join(listed.select(*place).distinct(), place, "left_semi")

    def label(own: pa.Table, rects: pa.Table) -> pa.Table:
        painted = np.full((tile, tile), -1, np.int64)
        names = rects.column("component").combine_chunks()
        for k, (x0, y0, x1, y1) in enumerate(zip(*(rects.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")))):
            painted[y0:y1, x0:x1] = k
        k = painted[own.column("y").to_numpy() % tile, own.column("x").to_numpy() % tile]
        hit = pa.array(np.flatnonzero(k >= 0))
        kept = own.take(hit)
        return pa.table([kept.column("page_id"), names.take(pa.array(k[k >= 0])), *(kept.column(c) for c in ("x", "y", *R.CHANNELS))],
                        names=["page_id", "component", "x", "y", *R.CHANNELS])

    kinds = {f.name: f.dataType.simpleString() for f in bound.schema}
    schema = f"page_id {kinds['page_id']}, component {kinds['component']}, " + ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in ("x", "y", *R.CHANNELS))
    return under.groupBy(*place).cogroup(listed.groupBy(*place)).applyInArrow(label, schema)


def _grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask grown by a square of (2 radius + 1) inside the crop: sliding counts along both axes."""
    for _ in range(2):
        n = len(mask)
        upto = np.concatenate([np.zeros((1, mask.shape[1]), np.int64), np.cumsum(mask, axis=0)])
        at = np.arange(n)
        mask = (upto[np.minimum(at + radius + 1, n)] > upto[np.maximum(at - radius, 0)]).T
    return mask


def _erase_in_order(image: np.ndarray, there: np.ndarray, rects: list[dict]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """(positions filled, positions left to an inpainter, routes) of rectangles that act one after another on one buffer.

    `image` changes in place; `there` says which positions have a pixel. Same rules as `erase_steps`.
    """
    filled, mask, routes = np.zeros(there.shape, bool), np.zeros(there.shape, bool), []
    for rect in rects:
        here = np.s_[rect["y0"]:rect["y1"], rect["x0"]:rect["x1"]]
        crop, known = image[here], there[here]
        h = len(crop)
        sides = [crop[0][known[0]], crop[h - 1][known[h - 1]]]
        if h > 2:
            sides += [crop[1:h - 1, k][known[1:h - 1, k]] for k in (0, crop.shape[1] - 1)]
        edge = np.concatenate(sides)
        if not len(edge):
            continue
        b, g, r = (int(v) for v in np.floor(np.median(edge, axis=0)))
        luma = 0.299 * edge[:, 2] + 0.587 * edge[:, 1] + 0.114 * edge[:, 0]
        grey = (crop[..., 2] * 9798 + crop[..., 1] * 19235 + crop[..., 0] * 3735 + 16384) >> 15
        text = known & (abs(grey - int(0.299 * r + 0.587 * g + 0.114 * b)) > R.TEXT_DIFF)
        if rect["type"] == "bubble" and np.std(luma) < R.UNIFORM_STD:
            grown = _grown(text, rect["bubble_radius"]) & known
            crop[grown] = (b, g, r)
            filled[here] |= grown
            routes.append((rect["ordinal"], "flat"))
        else:
            mask[here] |= _grown(text, rect["sfx_radius"])
            routes.append((rect["ordinal"], "inpaint"))
    return filled, mask, routes


def erase_components(pixels: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled pixels, mask, routes) of rectangles that overlap, each component worked off whole by ordinal.

    A group holds the pixels under one component, each once, and its
    rectangles: at most one page's raster, which one task has decoded before.
    The plan does not depend on how many rectangles wait for each other. A
    rectangle without any pixel on its border has no route.
    """
    under = _pixels_of_components(pixels, bound)
    group = ["page_id", "component"]

    def erase(own: pa.Table, rects: pa.Table) -> pa.Table:
        rects = rects.sort_by("ordinal")
        keys = [rects.column(c).combine_chunks()[:1] for c in group]
        # The group lies inside the box of its rectangles; places count from its corner.
        left, top = (min(rects.column(c).to_pylist(), default=0) for c in ("x0", "y0"))
        boxes = [{**r, "x0": r["x0"] - left, "x1": r["x1"] - left, "y0": r["y0"] - top, "y1": r["y1"] - top} for r in rects.drop_columns(group).to_pylist()]
        shape = max(r["y1"] for r in boxes), max(r["x1"] for r in boxes)
        image, there = np.zeros((*shape, 3), np.int32), np.zeros(shape, bool)
        x, y = (own.column(c).to_numpy() - low for c, low in (("x", left), ("y", top)))
        image[y, x] = np.stack([own.column(c).to_numpy() for c in R.CHANNELS], 1)
        there[y, x] = True
        filled, mask, routes = _erase_in_order(image, there, boxes)
        rows: list[pa.Table] = []
        for kind, (ys, xs) in (("fill", np.nonzero(filled)), ("mask", np.nonzero(mask))):
            colours = image[ys, xs]
            rows.append(_rows(keys[0], kind, xs + left, ys + top, *colours.T))
        nothing = np.zeros(len(routes), np.int64)
        rows.append(_rows(keys[0], "route", nothing, nothing, nothing, nothing, nothing, [o for o, _ in routes], [w for _, w in routes]))
        return pa.concat_tables(rows).cast(target)

    page = bound.schema["page_id"].dataType.simpleString()
    ordinal = bound.schema["ordinal"].dataType.simpleString()
    schema = f"page_id {page}, kind string, x int, y int, b int, g int, r int, ordinal {ordinal}, erase_route string"
    target = to_arrow_schema(StructType.fromDDL(schema))
    done = under.groupBy(*group).cogroup(bound.select(*group, "ordinal", "type", "x0", "y0", "x1", "y1", "bubble_radius", "sfx_radius").groupBy(*group)) \
        .applyInArrow(erase, schema).checkpoint()
    return (done.where("kind = 'fill'").select("page_id", "x", "y", *R.CHANNELS), done.where("kind = 'mask'").select("page_id", "x", "y"),
            done.where("kind = 'route'").select(*KEYS, "erase_route"))


def _rows(page: pa.Array, kind: str, x, y, b, g, r, ordinal=None, route=None) -> pa.Table:
    n = len(x)
    return pa.table({"page_id": page.take(pa.array(np.zeros(n, np.int64))), "kind": pa.array([kind] * n, pa.string()),
                     **{c: pa.array(v, pa.int32()) for c, v in zip("xybgr", (x, y, b, g, r))},
                     "ordinal": pa.array(ordinal if ordinal is not None else [None] * n, pa.int64()), "erase_route": pa.array(route if route is not None else [None] * n, pa.string())})


def erase_page(pixels: DataFrame, blocks: DataFrame, onomatopoeia_mode: str = "ignore",
               disjoint: bool = False) -> ErasePlan:
    """Erase the text of every page.

    Blocks act one after another, and an overlapping block sees earlier fills.
    Blocks that overlap no other are one set operation over all pages. The rest
    goes component by component (`erase_components`); the page pixels are read
    to crop either kind and joined once with all that changed.
    `disjoint=True` skips the ordering where overlap is ruled out.
    """
    areas = rects(visible_for(blocks, "erase", onomatopoeia_mode))
    if disjoint:
        filled, mask, routes = erase_steps(pixels, areas)
        return ErasePlan(apply_fill(pixels, filled), mask, routes)
    ordered = erase_order(areas).checkpoint()
    filled, mask, routes = erase_steps(pixels, ordered.where(~F.col("bound")).drop("bound", "step", "component"))
    bound = ordered.where("bound").drop("bound", "step")
    if bound.isEmpty():
        return ErasePlan(apply_fill(pixels, filled), mask, routes)
    changed, left, ways = erase_components(pixels, bound)
    return ErasePlan(apply_fill(pixels, filled.unionByName(changed)), R.union_masks(mask, left), routes.unionByName(ways))


def finish_inpaint(original: DataFrame, inpainted: DataFrame, mask: DataFrame, sizes: DataFrame,
                   feather_radius: int | str = "feather_radius") -> DataFrame:
    """Smooth the inpainted pixels and blend them in along the mask edge.

    `sizes`: page_id, cw, ch and each page's feather_radius; a number in its
    place holds for all pages. Only positions under the blurred mask are smoothed; no other is visible.
    """
    keys = ["page_id"]
    alpha = R.soft_mask(mask, sizes, keys, feather_radius)
    smooth = R.bilateral(inpainted.join(sizes.select("page_id", "cw", "ch"), keys), keys, at=alpha)
    return R.composite(original, smooth, alpha, keys)
