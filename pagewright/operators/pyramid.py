"""Filling holes of a page from its surroundings: a pyramid of averages, built up and walked down.

Level k of the pyramid cuts the page into cells of 2^k by 2^k pixels; a cell
knows the sum and the number of its pixels outside the hole. Going up, only the
cells over a hole that still know nothing are followed, so the number of levels
is the logarithm of the widest hole, not of the page. Going down, such a cell
takes the weighted mean of the four nearest cells of the level above, which
carries a gradient over the hole. Values are whole numbers of 1/65536, so the
result does not depend on the order of any sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CHANNELS = ("b", "g", "r")
UNIT = 65536
NEAR, FAR = 3, 1  # weights of the cell above and of its next neighbour, along each axis
WHITE = 255
TOP = 31  # coordinates are 32-bit: above this level a page is one cell


def _half(c: str) -> Column:
    return F.shiftright(c, 1).alias(c)


def _known_above(known: DataFrame) -> DataFrame:
    """Sums and counts of the next level; cells without a known pixel have no row."""
    return known.groupBy("page_id", _half("x"), _half("y")).agg(F.sum("n").alias("n"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in CHANNELS])


def _values(known: DataFrame) -> DataFrame:
    return known.select("page_id", "x", "y", *[F.expr(f"(s_{c} * {UNIT}) div n").alias(f"v_{c}") for c in CHANNELS])


def _from_above(missing: DataFrame, above: DataFrame) -> DataFrame:
    """Values of the missing cells; each reads the four nearest cells above that exist."""
    def axis(c: str) -> Column:
        own = F.shiftright(c, 1)
        beside = own + F.when(F.col(c) % 2 == 1, 1).otherwise(-1)
        return F.explode(F.array(F.struct(own.alias("at"), F.lit(NEAR).alias("w")), F.struct(beside.alias("at"), F.lit(FAR).alias("w"))))

    reads = missing.withColumn("_h", axis("x")).withColumn("_v", axis("y")).select(
        "page_id", "x", "y", F.col("_h.at").alias("_x"), F.col("_v.at").alias("_y"), (F.col("_h.w") * F.col("_v.w")).cast("long").alias("_w"))
    source = above.select("page_id", F.col("x").alias("_x"), F.col("y").alias("_y"), *[f"v_{c}" for c in CHANNELS])
    return reads.join(source, ["page_id", "_x", "_y"]).groupBy("page_id", "x", "y").agg(
        *[F.expr(f"sum(_w * v_{c}) div sum(_w)").alias(f"v_{c}") for c in CHANNELS])


def hole_values(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(page_id, x, y, b, g, r) of the masked pixels. A page that is all hole turns white.

    Pages without a mask are left out before anything is summed. The cells of
    every level that are used are checkpointed; they shrink by four from level
    to level, and one small job per level says whether a cell is still unknown.
    """
    ensure_checkpoint_dir(pixels.sparkSession)
    place = ["page_id", "x", "y"]
    unique = mask.select(*place).distinct()
    own = pixels.select(*place, *CHANNELS).join(unique.select("page_id").distinct(), "page_id", "left_semi")
    hole = own.select(*place).join(unique, place, "left_semi").checkpoint()
    outside = own.join(unique, place, "left_anti")
    known = outside.groupBy("page_id", _half("x"), _half("y")).agg(
        F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(f"s_{c}") for c in CHANNELS]).checkpoint()
    missing, levels, level = [hole], [], 1
    while True:
        levels.append(known)
        above = missing[-1].select("page_id", _half("x"), _half("y")).distinct().join(known, place, "left_anti").checkpoint()
        if level >= TOP or above.isEmpty():
            break
        missing.append(above)
        known, level = _known_above(known).checkpoint(), level + 1
    filled = None
    for cells, known in zip(reversed(missing), reversed(levels)):
        above = _values(known) if filled is None else _values(known).unionByName(filled)
        filled = _from_above(cells, above)
    tone = {c: F.coalesce(F.expr(f"(v_{c} + {UNIT // 2}) div {UNIT}"), F.lit(WHITE)).cast("int").alias(c) for c in CHANNELS}
    return hole.join(filled, place, "left").select(*place, *tone.values())


def fill_holes(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels (page_id, x, y, b, g, r) with masked positions filled from around; a position that the mask names twice counts once."""
    place = ["page_id", "x", "y"]
    fills = hole_values(pixels, mask).select(*place, *[F.col(c).alias(f"_{c}") for c in CHANNELS])
    return pixels.join(fills, place, "left").select(*place, *[F.coalesce(f"_{c}", c).cast("int").alias(c) for c in CHANNELS])
