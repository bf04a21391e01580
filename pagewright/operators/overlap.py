"""Groups of rectangles that overlap, directly or through others, page by page.

A page is cut into strips. In a strip a sweep over the left edges keeps, for
every height, the rectangle that reaches furthest right; a new rectangle meets
the stretches of this map that it covers and joins their groups. Rectangles
over one place form one group anyway, so one of them stands for all, and no
pair of rectangles is ever written out: a strip gives at most one row per
rectangle. Groups that reach over several strips are joined as graph components.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

STRIP = 1024  # height of the strips a page is swept in
SIDES = ["x0", "y0", "x1", "y1"]


def sweep(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Group of every rectangle, named by the least index in it; ends are excluded."""
    parent = list(range(len(x0)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # The map from heights to (right end, rectangle): stretches in order, without overlaps.
    starts: list[int] = []
    ends: list[int] = []
    rights: list[int] = []
    owners: list[int] = []
    for k in np.lexsort((y0, x0)).tolist():
        left, top, right, bottom = int(x0[k]), int(y0[k]), int(x1[k]), int(y1[k])
        first = last = bisect_right(ends, top)
        new: list[tuple[int, int, int, int]] = []

        def put(a: int, b: int, reach: int, owner: int) -> None:
            if a < b:
                if new and new[-1][1] == a and new[-1][2:] == (reach, owner):
                    a = new.pop()[0]
                new.append((a, b, reach, owner))

        at = top
        while last < len(starts) and starts[last] < bottom:
            a, b, reach, owner = starts[last], ends[last], rights[last], owners[last]
            last += 1
            alive = reach > left
            if alive:
                r, s = sorted((root(owner), root(k)))
                parent[s] = r
                put(a, top, reach, owner)
            low, high = max(a, top), min(b, bottom)
            put(at, low, right, k)
            put(low, high, *((reach, owner) if alive and reach > right else (right, k)))
            at = high
            if alive and b > bottom:
                put(at, bottom, right, k)
                at = bottom
                put(bottom, b, reach, owner)
        put(at, bottom, right, k)
        new.sort()
        starts[first:last] = [n[0] for n in new]
        ends[first:last] = [n[1] for n in new]
        rights[first:last] = [n[2] for n in new]
        owners[first:last] = [n[3] for n in new]
    return np.array([root(i) for i in range(len(parent))], np.int64)


def _strip_links(shapes: DataFrame, strip: int) -> DataFrame:
    """(page_id, u, v): every shape with the least shape of its group in a strip, groups of several shapes only."""
    low, high = F.floor(F.col("y0") / strip), F.floor((F.col("y1") - 1) / strip)
    cut = shapes.withColumn("_s", F.explode(F.sequence(low, high))).select(
        "page_id", "shape", "x0", "x1", F.greatest("y0", F.col("_s") * strip).alias("y0"), F.least("y1", (F.col("_s") + 1) * strip).alias("y1"), "_s")

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("shape")
        of = sweep(*(table.column(c).to_numpy() for c in SIDES))
        inner = np.flatnonzero(of != np.arange(len(of)))
        names = table.column("shape").combine_chunks()
        return pa.table({"page_id": table.column("page_id").combine_chunks().take(pa.array(inner)), "u": names.take(pa.array(inner)), "v": names.take(pa.array(of[inner]))})

    kinds = {c: shapes.schema[c].dataType.simpleString() for c in ("page_id", "shape")}
    return cut.groupBy("page_id", "_s").applyInArrow(group, f"page_id {kinds['page_id']}, u {kinds['shape']}, v {kinds['shape']}")


def page_components(links: DataFrame) -> DataFrame:
    """(page_id, node, component) of the links (page_id, u, v), component being the least node.

    Every node hands the least node it knows to its larger neighbours and takes
    itself one step nearer to it, in turns, until each group is a star; the
    rounds grow with the logarithm of the strips a group reaches over.
    """
    links = links.select("page_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct().checkpoint()
    before = None
    while True:
        seen = links.unionByName(links.select("page_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("page_id", "u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
        down = seen.join(least, ["page_id", "u"]).where("v > u").select("page_id", F.col("v").alias("u"), F.col("_m").alias("v")).where("u != v").distinct()
        least = down.groupBy("page_id", "u").agg(F.min("v").alias("_m"))
        up = down.join(least, ["page_id", "u"])
        both = F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v"))))
        links = up.select("page_id", both.alias("_l")).select("page_id", "_l.u", "_l.v").where("u != v").distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("page_id", "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            named = links.select("page_id", F.col("u").alias("node"), F.col("v").alias("component"))
            return named.unionByName(links.select("page_id", F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now


def overlap_groups(areas: DataFrame, strip: int = STRIP) -> DataFrame:
    """(page_id, ordinal, component) of the rectangles that overlap another one of their page.

    `areas`: page_id, ordinal and x0, y0, x1, y1, ends excluded. `component` is
    the least ordinal of the group. Equal rectangles count as one shape in the
    sweep, so a strip holds different shapes only.
    """
    ensure_checkpoint_dir(areas.sparkSession)
    shapes = areas.groupBy("page_id", *SIDES).agg(F.min("ordinal").alias("shape"), F.count("*").alias("_n"))
    linked = page_components(_strip_links(shapes, strip)).withColumnRenamed("node", "shape")
    grouped = shapes.join(linked, ["page_id", "shape"], "left").where((F.col("_n") > 1) | F.col("component").isNotNull())
    return areas.select("page_id", "ordinal", *SIDES).join(
        grouped.select("page_id", *SIDES, F.coalesce("component", "shape").alias("component")), ["page_id", *SIDES]).select("page_id", "ordinal", "component")
