"""Positions, neighbours and ordered lists that stay distributed when one group
holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Positions that share one window when a group is cut by position; affects tasks, not results.
PART_ROWS = 10_000
# Rows of a group that one task sorts and numbers; affects tasks, not results.
HEAVY_ROWS = 250_000


def row_numbers(df: DataFrame, group: list[str], order: list[str | Column], name: str, bound: DataFrame | None = None) -> DataFrame:
    """Exact row number from 1 inside each group, in `order`. A null group is a group.

    Groups of up to HEAVY_ROWS rows are numbered by a window, with one shuffle and nothing stored. The others
    are found by a count, which runs as a job, and take the range sort of `_sorted_numbers`. `bound` is a
    cheaper table to count: it has the columns of `group`, and no group of `df` has more rows there.
    """
    if not group:
        return _sorted_numbers(df, group, order, name)
    sizes = (df if bound is None else bound).groupBy(*group).agg(F.count("*").alias("_n"))
    heavy = sizes.where(F.col("_n") > HEAVY_ROWS).drop("_n")
    found = heavy.collect()  # one row per HEAVY_ROWS rows at most
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if not found:
        return df.withColumn(name, number).select(*df.columns, name)
    keys = F.broadcast(df.sparkSession.createDataFrame(found, heavy.schema).toDF(*[f"_g{i}" for i in range(len(group))]))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    light = df.join(keys, same, "left_anti").withColumn(name, number).select(*df.columns, name)
    return light.unionByName(_sorted_numbers(df.join(keys, same, "left_semi"), group, order, name))


def _sorted_numbers(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Row numbers of groups of any size.

    Rows are range-sorted over group and order together, so a group of any size
    spreads over many tasks; the sorted rows are checkpointed (an exact rank
    needs the sizes of the slices before, hence one job) and numbered by local
    position plus the sizes of the earlier slices.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # The id holds the slice number in its upper bits and the local position in
    # the lower 33. It must not change after it is read once: hence checkpoint.
    rows = (df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
            .withColumn("_id", F.monotonically_increasing_id()).checkpoint()
            .withColumn("_slice", F.shiftright("_id", 33))
            .withColumn("_local", F.col("_id").bitwiseAND((1 << 33) - 1)))
    # One number per slice, as many as the range sort has tasks.
    sizes = sorted((r["_slice"], r["_n"]) for r in rows.groupBy("_slice").agg(F.count("*").alias("_n")).collect())
    before = accumulate((n for _, n in sizes), initial=0)
    slices = df.sparkSession.createDataFrame([(s, b) for (s, _), b in zip(sizes, before)], "_slice long, _before long")
    placed = rows.join(F.broadcast(slices), "_slice").withColumn("_at", F.col("_before") + F.col("_local"))
    if not group:
        return placed.withColumn(name, F.col("_at") + 1).select(*df.columns, name)
    first = placed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min("_at").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    return placed.join(first, same).withColumn(name, F.col("_at") - F.col("_first") + 1).select(*df.columns, name)


def with_ordinal(df: DataFrame, group: list[str], order: list[str | Column], name: str = "ordinal", bound: DataFrame | None = None) -> DataFrame:
    """Position from 0 inside each group (array index)."""
    ranked = row_numbers(df, group, order, name, bound)
    return ranked.withColumn(name, (F.col(name) - 1).cast("int"))


def _edges_in_groups(edges: DataFrame, group: list[str]) -> DataFrame:
    over_parts = Window.partitionBy(*group).orderBy("_part")
    return edges.withColumn("_prev", F.lag("_hi.v").over(over_parts)).withColumn("_next", F.lead("_lo.v").over(over_parts))


def _edges_of_all(edges: DataFrame, group: list[str]) -> DataFrame:
    """Without a group all slices would meet in one window; they are numbered by a range sort and joined by number instead."""
    placed = row_numbers(edges, [], ["_part"], "_n")
    before = placed.select((F.col("_n") + 1).alias("_n"), F.col("_hi.v").alias("_prev"))
    after = placed.select((F.col("_n") - 1).alias("_n"), F.col("_lo.v").alias("_next"))
    return placed.join(before, "_n", "left").join(after, "_n", "left")


def neighbours(df: DataFrame, group: list[str], position: str, value: str, before: str, after: str,
               part_rows: int = PART_ROWS) -> DataFrame:
    """`value` of the previous and the next row of the group by whole `position`.

    Windows run over slices of `part_rows` positions. The row before and after
    a slice comes from a summary with one row per slice; slices may be missing.
    """
    cut = df.withColumn("_part", F.floor(F.col(position) / part_rows))
    keys = [*group, "_part"]
    edge = F.struct(position, F.col(value).alias("v"))
    edges = cut.groupBy(*keys).agg(F.min(edge).alias("_lo"), F.max(edge).alias("_hi"))
    edges = (_edges_in_groups if group else _edges_of_all)(edges, group).select(
        *[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], "_prev", "_next", F.col(f"_lo.{position}").alias("_first"), F.col(f"_hi.{position}").alias("_last"))
    inside = Window.partitionBy(*keys).orderBy(position)
    local = cut.withColumn(before, F.lag(value).over(inside)).withColumn(after, F.lead(value).over(inside))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)])
    joined = local.join(edges, same)  # null-safe: a group without a key is a group too
    return (joined
            .withColumn(before, F.when(F.col(position) == F.col("_first"), F.col("_prev")).otherwise(F.col(before)))
            .withColumn(after, F.when(F.col(position) == F.col("_last"), F.col("_next")).otherwise(F.col(after)))
            .select(*df.columns, before, after))


def batches(df: DataFrame, rank: str, size: int = 5, name: str = "batch_no") -> DataFrame:
    """Batches of `size` in the order of a rank that starts at 1."""
    return df.withColumn(name, F.floor((F.col(rank) - 1) / size))


def ordered_parts(df: DataFrame, group: list[str], ordinal: str, item: Column, name: str,
                  part_rows: int | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Ordered lists of `item` per group: (group, part, n_items, name) and the `extra` aggregates.

    A group is one list with part 0, as the document it stands for is one value. With `part_rows` the list
    is cut every so many ordinals; these are unique in a group, so no list is longer.
    """
    cut = df.withColumn("part", F.floor(F.col(ordinal) / part_rows).cast("int") if part_rows else F.lit(0))
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("_o"), item.alias("_v"))))
    return cut.groupBy(*group, "part").agg(
        F.count("*").alias("n_items"), F.transform(listed, lambda s: s["_v"]).alias(name), *extra)


def last_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row per key in `order`. Aggregates before the shuffle; no sort, no window."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
