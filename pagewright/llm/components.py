"""Connected components of a links table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds


def _settled(ordered: DataFrame) -> bool:
    """True if every component is a star: a node hangs on one other node, and nothing hangs on it."""
    ends = ordered.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("x")).select("x.*")
    open_ = ends.groupBy("node").agg((F.sum("hangs") + F.max("holds")).alias("n")).where("n > 1")
    return not open_.agg(F.count("*")).first()[0]


def components(links: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node, component): the least node each node of `links` (u, v) can reach.

    Alternates two steps until all components are stars: hang the larger
    neighbours of every node on its least neighbour, then the smaller ones. Both
    keep the components and turn each of them into a star around its least node;
    the number of rounds grows with the logarithm of the number of nodes. Self
    links and links with a null end say nothing. No links: no rows.

    Minima are combined before the shuffle; the joins back meet one row per node
    on one side, so Spark may split a node with very many links. The result reads
    a table of `rounds`, which the next call with the same `rounds` replaces.
    """
    rounds = rounds or Rounds(links.sparkSession)
    with rounds.freed():
        ordered = rounds.keep("ordered", links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
                              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        while not _settled(ordered):
            # Neighbours below a node are all in its own links, so these alone have its least neighbour.
            least = ordered.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
            large = ordered.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
            small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
            ordered = rounds.keep("ordered", small.select(F.explode(F.array(
                F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                .select("x.u", "x.v").where("u != v").distinct())
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(ordered.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
