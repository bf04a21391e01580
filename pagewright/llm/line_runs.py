"""Repeated runs of lines by hashed blocks of lines. DataFrame functions only.

No suffix array and no longest-common-prefix intervals are built, and nothing is
sorted across documents: a sort would bring a common line into one task, while
grouped minima combine before the shuffle. What goes is the same.

Ids and doubling: a line's id is a 128-bit hash of its content. The hash of
the next 2, 4, 8 … lines at a position, its rank, is made of two of half that
length, one taken half as far behind (prefix doubling).

Depth: a run counts from `min_words` words on, and a line that counts has at
least one word, so no comparison needs more than `min_words` lines.

Blocks: places where the same shortest stretch with `min_words` words begins
have the same rank, a pair of overlapping doubling ranks, and are grouped by it.
The first in the order of documents stays; the blocks of the later ones
go. Stretches that end where a run ends are blocks too, so the union of what
goes is exactly the maximal repeated runs, whatever their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 8
WORD = r"[^\x20\x09-\x0D]+"
_OTHER_SEED = 7


def _id(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(_OTHER_SEED), x).alias("q"))


def _pair(a: Column, b: Column) -> Column:
    """Rank of two neighbouring blocks; null where the second does not exist."""
    return F.when(b.isNotNull(), F.struct(F.xxhash64(a["p"], b["p"]).alias("p"), F.xxhash64(a["q"], b["q"]).alias("q")))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, row, line, words, id): lines with a word, at their place in the text."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), _id(x).alias("id")))
    return (docs.where(F.col("text").isNotNull())
            .select("doc_id", F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("row"),
                    F.filter(lines, lambda u: u["words"] > 0).alias("_units"))
            .select("doc_id", "version", "row", F.explode("_units").alias("u"))
            .select("doc_id", "version", "row", "u.line", "u.words", "u.id"))


def ranked_prefixes(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, first_line, last_line, lines, p, q): the shortest blocks of `min_words` words
    that start at a line or end at one, with their rank. Works inside documents: one shuffle."""
    doc = Window.partitionBy("row").orderBy("line")
    df = (lines.withColumn("_to", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_from", F.col("_to") - F.col("words"))
          .withColumn("_all", F.sum("words").over(Window.partitionBy("row"))))
    df = df.withColumn("_r0", F.col("id"))
    level, half = 0, 1
    while 2 * half <= min_words:
        df = df.withColumn(f"_r{level + 1}", _pair(F.col(f"_r{level}"), F.lead(f"_r{level}", half).over(doc)))
        level, half = level + 1, 2 * half
    ahead = Window.partitionBy("row").orderBy("_from").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy("row").orderBy("_to").rangeBetween(-(min_words - 1), 0)
    df = (df.withColumn("_na", F.when(F.col("_all") - F.col("_from") >= min_words, F.count("*").over(ahead)))
          .withColumn("_la", F.max("line").over(ahead))
          .withColumn("_nb", F.when(F.col("_to") >= min_words, F.count("*").over(behind)))
          .withColumn("_lb", F.min("line").over(behind)))

    def rank(count: str, shift) -> Column:
        """Rank of `count` lines: the two longest doubling blocks that cover them. `shift(rank, first, lines)`."""
        cases = []
        for n in range(1, min_words + 1):
            k = n.bit_length() - 1
            left, right = shift(f"_r{k}", 0, n), shift(f"_r{k}", n - (1 << k), n)
            whole = left if n == 1 << k else _pair(left, right)
            cases.append((n, whole))
        return reduce(lambda made, case: made.when(F.col(count) == case[0], case[1]), cases[1:], F.when(F.col(count) == cases[0][0], cases[0][1]))

    df = df.withColumn("_ra", rank("_na", lambda name, first, n: F.lead(name, first).over(doc) if first else F.col(name)))
    df = df.withColumn("_rb", rank("_nb", lambda name, first, n: F.lag(name, n - 1 - first).over(doc) if n - 1 - first else F.col(name)))
    forward = F.struct(F.col("line").alias("first_line"), F.col("_la").alias("last_line"), F.col("_na").alias("lines"),
                       F.col("_ra.p").alias("p"), F.col("_ra.q").alias("q"))
    backward = F.struct(F.col("_lb").alias("first_line"), F.col("line").alias("last_line"), F.col("_nb").alias("lines"),
                        F.col("_rb.p").alias("p"), F.col("_rb.q").alias("q"))
    # A line that has enough words alone is both blocks at once.
    blocks = F.array_compact(F.array(F.when(F.col("_na").isNotNull(), forward),
                                     F.when(F.col("_nb").isNotNull() & (F.col("_nb") > 1), backward)))
    return df.select("doc_id", "version", F.explode(blocks).alias("b")).select("doc_id", "version", "b.*")


def later_copies(blocks: DataFrame) -> DataFrame:
    """(doc_id, version, lines to delete) from the intervals of equal ranks with more than one place."""
    here = F.struct("doc_id", "version", "first_line")
    # Minimum and count are combined before the shuffle, so a common line costs one row a task. The join
    # back has one row per interval on one side, and Spark splits the other side of a hot interval; it can
    # do so only if the small side is shuffled again, hence the key under another form.
    firsts = (blocks.groupBy("lines", "p", "q").agg(F.min(here).alias("kept"), F.count("*").alias("n")).where(F.col("n") > 1)
              .select(F.bitwise_not("lines").alias("_n"), F.bitwise_not("p").alias("_p"), F.bitwise_not("q").alias("_q"), "kept"))
    same = ((F.col("lines") == F.bitwise_not("_n")) & (F.col("p") == F.bitwise_not("_p")) & (F.col("q") == F.bitwise_not("_q")))
    later = blocks.join(firsts, same).where(here > F.col("kept"))
    return later.groupBy("doc_id", "version").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("first_line", "last_line")))).alias("gone"))


def delete_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs`, with `text` without later copies of repeated runs, and n_lines, n_removed.

    Documents are ordered by doc_id (null first), then by a hash of the text;
    the first copy of a run stays. Blank lines carry no words: they do not
    separate a run and always stay, unless every line with a word goes; then
    the row stays with an empty text. Null texts stay null with 0 lines, an
    empty text has 1 line and stays. Rows that repeat both id and text are one
    document and keep the same lines. Columns of `docs`
    named n_lines or n_removed are replaced. An empty table gives no rows.
    """
    gone = later_copies(ranked_prefixes(numbered_lines(docs.select("doc_id", "text")), min_words)) \
        .select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "gone")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "text")]
    # One struct for the row, so that no name of `docs` meets one of the columns below.
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_version"))
    joined = left.join(gone, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_version") == F.col("_version")), "left")
    line = lambda i: F.get(F.col("lines"), i)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).when(F.col("rest").rlike(WORD), F.col("rest")).otherwise("")
    return (joined.withColumn("lines", F.split("doc.text", "\n", -1))
            .withColumn("gone", F.filter("gone", lambda i: line(i).rlike(WORD)))  # blocks span blank lines
            .withColumn("rest", F.array_join(F.transform(kept, line), "\n"))
            .select(*[F.col("doc").getField(c).alias(c) for c in columns], text.alias("text"),
                    F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")))
