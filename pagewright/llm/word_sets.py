"""Near-duplicates by the sets of five-word shingles: documents whose Jaccard similarity is 0.8 or more link.

Candidates come from SimHash fingerprints through the binary trie of
`simhash_trie` first, and every link is confirmed on the whole sets. Its two bits
reach nearly equal texts only (at 0.8 about ten of 64 bits differ), so what it
leaves apart is looked up in MinHash bands. Two sets of similarity s meet in a
band with probability s^6, so at 0.8 one of the 40 bands misses with 0.738 and
all of them with 5 in a million; more similar pairs are missed less often.

Only components are asked for, so pairs that are linked already need no test. A
large group is first linked by its members' tests against one member of each
band, in rounds, as long as a round halves what is open. Nodes that still share
a band with another component are then joined on their rarest shingles, which
finds every similar pair of them and leaves alone the members of a group that
have much in common and yet are not similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, slices, utf8
from .components import components
from .simhash_trie import fingerprint, near_pairs

SEED = 42
WORDS = 5
BANDS, ROWS = 40, 6
FEW = 4  # open pairs per document from which the rarest shingles decide without more rounds
SHARE = 500  # pairs with one node that read the same copy of its set
SHINGLES_AT_ONCE = 1 << 10  # shingles whose minima are taken at once

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles. Fewer than five words are one shingle; no words, none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(WORDS, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())], np.uint64, len(last)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, made of the band's number and its minima."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        np.minimum(least, (hashes[at:at + SHINGLES_AT_ONCE] * _A + _B).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _node(text: bytes) -> int:
    """Texts of the same words in the same order are one node."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands, fp), one row per document row."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = utf8(batch.column("text"))
            nodes = np.array([_node(x) for x in texts], np.uint64).view(np.int64)
            bands = pa.array([band_keys(shingles(x)) for x in texts], pa.list_(pa.int64()))
            fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes), bands, pa.array(fps)], ["doc_id", "node", "bands", "fp"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, node long, bands array<long>, fp long")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words): the whole shingle sets of `nodes`."""

    def named(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in texts], np.uint64).view(np.int64)), pa.array(texts, pa.binary())], ["node", "bytes"])

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            words = pa.array([shingles(x).view(np.int64) for x in batch.column("bytes").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), words], ["node", "words"])

    texts = docs.select("text").mapInArrow(named, "node long, bytes binary").join(nodes, "node", "left_semi")
    return texts.groupBy("node").agg(F.first("bytes").alias("bytes")).mapInArrow(cut, "node long, words array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets have a similarity of 0.8 or more: 9 common >= 4 (both sizes).

    A node that many pairs end at, such as the head of a large band, gets one
    copy of its set per SHARE pairs, so its pairs spread over as many keys.
    """
    first, second = (sets.select(F.col("node").alias(k), F.col("words").alias(f"_{k}")) for k in ("u", "v"))
    copies = pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("_copies"))
    second = second.join(copies, "v").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    dealt = pairs.join(copies, "v").withColumn("_copy", F.pmod(F.xxhash64("u"), F.col("_copies").cast("long")).cast("int"))
    a, b = F.size("_u"), F.size("_v")
    close = F.when(5 * F.least(a, b) >= 4 * F.greatest(a, b), 9 * F.size(F.array_intersect("_u", "_v")) >= 4 * (a + b)).otherwise(False)
    return dealt.join(first, "u").join(second.drop("_copies"), ["v", "_copy"]).where(close).select("u", "v")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """Pairs (u, v) of nodes (node, c) of different parts c that may be similar by their rarest shingles; no similar pair is lost.

    Sets are ordered by how many of the nodes have a shingle, rarest first. Of
    two sets of similarity 0.8 or more, the smaller one (n shingles, equal sizes
    by node) has one of its first n - ceil(8n/9) + 1 shingles among the first
    m - ceil(4m/5) + 1 of the other; behind the first shingle in common enough
    must be left for the whole overlap. Members of a group that have more than a
    ninth of their shingles to themselves therefore meet nobody. Buckets of a
    shingle are joined part by part, so members of one part never meet either.
    """
    words = sets.join(nodes, "node").select("node", "c", F.size("words").alias("n"), F.explode("words").alias("w"))
    common = words.groupBy("w").agg(F.count("*").alias("f"))
    ordered = words.join(common, "w").groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("x"))
    short, long_ = F.col("n") - F.floor((8 * F.col("n") + 8) / 9) + 1, F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1
    rare = (rounds or Rounds(nodes.sparkSession)).keep("rare", ordered.select("node", "c", "n", short.alias("_short"), F.posexplode(F.slice("x", F.lit(1), long_.cast("int"))).alias("at", "x")) \
        .where("x.f > 1").select("node", "c", "n", "at", (F.col("at") < F.col("_short")).alias("first"), F.col("x.w").alias("w")))
    parts = rare.groupBy("w", "c").agg(F.max("first").alias("first"))
    met = parts.where("first").select("w", "c").join(parts.select("w", F.col("c").alias("_c")), "w").where("c != _c")
    small = rare.where("first").drop("first")
    large = rare.select("w", *[F.col(x).alias(f"_{x}") for x in ("c", "node", "n", "at")])
    left = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    smaller = (F.col("n") < F.col("_n")) | (F.col("n") == F.col("_n")) & (F.col("node") < F.col("_node"))
    return met.join(small, ["w", "c"]).join(large, ["w", "_c"]).where(
        smaller & (5 * F.col("n") >= 4 * F.col("_n")) & (9 * left >= 4 * (F.col("n") + F.col("_n")))).select(*_pair("node", "_node"))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _trie_pairs(classes: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints are equal or linked by the trie of `simhash_trie`.

    The nodes of one fingerprint are paired with the least of them, and a fingerprint with the least one it is linked
    to, so a dense group gives no more pairs than it has nodes. Members that this leaves apart share their bands.
    """
    heads = (rounds or Rounds(classes.sparkSession)).keep("heads", classes.groupBy("fp").agg(F.min("node").alias("head")))
    same = classes.select("node", "fp").join(heads, "fp").where("node != head").select(*_pair("node", "head"))
    links = near_pairs(heads.select("fp"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    first, second = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"_{k}")) for k in ("a", "b"))
    return same.unionByName(least.join(first, "a").join(second, "b").select(*_pair("_a", "_b"))).distinct()


def _component_links(shared: DataFrame, sets: DataFrame, few: float, links: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, component) of the nodes with a link; `shared` has (key, node) of the bands with several nodes, `links` what is linked already."""
    named, before, round_ = rounds.keep("named", components(links, rounds)), None, 0
    while True:
        now = shared.join(named, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        by_part = now.groupBy("key", "c").agg(F.count("*").cast("double").alias("m"))
        bands = by_part.groupBy("key").agg(F.count("*").alias("_parts"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("_open"))
        bands = rounds.keep("bands", bands.where("_parts > 1").select("key", "_open"))
        left = bands.agg(F.coalesce(F.sum("_open"), F.lit(0.0))).first()[0]  # pairs of different components in one band
        if not left:
            break
        now = rounds.keep("now", now.join(bands.select("key"), "key"))
        last = left <= few or before is not None and left > before / 2
        if last:  # what is left, by its rarest shingles
            pairs = _prefix_pairs(now.select("node", "c").distinct(), sets, rounds)
        else:  # all members against one; the same order in all bands makes few different pairs
            heads = now.groupBy("key").agg(F.min_by(F.struct("node", "c"), F.xxhash64("node", F.lit(round_))).alias("h"))
            heads = heads.select("key", F.col("h.node").alias("v"), F.col("h.c").alias("_c"))
            pairs = now.join(heads, "key").where("c != _c").select(F.col("node").alias("u"), "v")
        new = rounds.keep("new", _confirmed(rounds.keep("pairs", pairs.distinct()), sets))
        links = rounds.keep("links", links.unionByName(new))
        named = rounds.keep("named", components(links, rounds))
        if last:
            break
        before, round_ = left, round_ + 1
    return named


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id), one row per document row.

    Null texts count as empty; texts without words link to each other only. Ids
    that repeat or are null are treated as in `simhash_trie.near_duplicates`.
    """
    rounds = Rounds(docs.sparkSession)
    with rounds.freed():
        rows = _keyed(docs).checkpoint()  # texts are read and hashed once
        classes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).checkpoint()
        buckets = classes.select("node", F.explode("bands").alias("key"))
        several = buckets.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
        shared = buckets.join(several, "key").select("key", "node").checkpoint()
        close = rounds.keep("close", _trie_pairs(classes, rounds))
        met = shared.select("node").unionByName(close.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
        sets = _sets(docs, met).checkpoint()
        links = rounds.keep("links", _confirmed(close, sets))
        linked = _component_links(shared, sets, FEW * classes.count(), links, rounds).withColumnRenamed("component", "part")
        rounds.drop("heads", "close", "bands", "now", "rare", "pairs", "new", "links", "ordered")
    linked = linked.join(classes.select("node", "rep"), "node")
    least = linked.groupBy("part").agg(F.min("rep").alias("least"))
    names = linked.join(least, "part").select("node", "least")
    labels = classes.join(names, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    return rows.select("doc_id", "node").join(labels, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the least id, and one row of that id. Rows without an id are kept."""
    kept = near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
