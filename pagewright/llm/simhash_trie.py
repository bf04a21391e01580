"""Near-duplicates by SimHash; links found by a binary trie joined with itself.

Fingerprints are reduced to distinct values first, so copies cost one row. The
64 bits are cut into six blocks. Two fingerprints that differ in at most two
bits agree in at least four of them; for each of the 15 choices of four blocks
the fingerprints are keyed by these blocks, which is the top of a trie that has
these bits first. Below such a key at most 22 bits are free, so a subtree holds
at most 2^22 distinct values of 8 bytes, whatever the data. Tasks walk pairs of
nodes of their subtrees together, level by level, add up the differing bits and
drop a pair as soon as it exceeds the budget. A pair that meets under several
keys is reported under the first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import utf8
from .components import components

SEED = 42
WORDS = 3
BUDGET = 2
BLOCK_BITS = (11, 11, 11, 11, 10, 10)  # from the lowest bit
WORDS_AT_ONCE = 1 << 16  # shingles hashed at once
PAIRS_AT_ONCE = 1 << 18  # node pairs walked at once

_LOWS = [sum(BLOCK_BITS[:i]) for i in range(len(BLOCK_BITS))]
BLOCK_MASKS = [((1 << n) - 1) << low for n, low in zip(BLOCK_BITS, _LOWS)]
KEYS = [sum(BLOCK_MASKS[i] for i in chosen) for chosen in combinations(range(len(BLOCK_BITS)), len(BLOCK_BITS) - BUDGET)]
_BITS = np.array([[value >> bit & 1 for bit in range(8)] for value in range(256)], np.int64)


def fingerprint(text: bytes) -> int:
    """SimHash of the whole text: bit set where over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, total = np.zeros((8, 8), np.int64), len(words) - WORDS + 1
    for at in range(0, total, WORDS_AT_ONCE):
        part = words[at:at + WORDS_AT_ONCE + WORDS - 1]
        flat = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1:].tolist())], np.uint64, len(part) - WORDS + 1)
        by_byte = hashes.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            ones[i] += np.bincount(by_byte[:, i], minlength=256) @ _BITS
    bits = (2 * ones > total).reshape(64)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts count as empty."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x) for x in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def trie_pairs(values: np.ndarray, group: np.ndarray, bits: list[int], budget: int = BUDGET):
    """Index pairs (i, j) of one group that differ in at most `budget` of `bits`.

    `values` are sorted by group and then by `bits` from the first to the last,
    so that every trie node is a range of rows. Node pairs go through all
    levels together; large frontiers are walked in parts.
    """
    n = len(values)
    if n == 0:
        return
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], n)
    big = last - first > 1
    ones = [np.concatenate([[0], np.cumsum((values >> np.uint64(bit) & np.uint64(1)).astype(np.int32))]) for bit in bits]
    stack = [(0, first[big], last[big], first[big], last[big], np.zeros(big.sum(), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, errors = stack.pop()
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], errors[half:]))
            stack.append((depth, alo[:half], ahi[:half], blo[:half], bhi[:half], errors[:half]))
            continue
        if depth == len(bits):
            different = alo < blo  # a leaf is one value: the pair of a leaf with itself is no link
            yield alo[different], blo[different]
            continue
        set_before = ones[depth]
        amid = ahi - (set_before[ahi] - set_before[alo])
        bmid = bhi - (set_before[bhi] - set_before[blo])
        parts = []
        same = alo == blo
        for a0, a1, b0, b1, cost, once in ((alo, amid, blo, bmid, 0, False), (amid, ahi, bmid, bhi, 0, False),
                                           (alo, amid, bmid, bhi, 1, False), (amid, ahi, blo, bmid, 1, True)):
            ok = (a1 > a0) & (b1 > b0) & (errors + cost <= budget)
            if once:  # of a node with itself, the two mixed pairs are the same
                ok &= ~same
            own = same & (cost == 0)
            ok &= ~own | (a1 - a0 > 1)  # a single value has no pair inside
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], (errors[ok] + cost).astype(np.int8)))
        joined = [np.concatenate(x) for x in zip(*parts)]
        if len(joined[0]):
            stack.append((depth + 1, *joined))


def _free_bits(key: int) -> list[int]:
    return [bit for bit in range(63, -1, -1) if not KEYS[key] >> bit & 1]


def _links(values: np.ndarray, keys: np.ndarray):
    """Links among rows of whole (key, subtree) groups; rows may be in any order."""
    for key in np.unique(keys):
        v = values[keys == key]
        top = v & np.uint64(KEYS[key])
        order = np.lexsort((v, top))  # below one top, order by value is order by the free bits
        v, top = v[order], top[order]
        bits = _free_bits(int(key))
        for i, j in trie_pairs(v, top, bits):
            a, b = v[i], v[j]
            differ = a ^ b
            earlier = np.zeros(len(a), bool)
            for other in KEYS[:key]:
                earlier |= differ & np.uint64(other) == 0
            yield a[~earlier], b[~earlier]


def near_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b) for all pairs of distinct fingerprints `fp` that differ in at most BUDGET bits, each pair once."""

    def walk(batches):
        held_v, held_k = np.zeros(0, np.uint64), np.zeros(0, np.int32)

        def out(values, keys):
            for a, b in _links(values, keys):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.concatenate([held_v, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            k = np.concatenate([held_k, batch.column("k").to_numpy(zero_copy_only=False)])
            top = v & np.array(KEYS, np.uint64)[k]
            # The last subtree may go on in the next batch.
            open_from = len(v) - int(np.argmin(((top == top[-1]) & (k == k[-1]))[::-1])) if not ((top == top[-1]) & (k == k[-1])).all() else 0
            yield from out(v[:open_from], k[:open_from])
            held_v, held_k = v[open_from:], k[open_from:]
        yield from out(held_v, held_k)

    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(key if key < 1 << 63 else key - (1 << 64))).alias("top"))
        for i, key in enumerate(KEYS)])).alias("x")).select("fp", "x.k", "x.top")
    return keyed.repartition("k", "top").sortWithinPartitions("k", "top").select("fp", "k").mapInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document row.

    Texts without words, and null texts, have fingerprint zero and link to each
    other and to what lies near zero. Fewer than three words are one shingle.
    Rows that repeat an id are rows of one document. A null id takes part in its
    fingerprint's class and links it to others, but is nobody's component id; a
    component of null ids alone is null. An empty table gives an empty result; other columns are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs).checkpoint()  # texts are read and hashed once
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = classes.checkpoint()
    # Components of fingerprints first, then the least id of each.
    linked = components(near_pairs(classes.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = linked.withColumnRenamed("node", "fp").join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    labels = classes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the least id, and one row of that id.

    Rows without an id are kept, as they cannot be told apart by id.
    """
    kept = near_duplicates(docs.select("doc_id", "text")).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
