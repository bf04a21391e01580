"""Documents as token sequences of one length, packed by minimum bin slack.

Every task tokenizes its documents, cuts what is longer than a window and holds
the remaining pieces in a pool by length. For each window the longest piece is
taken, and a bitset subset-sum over the multiset of remaining lengths finds the
counts that fill the rest best. Only if the pool cannot fill a window exactly
is one more piece cut. What a task has left at its end is less than one window;
these ends of neighbouring tasks are packed together in a second, small step.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import Recent, slices, utf8
from .merge_matrix import MergeMatrix

WINDOW = 2048
END_ID = 1
POOL = 1024  # pieces at which a task starts to pack
CACHE_WORDS = 300_000
RUNS_AT_ONCE = 4_000
WORD_END = "</w>"
MARKS = (b",", b".", b"!", b"?", b";", b":")
CACHED_WORD_BYTES = 64
TEXT_AT_ONCE = 1 << 21
TASKS_PER_END = 64  # tasks whose ends are packed together: at most 64 windows of ids
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: printable ones as they are, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _letters(run: bytes) -> bytes | None:
    """The run as the vocabulary normalises it (composed, then lower case, letter by letter), if that is letters only."""
    text = unicodedata.normalize("NFC", run.decode("utf-8", "replace"))
    if text != text.lower():
        text = "".join(map(str.lower, text))
    return text.encode() if text.isalpha() else None


class WordTokenizer:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary drops white space and no token crosses it, so a text is the
    sequence of its words, and it is blind to the case of ASCII letters. A mark
    after a run of letters is a token sequence of its own. New runs of letters
    (letters also in the form the vocabulary normalises them to) are merged
    here, many at once; all other words go to the library whole. What was met
    lately is kept (see `Recent`).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path).encode_batch_fast
        self._words = Recent(CACHE_WORDS)
        self._marks = {m: self._each([m])[m] for m in MARKS} | {b"": b""}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, size = model["vocab"], max(model["vocab"].values()) + 1
        pairs = [(vocabulary[left], vocabulary[right], rank, vocabulary[left + right]) for rank, (left, right) in enumerate(model["merges"])]
        # A unit has a character per byte; the last byte of a run is a symbol of its own, 256 further on.
        alphabet = _byte_alphabet()
        characters = {chr(b): vocabulary[c] for b, c in enumerate(alphabet)} | {chr(256 + b): vocabulary[c + WORD_END] for b, c in enumerate(alphabet)}
        self._merges = MergeMatrix(pairs, characters, size, size)

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        made = self._encode([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(words, made)}

    def _letter_runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of normalised runs of letters, many at once."""
        out: list[bytes] = [b""] * len(runs)
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), RUNS_AT_ONCE):
            part = order[at:at + RUNS_AT_ONCE]
            points = np.frombuffer(b"".join([runs[i] for i in part.tolist()]), np.uint8).astype(np.uint32)
            points[np.cumsum(lengths[part]) - 1] += 256
            for i, ids in zip(part.tolist(), self._merges.matrix_of(lengths[part], points)):
                out[i] = ids
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """`words` have no letters A-Z."""
        runs = [w for w in words if w.isalpha() and len(w) <= CACHED_WORD_BYTES]  # bytes.isalpha: ASCII letters
        cut, whole, clean = {}, [], dict(zip(runs, runs))
        for w in words - clean.keys():
            run, mark = (w[:-1], w[-1:]) if w[-1:] in self._marks else (w, b"")
            form = clean.get(run) or (run if run.isalpha() else _letters(run) if run and not run.isascii() else None)
            if form and len(form) <= CACHED_WORD_BYTES:
                clean[run] = form
                cut[w] = run, mark
            else:
                whole.append(w)
        ids = dict(zip(clean, self._letter_runs(list(clean.values()))))
        made = {w: ids[w] for w in runs}
        made.update((w, ids[run] + self._marks[mark]) for w, (run, mark) in cut.items())
        return made | self._each(sorted(whole))

    def many(self, texts: list[bytes]) -> list[bytes]:
        split = [x.lower().split() for x in texts]
        fresh = self._words.missing(set().union(*split))
        if fresh:
            self._words.update(self._learn(fresh))
        get = self._words.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        self._words.forget(w for w in fresh if len(w) > CACHED_WORD_BYTES)
        return out

    def forget(self) -> None:
        """Lets go of all words; the merges stay."""
        self._words = Recent(CACHE_WORDS)

    def long(self, text: bytes) -> bytes:
        """One text of any length, part by part, cut at spaces."""
        parts, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= TEXT_AT_ONCE else text.rfind(b" ", at, at + TEXT_AT_ONCE)
            if end <= at:
                end = text.find(b" ", at + TEXT_AT_ONCE)
                end = len(text) if end < 0 else end
            parts += self.many([text[at:end]])
            at = end + (end < len(text))
        return b"".join(parts)


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that the tasks it runs share it."""
    return WordTokenizer(path)


def tokens(texts: list[bytes], tokenizer: WordTokenizer):
    """The ids of each text with the end id, in order."""
    end = END_ID.to_bytes(4, "little")
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        if size + len(text) > TEXT_AT_ONCE and waiting:
            yield from (x + end for x in tokenizer.many(waiting))
            waiting, size = [], 0
        if len(text) > TEXT_AT_ONCE:
            yield tokenizer.long(text) + end
        else:
            waiting.append(text)
            size += len(text)
    yield from (x + end for x in tokenizer.many(waiting))


def best_fill(stock: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """(total, {length: count}) of the stock's sub-multiset with the largest total up to `capacity`.

    Bit s of `reach` says that s can be filled. Counts enter in binary shares,
    each share is one shift; the bitsets before each share give the counts back.
    Longer pieces come first, and it stops once the capacity is met.
    """
    mask, reach = (1 << capacity + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in stock if 0 < x <= capacity), reverse=True):
        left, share = min(stock[length], capacity // length), 1
        while left > 0:
            take = min(share, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & mask
            left -= take
            share *= 2
        if reach >> capacity & 1:
            break
    total = rest = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> rest & 1:
            used[length] += take
            rest -= length * take
    return total, dict(used)


class Packer:
    """Windows from pieces (doc_id, start, ids, doc_tokens), handed out as rows."""

    def __init__(self, first_sequence: int, window: int = WINDOW, pool: int = POOL):
        self.sequence, self.window, self.pool = first_sequence, window, pool
        self.stock: dict[int, int] = {}
        self.pieces: dict[int, list] = defaultdict(list)
        self.waiting = 0  # pieces
        self.tokens = 0

    def document(self, doc_id, ids: bytes):
        """Rows of the full windows that a document fills alone; its rest goes to the pool."""
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            yield self._row(doc_id, at, ids[4 * at:4 * (at + self.window)], n, 0)
            self.sequence += 1
            at += self.window
        if at < n:
            self.add((doc_id, at, ids[4 * at:], n))
        while self.waiting >= self.pool and self.tokens >= 2 * self.window:
            yield from self.fill()

    def add(self, piece):
        length = len(piece[2]) // 4
        self.pieces[length].append(piece)
        self.stock[length] = self.stock.get(length, 0) + 1
        self.waiting += 1
        self.tokens += length

    def _take(self, length: int):
        piece = self.pieces[length].pop()
        self.stock[length] -= 1
        if not self.stock[length]:
            del self.stock[length], self.pieces[length]
        self.waiting -= 1
        self.tokens -= length
        return piece

    def _row(self, doc_id, start, ids, doc_tokens, offset):
        return doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, self.sequence, offset

    def fill(self):
        """One window: the longest piece and the best fill beside it; the last gap cuts a piece."""
        chosen = [self._take(max(self.stock))]
        room = self.window - len(chosen[0][2]) // 4
        total, used = best_fill(self.stock, room)
        for length, count in used.items():
            chosen += [self._take(length) for _ in range(count)]
        room -= total
        if room and self.stock:  # every piece left is longer than the gap
            doc_id, start, ids, n = self._take(max(self.stock))
            chosen.append((doc_id, start, ids[:4 * room], n))
            self.add((doc_id, start + room, ids[4 * room:], n))
        offset = 0
        for doc_id, start, ids, n in chosen:
            yield self._row(doc_id, start, ids, n, offset)
            offset += len(ids) // 4
        self.sequence += 1

    def full(self):
        while self.tokens >= self.window:
            yield from self.fill()

    def rest(self):
        """The pieces of less than one window that are left."""
        return [p for length in sorted(self.pieces) for p in self.pieces[length]]


def _batch(rows: list[tuple], id_type: pa.DataType, ends: list[bytes | None], task: int) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(COLUMNS)
    arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:]),
              pa.array(ends, pa.binary()), pa.array([task] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, [*COLUMNS, "end_ids", "task"])


def pack(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed one by
    one, so an id's pieces then occur as often as its rows. A null id is kept.
    An empty table gives no rows; other columns are ignored. Lengths, offsets
    and `start` count ids; a sequence has offsets from 0 without gaps.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    path = vocabulary_path or vocabulary()
    chosen = docs.select("doc_id", "text")
    id_kind = chosen.schema["doc_id"].dataType.simpleString()
    rows_schema = f"doc_id {id_kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:])

    def tasks(batches):
        task = TaskContext.get().partitionId()
        packer, tokenizer, id_type = Packer(task << 32), _tokenizer(path), None
        for batch in (part for whole in batches for part in slices(whole)):
            id_type = batch.schema.field("doc_id").type
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc_id, encoded in zip(ids, tokens(utf8(batch.column("text")), tokenizer)):
                rows.extend(packer.document(doc_id, encoded))
                if len(rows) >= 20_000:
                    yield _batch(rows, id_type, [None] * len(rows), task)
                    rows = []
            if rows:
                yield _batch(rows, id_type, [None] * len(rows), task)
        tokenizer.forget()  # what the worker runs next needs the memory
        pa.default_memory_pool().release_unused()
        if id_type is not None:
            rows = list(packer.full())
            if rows:
                yield _batch(rows, id_type, [None] * len(rows), task)
            left = packer.rest()
            yield _batch([(d, s, len(x) // 4, 0, n, 0, 0) for d, s, x, n in left], id_type, [x for _, _, x, _ in left], task)

    def ends(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["task", "length", "start", "doc_id", "end_ids", "doc_tokens"]).to_pylist(),
                      key=lambda r: (r["task"], r["length"], r["start"], r["doc_id"] is None, r["doc_id"] or 0, r["end_ids"]))
        packer = Packer((1 << 62) + (rows[0]["task"] // TASKS_PER_END << 32))
        for r in rows:
            packer.add((r["doc_id"], r["start"], r["end_ids"], r["doc_tokens"]))
        out = list(packer.full())
        if packer.tokens:
            out += list(packer.fill())
        made = _batch(out, table.schema.field("doc_id").type, [None] * len(out), 0)
        return pa.Table.from_batches([made]).select(COLUMNS)

    # Checkpointed, as both branches below read it: no text is tokenized twice.
    packed = chosen.mapInArrow(tasks, rows_schema + ", end_ids binary, task long").checkpoint()
    whole = packed.where(F.col("end_ids").isNull()).select(*COLUMNS)
    rest = (packed.where(F.col("end_ids").isNotNull()).withColumn("_g", F.floor(F.col("task") / TASKS_PER_END))
            .groupBy("_g").applyInArrow(lambda table: ends(table.drop_columns(["_g"])), rows_schema))
    return whole.unionByName(rest)
