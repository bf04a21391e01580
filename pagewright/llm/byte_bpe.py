"""Byte-level BPE by recursive queries: DuckDB, in the memory of each task.

A task keeps the ids of the text pieces it has met. Pieces that are new become
token-position rows, one per byte. A recursive query joins neighbouring tokens
to the merge table and contracts, in every word, the leftmost pair of least
rank, until no pair of the word is in the table; an ordered aggregation then
gives the word's ids and decodes them. DuckDB is a library inside the Python
worker here: no server, no file, one thread, bounded memory.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, utf8

TEXT_AT_ONCE = 1 << 21
CACHE_PIECES = 150_000
CACHE_WORDS = 250_000
CACHED_PIECE_BYTES = 64
WORDS_AT_ONCE = 20_000  # words of one recursive query
QUERY_BYTES = 256  # longer words are contracted by a queue, as a query's work grows with the square of the length
MEMORY = "250MB"
#: Unicode's White_Space.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RARE_SPACE = [c for c in WHITE_SPACE if c not in " \n"]
MARKS = (",", ".", "!", "?", ";", ":")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    """The split pattern; its white space is Unicode's, which `\\s` of this regex library is not quite."""
    import public_tokenizers

    return public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


CONTRACT = """
WITH RECURSIVE state AS (
    SELECT w, pos, tok, 0 AS step FROM base
    UNION ALL
    (WITH pairs AS (
        SELECT s.w, s.pos, s.tok, s.step, s.next_pos, m.merged * 1024 + s.pos AS pair
        FROM (
            SELECT w, pos, tok, step, lead(tok) OVER along AS next, lead(pos) OVER along AS next_pos, lead(w) OVER along AS next_w
            FROM state WINDOW along AS (ORDER BY w * 1024 + pos)
        ) s
        LEFT JOIN merges m ON m.a = s.tok AND m.b = CASE WHEN s.next_w = s.w THEN s.next END
    ), best AS (
        SELECT w, min(pair) AS best, arg_min(next_pos, pair) AS gone FROM pairs WHERE pair IS NOT NULL GROUP BY w
    )
    SELECT p.w, p.pos, CASE WHEN p.pair = b.best THEN b.best // 1024 ELSE p.tok END AS tok, p.step + 1 AS step
    FROM pairs p JOIN best b ON p.w = b.w WHERE p.pos <> b.gone)
)
SELECT s.w AS w, list(s.tok ORDER BY s.pos) AS ids, string_agg(hex(v.bytes), '' ORDER BY s.pos) AS decoded
FROM state s
JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) last USING (w, step)
JOIN vocab v ON v.tok = s.tok
GROUP BY s.w
"""


class BpeTables:
    """The merge table and the contraction of words in DuckDB."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks(path)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        a, b, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    merged.append(rank)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        self._fill("merges", pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        self._fill("vocab", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int64()), "bytes": pa.array(list(self.ranks), pa.binary())}))

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.con.register("_rows", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
        self.con.unregister("_rows")

    def encode(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """{word: (ids as little-endian 32-bit bytes, the ids decoded)}"""
        made: dict[bytes, tuple[bytes, bytes]] = {}
        short = []
        for word in words:
            if len(word) > QUERY_BYTES:
                ids = contract_long(word, self.ranks)
                names = self._names()
                made[word] = (np.array(ids, "<u4").tobytes(), b"".join(names[i] for i in ids))
            else:
                short.append(word)
        for at in range(0, len(short), WORDS_AT_ONCE):
            part = short[at:at + WORDS_AT_ONCE]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            starts = np.cumsum(lengths) - lengths
            w = np.repeat(np.arange(len(part)), lengths)
            flat = self.of_byte[np.frombuffer(b"".join(part), np.uint8)]
            self.con.register("base", pa.table({"w": w, "pos": np.arange(len(flat)) - starts[w], "tok": flat}))
            found = self.con.execute(CONTRACT).to_arrow_table()
            self.con.unregister("base")
            # One pass over the flat list values; each word's ids are one slice.
            ids = found.column("ids").combine_chunks()
            offsets = ids.offsets.to_numpy() * 4
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            for i, (n, text) in enumerate(zip(found.column("w").to_pylist(), found.column("decoded").to_pylist())):
                word, decoded = part[n], bytes.fromhex(text)
                made[word] = (raw[offsets[i]:offsets[i + 1]], word if decoded == word else decoded)  # one copy in the tables
        return made

    def _names(self) -> dict[int, bytes]:
        if not hasattr(self, "_by_id"):
            self._by_id = {v: k for k, v in self.ranks.items()}
        return self._by_id


def contract_long(word: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """The same contraction with a queue of pairs, for words of any length."""
    import heapq

    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\x01") * n
    queue = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (rank := rank_of.get(word[i:end[j]])) is not None:
            heapq.heappush(queue, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, until = heapq.heappop(queue)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != until:
            continue
        alive[j], end[i], nxt[i] = 0, end[j], nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [rank_of[word[i:end[i]]] for i in range(n) if alive[i]]


def pieces_of(text: str) -> list[str]:
    """The text cut where no match of the split pattern can cross; joined the pieces give the text.

    A space between two characters that are no white space begins a match, so
    it begins a piece; a line feed between two such characters is a match and a
    piece of its own. A text with any other kind of white space, or with white
    space next to white space or at an end, is cut by the careful loop below.
    """
    if not text:
        return []
    if not (any(c in text for c in _RARE_SPACE) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
            or text[0] in " \n" or text[-1] in " \n"):
        first, *lines = text.split("\n")
        out = _words_of(first)
        for line in lines:
            out.append("\n")
            out += _words_of(line)
        return out
    out: list[str] = []
    open_end = False
    for i, part in enumerate(text.split(" ")):
        if i and (open_end or not part or part[0] in WHITE_SPACE):
            out[-1] += " " + part
        else:
            out.append(" " + part if i else part)
        open_end = not part or part[-1] in WHITE_SPACE
    return [p for p in out if p]


def _words_of(line: str) -> list[str]:
    first, *rest = line.split(" ")
    return [first, *[" " + w for w in rest]]


class ByteBpe:
    """Encodes and decodes texts. Two tables of recent work: pieces of texts, and words of the split pattern."""

    def __init__(self, path: str):
        import regex

        self.tables = BpeTables(path)
        self.split = regex.compile(pattern()).findall
        self.pieces = Recent(CACHE_PIECES)
        self.words = Recent(CACHE_WORDS)

    def _split(self, piece: str) -> list[bytes]:
        """The matches of the split pattern. A run of letters with a space before and a mark behind is seen without it."""
        run = piece[1:] if piece[0] == " " else piece
        if run.isalpha():
            return [piece.encode()]
        if run[-1:] in MARKS and run[:-1].isalpha():
            return [piece[:-1].encode(), run[-1:].encode()]
        return [w.encode() for w in self.split(piece)]

    def _learn(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes]]:
        words = {p: self._split(p) for p in pieces}
        fresh = self.words.missing(set().union(*words.values()))
        self.words.update(self.tables.encode(sorted(fresh)))
        known = self.words
        made = {p: known[ws[0]] if len(ws) == 1 else (b"".join([known[w][0] for w in ws]), b"".join([known[w][1] for w in ws]))
                for p, ws in words.items()}
        known.forget(w for w in fresh if len(w) > CACHED_PIECE_BYTES)
        return made

    def many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of each text."""
        split = [pieces_of(text) for text in texts]
        fresh = self.pieces.missing(set().union(*split))
        if fresh:
            self.pieces.update(self._learn(fresh))
        get = self.pieces.__getitem__
        out = []
        for parts in split:
            ids, decoded = zip(*map(get, parts)) if parts else ((), ())
            out.append((b"".join(ids), b"".join(decoded)))
        self.pieces.forget(p for p in fresh if len(p) > CACHED_PIECE_BYTES)
        return out


@functools.lru_cache(maxsize=1)
def _bpe(path: str) -> ByteBpe:
    """One per Python worker, so that the tasks it runs share its tables."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per document row.

    A null text counts as empty: no ids. Repeated rows are encoded one by one
    and alike; null ids are kept; an empty table gives no rows; other columns
    are ignored. A word of any length is one row's work in one task.
    """
    path = vocabulary_path or vocabulary()
    chosen = docs.select("doc_id", "text")

    def run(batches):
        bpe = _bpe(path)
        for batch in batches:
            texts = [x.decode() for x in utf8(batch.column("text"))]
            counts, ids, decoded = [], [], []
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= TEXT_AT_ONCE):
                    size += len(texts[to])
                    to += 1
                for x, y in bpe.many(texts[at:to]):
                    counts.append(len(x) // 4)
                    ids.append(hashlib.sha256(x).hexdigest())
                    decoded.append(hashlib.sha256(y).hexdigest())
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
