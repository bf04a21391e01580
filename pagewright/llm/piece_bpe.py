"""SentencePiece encoding (BPE models) with the source bytes of every piece, and decoding.

A text is first normalised by longest prefixes through the model's compiled
character map. Every normalised byte keeps the place in the source it comes
from, so a piece, which is a run of normalised bytes, is projected to a run of
source bytes. The merges then work on units that no merge can cross; units are
merged many at a time, as rows of a matrix.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, utf8
from .merge_matrix import MergeMatrix

SPACE = "▁"
_SPACE = SPACE.encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
UNITS = 150_000  # units a worker keeps; time only
UNITS_AT_ONCE = 4_000
MATRIX_CHARS = 64  # longer units take a queue
CACHED_UNIT_CHARS = 64
TEXT_AT_ONCE = 1 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """A compiled character map: a double-array trie of source strings, then their replacements.

    Units of the array are 32 bits: bit 31 marks a value, bit 8 a node that has
    one, the low byte (with bit 31) is the label, the rest the offset to the children.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self._units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self._replacements = compiled[4 + size:]
        self._known: dict[bytes, tuple[bytes, int]] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """(length, place of the replacement) of the longest source string at `at`."""
        units = self._units
        if not units:
            return None
        node, found = self._offset(units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & (1 << 31 | 0xFF) != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & (1 << 31) - 1
        return found

    def prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, source bytes): the longest source string, else one character as it is, else one bad byte."""
        hit = self.longest(text, at)
        if hit:
            length, place = hit
            return self._replacements[place:self._replacements.index(0, place)], length
        first = text[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        one = text[at:at + length]
        try:
            one.decode()
            return one, length
        except UnicodeDecodeError:
            return b"\xef\xbf\xbd", 1

    @property
    def empty(self) -> bool:
        return not self._units


def _one_by_one(error):
    return "�", error.start + 1


codecs.register_error("pagewright-one-by-one", _one_by_one)  # every byte that is not UTF-8 is a replacement character of its own


@dataclass(frozen=True)
class Encoded:
    ids: np.ndarray  # with begin and end ids, unsigned 32 bits
    starts: np.ndarray  # first source byte of every id
    ends: np.ndarray  # source byte after it


class PieceModel(MergeMatrix):
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or USER_DEFINED in kinds or UNUSED in kinds or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without user-defined or unused pieces and with leading spaces")
        spec = model.normalizer_spec
        self.chars = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        ids = {p.piece: i for i, p in enumerate(model.pieces)}
        trainer = model.trainer_spec
        self.begin, self.end = ids.get(trainer.bos_piece), ids.get(trainer.eos_piece)
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = [ids.get(f"<0x{b:02X}>") for b in range(256)] if trainer.byte_fallback else None
        self._merges(model.pieces)
        # For decoding: what each id stands for, and its length in normalised bytes.
        self._bytes = [p.piece.encode() if k == NORMAL else bytes([int(p.piece[1:-1], 16)]) if k == BYTE else trainer.unk_surface.encode() if k == UNKNOWN else b""
                       for p, k in zip(model.pieces, kinds)]
        self._length = np.array([len(b) for b in self._bytes], np.int64)
        self._shown = [b.replace(_SPACE, b" ") if k == NORMAL else b for b, k in zip(self._bytes, kinds)]
        self._leads = [k == NORMAL and b.startswith(_SPACE) for b, k in zip(self._bytes, kinds)]
        self._is_byte = np.array([k == BYTE for k in kinds])
        self._silent = np.array([k == CONTROL for k in kinds])
        self._units = Recent(UNITS)

    def _merges(self, pieces) -> None:
        """Pairs of symbols that are a piece together, the best score first."""
        normal = {p.piece: (i, p.score) for i, p in enumerate(pieces) if p.type == NORMAL}
        symbols = {s: i for s, (i, _) in normal.items()}
        inner = sorted({c for s in normal for c in s} - set(symbols))  # characters of pieces that are no piece themselves
        symbols |= {c: len(pieces) + k for k, c in enumerate(inner)}
        self._inner = inner
        ranks = {score: r for r, score in enumerate(sorted({score for _, score in normal.values()}, reverse=True))}
        pairs = [(symbols[s[:k]], symbols[s[k:]], ranks[score], i)
                 for s, (i, score) in normal.items() for k in range(1, len(s)) if s[:k] in symbols and s[k:] in symbols]
        super().__init__(pairs, {s: i for s, i in symbols.items() if len(s) == 1}, len(pieces), len(symbols) + len(pieces))
        # A unit ends where no piece goes on: before a space mark that follows something else, and round characters that never merge.
        merging = {c for s in normal if len(s) > 1 for c in s}
        alone = "".join(chr(c) for c in range(128) if chr(c) not in merging)
        if any(SPACE in s.lstrip(SPACE) for s in normal):
            self._unit = re.compile(r"(?s).+")
        else:
            self._unit = re.compile(f"[{re.escape(alone)}]|{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+")

    # Normalising

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source place of each of them and of the end)."""
        if self.chars.empty and self.escape and not self.squeeze:
            return self._plain(text)
        at, n = 0, len(text)
        if self.squeeze:
            while at < n:
                made, used = self.chars.prefix(text, at)
                if made != b" ":
                    break
                at += used
        if at >= n:
            return b"", np.zeros(1, np.int64)
        out, places = bytearray(), []
        mark = _SPACE if self.escape else b" "
        if self.dummy:
            out += mark
            places += [at] * len(mark)
        after_space = self.squeeze
        while at < n:
            made, used = self.chars.prefix(text, at)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                shown = made.replace(b" ", mark)
                out += shown
                places += [at] * len(shown)
                after_space = made.endswith(b" ")
            at += used
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark):]
                at = places[len(out)]
                del places[len(out):]
        return bytes(out), np.array([*places, at], np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty map: characters stay, spaces become three bytes."""
        if not text:
            return b"", np.zeros(1, np.int64)
        out = text.replace(b" ", _SPACE)
        times = np.ones(len(text), np.int64)
        times[np.frombuffer(text, np.uint8) == 32] = len(_SPACE)
        places = np.repeat(np.arange(len(text)), times)
        if self.dummy:
            out = _SPACE + out
            places = np.concatenate([np.zeros(len(_SPACE), np.int64), places])
        return out, np.append(places, len(text))

    # Merging

    def spell(self, symbols: list[int]) -> bytes:
        """Ids of symbols; a character that is no piece becomes its bytes, or the unknown id."""
        ids: list[int] = []
        for s in symbols:
            if 0 <= s < self.plain:
                ids.append(s)
                continue
            char = chr(-3 - s) if s < 0 else self._inner[s - self.plain]
            ids += [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]
        return np.array(ids, "<u4").tobytes()

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        out = {u: self.spell(self.queue(u)) for u in units if len(u) > MATRIX_CHARS}
        short = sorted((u for u in units if len(u) <= MATRIX_CHARS), key=len)
        for at in range(0, len(short), UNITS_AT_ONCE):
            part = short[at:at + UNITS_AT_ONCE]
            out.update(zip(part, self.matrix(part)))
        return out

    def _merged(self, texts: list[str]) -> list[bytes]:
        split = [self._unit.findall(x) for x in texts]
        fresh = self._units.missing(set().union(*split))
        if fresh:
            self._units.update(self._learn(fresh))
        get = self._units.__getitem__
        out = [b"".join(map(get, units)) for units in split]
        self._units.forget(u for u in fresh if len(u) > CACHED_UNIT_CHARS)
        return out

    # Texts

    def encode(self, texts: list[bytes], ends: bool = True):
        """`Encoded` of every text, in order; at most about TEXT_AT_ONCE bytes of units are looked up at once."""
        waiting: list[tuple[bytes, bytes, np.ndarray]] = []
        size = 0
        for text in texts:
            waiting.append((text, *self.normalise(text)))
            size += len(text)
            if size >= TEXT_AT_ONCE:
                yield from self._encoded(waiting, ends)
                waiting, size = [], 0
        yield from self._encoded(waiting, ends)

    def _encoded(self, waiting, ends: bool):
        merged = self._merged([clean.decode("utf-8", "replace") for _, clean, _ in waiting])
        for (text, clean, places), raw in zip(waiting, merged):
            ids = np.frombuffer(raw, "<u4")
            starts, stops = self.spans(ids, clean, places)
            if ends:
                ids = np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")
                starts = np.concatenate([[0], starts, [len(text)]])
                stops = np.concatenate([[0], stops, [len(text)]])
            yield Encoded(ids, starts, stops)

    def spans(self, ids: np.ndarray, clean: bytes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes of every id. The bytes of one character share its start; only the last one ends behind it."""
        if self.byte_ids is None and (ids == self.unknown).any():
            lengths = self._length[ids]
            at = 0
            for k, i in enumerate(ids.tolist()):  # an unknown id is one character of the text
                if i == self.unknown:
                    first = clean[at]
                    lengths[k] = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                at += int(lengths[k])
        else:
            lengths = self._length[ids]
        upto = np.cumsum(lengths)
        starts, stops = places[upto - lengths], places[upto]
        if self.byte_ids is not None:
            inner = self._is_byte[ids]
            if inner.any():
                head = np.zeros(len(clean) + 1, np.int64)  # first byte of the character each byte is in
                lead = (np.frombuffer(clean, np.uint8) & 0xC0) != 0x80
                head[:-1] = np.maximum.accumulate(np.where(lead, np.arange(len(clean)), 0))
                head[-1] = len(clean)
                starts = np.where(inner, places[head[upto - lengths]], starts)
                stops = np.where(inner & (head[upto] != upto), starts, stops)
        return starts, stops

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Control ids are silent, one leading space goes where the model adds one."""
        parts, lead = [], self.dummy or self.squeeze
        for i in ids:
            shown = self._shown[i]
            if lead and not self._silent[i]:
                if self._leads[i]:
                    shown = shown.lstrip(b" ") if self.squeeze else shown[1:]
                    lead = self.squeeze and not shown
                else:
                    lead = False
            parts.append(shown)
        return b"".join(parts).decode("utf-8", "pagewright-one-by-one")


@functools.lru_cache(maxsize=1)
def _model(path: str) -> PieceModel:
    """One per Python worker, so that the tasks it runs share it."""
    return PieceModel(path)


def encode_spans(docs: DataFrame, model_path: str | None = None, begin_end: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends): one row per row of `docs`, the source bytes of every id beside it.

    A null text counts as empty and has the begin and end ids only. Ids that
    repeat or are null are kept row by row. No rows in, none out; other columns are ignored.
    """
    path = model_path or vocabulary()

    def run(batches):
        model = _model(path)
        kinds = pa.list_(pa.int64())
        for batch in batches:
            rows = list(model.encode(utf8(batch.column("text")), begin_end))
            lists = [pa.array([getattr(x, k).tolist() for x in rows], kinds) for k in ("ids", "starts", "ends")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids array<long>, starts array<long>, ends array<long>")


def decode_ids(encoded: DataFrame, ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of lists of ids; a null list is an empty text. Bytes that are no UTF-8 become replacement characters."""
    path = model_path or vocabulary()

    def run(batches):
        model = _model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    chosen = encoded.select("doc_id", ids)
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, text string")


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32: digests of what `encode_spans` and `decode_ids` give.

    Ids as little-endian unsigned 32-bit numbers; spans as (start, end) pairs of
    such numbers, 64 bits each. Rows are treated as in `encode_spans`.
    """
    path = model_path or vocabulary()

    def run(batches):
        model = _model(path)
        for batch in batches:
            sizes, digests, decoded, spans = [], [], [], []
            for x in model.encode(utf8(batch.column("text"))):
                sizes.append(len(x.ids))
                digests.append(hashlib.sha256(x.ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(x.ids.tolist()).encode()).hexdigest())
                spans.append(zlib.crc32(np.stack([x.starts, x.ends], 1).astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()),
                                              pa.array(spans, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    chosen = docs.select("doc_id", "text")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
