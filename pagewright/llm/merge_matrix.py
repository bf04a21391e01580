"""Byte-pair merges of many short units at once, as rows of a matrix."""

from __future__ import annotations

import heapq

import numpy as np

FAR = 1 << 30


class MergeMatrix:
    """Merges by rank, the leftmost pair on ties, as a byte-pair encoder does one by one.

    `pairs`: (left, right, rank, made) in symbol numbers; `characters`: the
    symbol of each character. Symbols below `plain` are ids as they are; others,
    and characters without a symbol (-3 - code point), are spelt by `spell`.
    """

    def __init__(self, pairs: list[tuple[int, int, int, int]], characters: dict[str, int], plain: int, symbols: int):
        self.plain, self._stride = plain, symbols
        table = np.array(sorted((left * symbols + right, rank, made) for left, right, rank, made in pairs), np.int64).reshape(-1, 3)
        self._pair, self._rank, self._made = (np.append(table[:, j], last) for j, last in enumerate((np.iinfo(np.int64).max, FAR, -1)))
        self._symbol_of = np.full(0x110000, -1, np.int32)
        for c, symbol in characters.items():
            self._symbol_of[ord(c)] = symbol

    def spell(self, symbols: list[int]) -> bytes:
        raise ValueError("a character without an id")

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs; rank FAR where they do not merge."""
        pair = left.astype(np.int64) * self._stride + right
        pair[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self._pair, pair)
        hit = self._pair[at] == pair
        return np.where(hit, self._rank[at], FAR), np.where(hit, self._made[at], -1)

    def matrix(self, units: list[str]) -> list[bytes]:
        """Ids of units of like length."""
        return self.matrix_of(np.array([len(u) for u in units]), np.frombuffer("".join(units).encode("utf-32-le"), "<u4"))

    def matrix_of(self, lengths: np.ndarray, points: np.ndarray) -> list[bytes]:
        """The same for the characters of all units in one array: each round merges every row's best pair, the leftmost on ties."""
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        symbols = np.full((len(lengths), width), -2, np.int64)
        symbols[inside] = self._symbol_of[points]
        raw = np.zeros((len(lengths), width), np.int64)
        raw[inside] = points  # an unknown character keeps its code point
        symbols = np.where(inside & (symbols < 0), -3 - raw, symbols)
        done: list[bytes] = [b""] * len(lengths)
        rows = np.arange(len(lengths))
        ranks = self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())[0].reshape(len(lengths), width - 1) if width > 1 else np.full((len(lengths), 1), FAR)
        columns = np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            open_ = ranks[here, best] < FAR
            self._settle(rows[~open_].tolist(), symbols[~open_], done)
            rows, symbols, ranks, best = rows[open_], symbols[open_], ranks[open_], best[open_]
            if not len(rows):
                break
            here = np.arange(len(rows))
            symbols[here, best] = self.look_up(symbols[here, best], symbols[here, best + 1])[1]
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, 1)
            symbols[:, -1] = -2
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 2), 1)
            ranks[:, -1] = FAR
            ranks[here, best] = self.look_up(symbols[here, best], symbols[here, np.minimum(best + 1, width - 1)])[0]
            left = np.maximum(best - 1, 0)
            fresh = self.look_up(symbols[here, left], symbols[here, best])[0]
            ranks[here, left] = np.where(best > 0, fresh, ranks[here, left])
        return done

    def _settle(self, rows: list[int], symbols: np.ndarray, done: list[bytes]) -> None:
        """Writes the ids of merged rows of symbols (-2 behind the last one)."""
        used = symbols != -2
        flat = symbols[used]
        stops = np.cumsum(used.sum(axis=1))
        plain = ((symbols == -2) | (symbols >= 0) & (symbols < self.plain)).all(axis=1)
        raw, at = flat.astype("<u4").tobytes(), 0
        for r, stop, easy in zip(rows, stops.tolist(), plain.tolist()):
            done[r] = raw[4 * at:4 * stop] if easy else self.spell(flat[at:stop].tolist())
            at = stop

    def queue(self, unit: str) -> list[int]:
        """The same for one long unit: a heap of pairs and linked neighbours."""
        symbols = [int(s) if s >= 0 else -3 - ord(c) for s, c in zip(self._symbol_of[np.frombuffer(unit.encode("utf-32-le"), "<u4")].tolist(), unit)]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, made = self.look_up(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)) if n > 1 else (np.zeros(0), np.zeros(0))
        heap = [(int(r), i, symbols[i], symbols[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, made)) if r < FAR]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j], after[i] = piece, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    rank, piece = (int(x[0]) for x in self.look_up(np.array([symbols[a]]), np.array([symbols[b]])))
                    if rank < FAR:
                        heapq.heappush(heap, (rank, a, symbols[a], symbols[b], piece))
        return [s for s in symbols if s is not None]
