"""Line breaks over prefix sums, for whole columns of texts in Arrow batches.

Widths are summed once per text; a line ends at the last token whose sum still
fits, found by binary search, so the cost is one search per line and not one
step per token. Widths are whole eighths of an em, so sums are exact and the
results are those of `text.wrap_text` and `text.count_lines`.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import BROWSER_SPACE_CHARS
from .text import COLUMN_PITCH, GLYPH_EM, LINE_PITCH, OTHER_EM, PADDING, SPACE_EM, WIDE_CLASS, WIDE_EM

EIGHTHS = 8
SHORT = 256  # characters below which a plain loop sums faster than an array
_SPACES = re.compile(f"[{re.escape(BROWSER_SPACE_CHARS)}]+")


@functools.cache
def _eighths() -> np.ndarray:
    """Width of every code point in eighths of an em."""
    widths = np.full(0x110000, int(OTHER_EM * EIGHTHS), np.int64)
    for low, high in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", WIDE_CLASS):
        widths[int(low, 16):int(high, 16) + 1] = int(WIDE_EM * EIGHTHS)
    for _, chars, em in GLYPH_EM:
        widths[[ord(c) for c in chars]] = int(em * EIGHTHS)
    return widths


@functools.cache
def _width(char: str) -> int:
    return int(_eighths()[ord(char)])


class Tokens:
    """Words, or single characters, of a text: the text with single gaps, and where tokens start and end in it."""

    def __init__(self, text: str, per_char: bool):
        if per_char:
            self.text = text
            self.starts, self.ends = range(len(text)), range(1, len(text) + 1)
        else:
            words = _SPACES.split(text)
            self.text = " ".join(words)
            self.ends = [end - 1 for end in accumulate(len(w) + 1 for w in words)]
            self.starts = [end - len(w) for end, w in zip(self.ends, words)]
        if len(self.text) < SHORT:
            upto = [0, *accumulate(map(_width, self.text))]
        else:
            points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
            upto = [0, *np.cumsum(_eighths()[points]).tolist()]
        self.before = [upto[k] for k in self.starts]  # eighths before each token
        self.after = [upto[k] for k in self.ends]  # and up to its end

    def lines(self, font_px: float, max_w: float):
        """(first, last) token of every line. A token wider than the line stays whole; a line needs a width."""
        before, after, starts, ends = self.before, self.after, self.starts, self.ends
        n, i = len(starts), 0
        while i < n:
            if starts[i] == ends[i]:  # no token: at the start of a line it leaves no trace
                i += 1
                continue
            at = before[i]
            j = bisect_right(after, at + max_w * EIGHTHS / font_px if font_px else float("inf"), i + 1) - 1
            # The division can be one off, so the products decide.
            while j > i and (after[j] - at) / EIGHTHS * font_px > max_w:
                j -= 1
            while j + 1 < n and not (after[j + 1] - at) / EIGHTHS * font_px > max_w:
                j += 1
            yield i, j
            i = j + 1

    def broken(self, font_px: float, max_w: float) -> list[str]:
        return [self.text[self.starts[i]:self.ends[j]] for i, j in self.lines(font_px, max_w)]


@functools.cache
def _spaces() -> np.ndarray:
    """Which code points part words."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in BROWSER_SPACE_CHARS]] = True
    return out


class Texts:
    """`Tokens` of a whole batch in flat arrays: eighths before and up to every token, and the tokens of each text."""

    def __init__(self, texts: list[str], per_char: np.ndarray):
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        row = np.repeat(np.arange(len(n)), n)
        gap = _spaces()[points] & ~per_char[row]
        # Of a run of spaces in a text one gap stays.
        again = np.zeros(len(gap), bool)
        again[1:] = gap[1:] & gap[:-1] & (row[1:] == row[:-1])
        points, row, gap = points[~again], row[~again], gap[~again]
        self.points = np.where(gap, np.uint32(ord(" ")), points)  # the texts with single gaps, one behind the other
        upto = np.concatenate([[0], np.cumsum(np.where(gap, int(SPACE_EM * EIGHTHS), _eighths()[points]))])
        ends = np.cumsum(np.bincount(row, minlength=len(n)))
        firsts, words = np.concatenate([[0], ends])[:-1], ~per_char
        chars, gaps = np.flatnonzero(per_char[row]), np.flatnonzero(gap)
        starts = np.sort(np.concatenate([firsts[words], gaps + 1, chars]))
        stops = np.sort(np.concatenate([ends[words], gaps, chars + 1]))
        self.starts, self.stops = starts, stops
        self.before, self.after = upto[starts], upto[stops]
        self.last = np.cumsum(words + np.bincount(row[gaps], minlength=len(n)) + np.bincount(row[chars], minlength=len(n)))
        # A token of no width leaves no trace at the start of a line: the next one that has a width.
        here = np.where(starts < stops, np.arange(len(starts)), len(starts))
        self.next = np.append(np.minimum.accumulate(here[::-1])[::-1], len(starts))
        self.start = self.next[np.concatenate([[0], self.last])[:-1]]
        self.left = self.last - self.start  # below one where a text has no token

    def fit(self, rows: np.ndarray, font_px: np.ndarray, box_w: np.ndarray, box_h: np.ndarray) -> np.ndarray:
        """Whether the lines of texts `rows` fit their boxes. Line ends are looked up only where they decide.

        A text is left as soon as one more line is too many, or as soon as every token left could have a line of its own.
        """
        pitch, room, left = font_px * LINE_PITCH, box_h - font_px * PADDING * 1.5, self.left[rows]
        ok = _at_most(np.where(left > 0, pitch, 0), room)
        open_, n = np.flatnonzero(ok & ~_at_most(left * pitch, room)), 1
        at, last, wide = self.start[rows[open_]], self.last[rows[open_]], _line_eighths(font_px[open_], box_w[open_] - font_px[open_] * PADDING * 2)
        while len(open_):
            at, n = self.next[self._line_end(at, last, wide) + 1], n + 1
            left, p, r = last - at, pitch[open_], room[open_]
            fits = (left <= 0) | _at_most(n * p, r)
            ok[open_[~fits]] = False
            keep = np.flatnonzero(fits & (left > 0) & ~_at_most((n - 1 + left) * p, r))
            open_, at, last, wide = open_[keep], at[keep], last[keep], wide[keep]
        return ok

    def _line_end(self, i: np.ndarray, last: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Last tokens of the lines that start at tokens `i` of texts up to `last` and hold `wide` eighths; a first token stays whole."""
        return np.minimum(np.maximum(np.searchsorted(self.after, self.before[i] + wide, "right") - 1, i), last - 1)

    def broken(self, font_px: np.ndarray, max_w: np.ndarray) -> list[list[str]]:
        """The lines of every text. A step finds one line of every text that has one left."""
        wide, at, open_ = _line_eighths(font_px, max_w), self.start.copy(), np.arange(len(self.start))
        rows, starts, stops = [], [], []
        while len(open_ := open_[at[open_] < self.last[open_]]):
            i = at[open_]
            j = self._line_end(i, self.last[open_], wide[open_])
            rows.append(open_), starts.append(self.starts[i]), stops.append(self.stops[j])
            at[open_] = self.next[j + 1]
        if not rows:
            return [[] for _ in self.start]
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        text = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        lines = [text[a:b] for a, b in zip(np.concatenate(starts)[order].tolist(), np.concatenate(stops)[order].tolist())]
        ends = np.cumsum(np.bincount(row, minlength=len(self.start))).tolist()
        return [lines[a:b] for a, b in zip([0, *ends], ends)]


def _line_eighths(font_px: np.ndarray, max_w: np.ndarray) -> np.ndarray:
    """The eighths of an em that a line holds; below zero none."""
    wide = np.clip(np.floor(np.nan_to_num(max_w * EIGHTHS / font_px, nan=np.inf)), -2, 1 << 40)
    # The division can be one off, so the products decide.
    wide = wide + ((wide + 1) / EIGHTHS * font_px <= max_w)
    return (wide - (wide / EIGHTHS * font_px > max_w)).astype(np.int64)


def _at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a <= b in the order of SQL, where NaN is the greatest."""
    return (a <= b) | np.isnan(b)


def _columns_fit(n_chars: np.ndarray, font_px: np.ndarray, box_w: np.ndarray, box_h: np.ndarray) -> np.ndarray:
    """`text.fits_vertical` on arrays."""
    pitch, room = font_px * COLUMN_PITCH, box_h - font_px * PADDING * 2
    k = np.floor(np.nan_to_num(room / pitch))
    k = np.maximum(1, np.where(_at_most((k + 1) * pitch, room), k + 1, np.where(_at_most(k * pitch, room), k, k - 1)))
    return _at_most(np.ceil(n_chars / k) * pitch, box_w - font_px * PADDING) & _at_most(np.minimum(n_chars, k) * font_px * COLUMN_PITCH, room)


def _largest(fit: Callable, first_px: np.ndarray, min_px: float) -> np.ndarray:
    """The first size where it fits, else ten halvings between `min_px` and it. `fit(rows, sizes)` tells for some of the rows."""
    out, rows = first_px.copy(), np.arange(len(first_px))
    rows = rows[~fit(rows, first_px)]
    low, high = np.full(len(rows), float(min_px)), first_px[rows]
    for _ in range(10):
        middle = (low + high) / 2
        ok = fit(rows, middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle)
    out[rows] = low
    return out


def _known(columns: tuple[pa.Array, ...]) -> np.ndarray:
    """The rows without a null in any column."""
    return np.flatnonzero(np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]))


def _lines(texts: list[str], per_char: np.ndarray, px: np.ndarray, w: np.ndarray) -> list[list[str]]:
    """Short texts are broken together, line by line; a long one has many lines and is broken alone."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    together = (n < SHORT) & (px > 0) & np.isfinite(px) & np.isfinite(w)
    a, out = np.flatnonzero(together), [None] * len(texts)
    with np.errstate(all="ignore"):
        for k, lines in zip(a.tolist(), Texts([texts[k] for k in a], per_char[a]).broken(px[a], w[a])):
            out[k] = lines
    for k in np.flatnonzero(~together).tolist():
        out[k] = Tokens(texts[k], bool(per_char[k])).broken(float(px[k]), float(w[k]))
    return out


def broken_lines(text: Column, per_char: Column, font_px: Column, max_w: Column) -> Column:
    """The lines of a greedy break as an array of texts; a null in any column gives null."""
    @F.arrow_udf("array<string>")
    def run(text: pa.Array, per_char: pa.Array, font_px: pa.Array, max_w: pa.Array) -> pa.Array:
        columns = (text, per_char, font_px, max_w)
        known, out = _known(columns), [None] * len(text)
        text, *rest = (c.take(pa.array(known)) for c in columns)
        for k, lines in zip(known.tolist(), _lines(text.to_pylist(), *(c.to_numpy(zero_copy_only=False) for c in rest))):
            out[k] = lines
        return pa.array(out, pa.list_(pa.string()))

    return run(text, per_char, font_px.cast("double"), max_w.cast("double"))


def largest_font(text: Column, per_char: Column, first_px: Column, min_px: float, box_w: Column, box_h: Column, vertical: Column | None = None) -> Column:
    """`text.shrink_to_fit` for horizontal text, and for columns where `vertical` holds. Sizes are positive.

    A batch is searched as a whole: every size is tried on the same sums, and a step finds one line of every text.
    """
    @F.arrow_udf("double")
    def run(text: pa.Array, per_char: pa.Array, vertical: pa.Array, first_px: pa.Array, box_w: pa.Array, box_h: pa.Array) -> pa.Array:
        known = _known((text, per_char, vertical, first_px, box_w, box_h))
        out = np.full(len(text), np.nan)
        text, per_char, vertical, px, w, h = (c.take(pa.array(known)) for c in (text, per_char, vertical, first_px, box_w, box_h))
        tall, per_char, px, w, h = (c.to_numpy(zero_copy_only=False) for c in (vertical, per_char, px, w, h))
        with np.errstate(all="ignore"):
            a = np.flatnonzero(tall)
            n = pc.utf8_length(text).to_numpy(zero_copy_only=False)[a]
            out[known[a]] = _largest(lambda r, size: _columns_fit(n[r], size, w[a][r], h[a][r]), px[a], min_px)
            b = np.flatnonzero(~tall)
            flat = Texts(text.take(pa.array(b)).to_pylist(), per_char[b])
            out[known[b]] = _largest(lambda r, size: flat.fit(r, size, w[b][r], h[b][r]), px[b], min_px)
        missing = np.ones(len(out), bool)
        missing[known] = False
        return pa.array(out, mask=missing)

    return run(text, per_char, F.lit(False) if vertical is None else vertical, first_px.cast("double"), box_w.cast("double"), box_h.cast("double"))
