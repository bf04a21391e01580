"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the space mark before it. Distinct pre-tokens go
into a trie; a node's forward score is the best score of any segmentation of
the prefix it stands for, so it is computed once for all words that share the
prefix. The node where a word ends gives its token count.

The piece file has ranks instead of probabilities. A piece of rank r scores
-ln(r + 2), as word frequencies fall with their rank (Zipf). Scores are whole
millionths, so sums are exact; of equal scores the fewer tokens win. Characters
outside the vocabulary count one token per UTF-8 byte.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, strings

SPACE = "▁"
NODES = 600_000  # of a trie, then a new one is begun
KNOWN_WORDS = 400_000
LONG_WORD = 256  # longer words are scored without a trie
TEXT_AT_ONCE = 1 << 20
_COUNT_BITS = 32


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """({piece: score}, longest piece). A score also holds one token in its low bits."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            rank = -model.get_score(i)
            scores[model.id_to_piece(i)] = step(-round(1e6 * math.log(rank + 2)))
    return scores, max(map(len, scores))


def step(score: int, tokens: int = 1) -> int:
    return (score << _COUNT_BITS) - tokens


def count_of(total: int) -> int:
    return -total & ((1 << _COUNT_BITS) - 1)


_BYTE_SCORE = -20_000_000  # lower than any piece's, so bytes are the last resort


class Suffixes:
    """Which pieces end at a position: an automaton over the characters read so far.

    A state is the longest suffix that begins some piece; `pieces_at` lists the
    (length, score) of all pieces that end there.
    """

    def __init__(self, scores: dict[str, int]):
        self.after: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for piece, score in scores.items():
            state = 0
            for char in piece:
                following = self.after[state].get(char)
                if following is None:
                    following = self.after[state][char] = len(self.after)
                    self.after.append({})
                    own.append(None)
                state = following
            own[state] = (len(piece), score)
        self.shorter = [0] * len(own)
        self.pieces_at: list[tuple] = [()] * len(own)
        level = list(self.after[0].values())
        for state in level:
            self.pieces_at[state] = (own[state],) if own[state] else ()
        while level:
            deeper = []
            for state in level:
                for char, child in self.after[state].items():
                    self.shorter[child] = self.step(self.shorter[state], char)
                    rest = self.pieces_at[self.shorter[child]]
                    self.pieces_at[child] = (own[child], *rest) if own[child] else rest
                    deeper.append(child)
            level = deeper

    def step(self, state: int, char: str) -> int:
        while True:
            following = self.after[state].get(char)
            if following is not None:
                return following
            if not state:
                return 0
            state = self.shorter[state]


@functools.lru_cache(maxsize=2)
def suffixes(path: str) -> Suffixes:
    return Suffixes(pieces(path)[0])


class Trie:
    """Pre-tokens met so far. A node holds its forward score and the state of the pieces that end there."""

    def __init__(self, path: str):
        scores, self.longest = pieces(path)
        self.single = {p for p in scores if len(p) == 1}
        self.suffixes = suffixes(path)
        self.known = Recent(KNOWN_WORDS)
        self._clear()

    def _clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.forward, self.state = [0], [0]

    def _best(self, path: list[int], state: int, char: str) -> int:
        """Forward score one character after `path`, the scores of the prefixes before it."""
        best, at = None, len(path)
        for length, score in self.suffixes.pieces_at[state]:
            total = path[at - length] + score
            if best is None or total > best:
                best = total
        if char not in self.single:
            n = len(char.encode())
            total = path[-1] + step(n * _BYTE_SCORE, n)
            best = total if best is None else max(best, total)
        return best

    def insert(self, word: str) -> int:
        """Token count of a pre-token; only nodes that are new are scored."""
        if len(word) > LONG_WORD:
            return self._long(word)
        if len(self.forward) > NODES:
            self._clear()
        children, forward, states = self.children, self.forward, self.state
        node, path = 0, [0]
        for char in word:
            child = children.get((node, char))
            if child is None:
                child = children[node, char] = len(forward)
                state = self.suffixes.step(states[node], char)
                states.append(state)
                forward.append(self._best(path, state, char))
            node = child
            path.append(forward[child])
        return count_of(path[-1])

    def _long(self, word: str) -> int:
        """The same scores without keeping the nodes; the path is cut to the longest piece."""
        state, path = 0, [0]
        for char in word:
            state = self.suffixes.step(state, char)
            path.append(self._best(path, state, char))
            if len(path) > 2 * LONG_WORD:
                del path[:-self.longest]
        return count_of(path[-1])

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        split = [x.split() for x in texts]
        fresh = self.known.missing(set().union(*split))
        self.known.update((w, self.insert(SPACE + w)) for w in sorted(fresh))
        get = self.known.__getitem__
        out = [(len(words), sum(map(get, words))) for words in split]
        self.known.forget(w for w in fresh if len(w) > LONG_WORD)
        return out


@functools.lru_cache(maxsize=1)
def _trie(path: str) -> Trie:
    """One per Python worker, so that the tasks it runs share it."""
    return Trie(path)


def count_tokens(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens), one row per document row.

    Null, empty and blank texts have no tokens. Repeated rows are counted one
    by one and alike; null ids are kept; an empty table gives no rows; other
    columns are ignored. Words are separated by Unicode white space.
    """
    path = vocabulary_path or vocabulary()

    def run(batches):
        trie = _trie(path)
        for batch in batches:
            texts, counts, at = strings(batch.column("text")), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= TEXT_AT_ONCE):
                    size += len(texts[to])
                    to += 1
                counts += trie.counts(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in counts], pa.int64()), pa.array([b for _, b in counts], pa.int64())],
                                             ["doc_id", "n_pretokens", "n_tokens"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
