"""Exact incremental BPE training over a bounded table of distinct words, and long merge lists on columns.

Counts of pairs are kept up to date, so a round costs what its merge touches. Results equal
one aggregation a round over the whole table (``bpe.Bpe`` runs that beyond the bound).
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import textops as T

Pair = tuple[str, str]
#: Words a task remembers before it starts anew.
MOST_SEEN = 500_000
#: Up to so many rounds are literal replacements in a string of marked tokens, one after another.
FEW_ROUNDS = 64
MARKS = re.compile("[\x01-\x03]")


def merge_tokens(tokens: list[str], left: str, right: str) -> list[str]:
    """Every leftmost pair merged, without overlaps."""
    out, i, last = [], 0, len(tokens) - 1
    while i <= last:
        if i < last and tokens[i] == left and tokens[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


class Symbols:
    """The tokens of all distinct words, one after another as numbers, in first-seen order of the words."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, weights: np.ndarray, names: list[str]):
        self.tokens, self.names = tokens.astype(np.int32), names
        self.number = {name: i for i, name in enumerate(names)}
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.weights = weights.astype(np.int64)

    @classmethod
    def of_tokens(cls, words: Iterable[tuple[list[str], int]]) -> "Symbols":
        words = list(words)
        names = sorted({t for tokens, _ in words for t in tokens})
        number = {t: i for i, t in enumerate(names)}
        flat = np.array([number[t] for tokens, _ in words for t in tokens], np.int64)
        return cls(flat, np.array([len(t) for t, _ in words], np.int64), np.array([n for _, n in words], np.int64), names)

    @classmethod
    def of_words(cls, words: list[str], counts: list[int], mode: str) -> "Symbols":
        """Code points or UTF-8 bytes of the words, each followed by the end-of-word token."""
        raw = ["".join(words)] if mode == "word" else [b"".join(w.encode() for w in words)]
        points = np.frombuffer(raw[0].encode("utf-32-le") if mode == "word" else raw[0], "<u4" if mode == "word" else "u1")
        sizes = np.array([len(w) if mode == "word" else len(w.encode()) for w in words], np.int64)
        values, numbers = np.unique(points, return_inverse=True)
        names = [chr(v) if mode == "word" else f"{v:02X}" for v in values.tolist()]
        ends = np.cumsum(sizes)
        flat = np.insert(numbers, ends, len(names)) if len(sizes) else numbers
        return cls(flat, sizes + 1, np.array(counts, np.int64), [*names, T.EOW])

    def pairs(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(key, weight) of the adjacent pairs, of all words or of those that ``inside`` marks by place."""
        at = np.arange(len(self.tokens) - 1) if inside is None else inside[inside < len(self.tokens) - 1]
        at = at[self.word[at] == self.word[at + 1]]
        return self.tokens[at].astype(np.int64) << 32 | self.tokens[at + 1], self.weights[self.word[at]]

    def places(self, left: int, right: int) -> np.ndarray:
        """Where the pair stands, overlaps included."""
        at = np.flatnonzero(self.tokens[:-1] == left)
        at = at[self.tokens[at + 1] == right]
        return at[self.word[at] == self.word[at + 1]]

    def merge(self, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge every leftmost pair; (keys, changes of their counts). Tokens of one spelling are one token."""
        at = self.places(left, right)
        if left == right and len(at) > 1:  # of a run of overlapping pairs every other one, from the left
            at = apart(at)
        words = np.unique(self.word[at])
        old, old_weight = self.pairs(places_of(self.word, words))
        name = self.names[left] + self.names[right]
        if name not in self.number:
            self.number[name] = len(self.names)
            self.names.append(name)
        self.tokens[at] = self.number[name]
        keep = np.ones(len(self.tokens), bool)
        keep[at + 1] = False
        self.tokens, self.word = self.tokens[keep], self.word[keep]
        new, new_weight = self.pairs(places_of(self.word, words))
        keys, of = np.unique(np.concatenate([old, new]), return_inverse=True)
        return keys, np.bincount(of, np.concatenate([-old_weight, new_weight]), len(keys)).round().astype(np.int64)


def apart(at: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places every other one, from the left."""
    heads = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    return at[(np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0]


def places_of(word: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Places of the words ``some`` in the rising array ``word``."""
    if len(some) > 1000:
        marked = np.zeros(int(word[-1]) + 1, bool)
        marked[some] = True
        return np.flatnonzero(marked[word])
    a, b = np.searchsorted(word, some), np.searchsorted(word, some, "right")
    sizes = b - a
    return np.arange(sizes.sum()) + np.repeat(a - (np.cumsum(sizes) - sizes), sizes)


class PairCounts:
    """Weighted counts of adjacent pairs, kept up to date from round to round."""

    def __init__(self, symbols: Symbols):
        self.symbols = symbols
        keys, weights = symbols.pairs()
        keys, of = np.unique(keys, return_inverse=True)
        counts = np.bincount(of, weights, len(keys)).round().astype(np.int64)
        self.count: dict[int, int] = dict(zip(keys.tolist(), counts.tolist()))
        self.tied: dict[int, set[int]] = defaultdict(set)
        for key, c in self.count.items():
            self.tied[c].add(key)
        self.heap = [-c for c in self.tied]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, int] | None:
        """The commonest pair's key and its count; ties go to the earliest word, then the earliest place in it."""
        while self.heap and not self.tied.get(-self.heap[0]):
            self.tied.pop(-heapq.heappop(self.heap), None)
        if not self.heap:
            return None
        top = -self.heap[0]
        return min(self.tied[top], key=self._first) if len(self.tied[top]) > 1 else next(iter(self.tied[top])), top

    def _first(self, key: int) -> int:
        return int(self.symbols.places(key >> 32, key & 0xFFFFFFFF)[0])

    def merge(self, key: int) -> None:
        """Merge a pair in every word that holds it."""
        keys, changes = self.symbols.merge(key >> 32, key & 0xFFFFFFFF)
        for k, by in zip(keys.tolist(), changes.tolist()):
            if by:
                old = self.count.pop(k, 0)
                self.tied[old].discard(k)
                if new := old + by:
                    if new not in self.tied:
                        heapq.heappush(self.heap, -new)
                    self.tied[new].add(k)
                    self.count[k] = new


def learn(symbols: Symbols | Iterable[tuple[list[str], int]], rounds: int, min_freq: int, last=lambda left, right: False) -> list[tuple[Pair, int]]:
    """(pair, count) of every round, up to one of which ``last`` is true."""
    symbols = symbols if isinstance(symbols, Symbols) else Symbols.of_tokens(symbols)
    state, out = PairCounts(symbols), []
    while len(out) < rounds and (top := state.best()) and top[1] >= min_freq:
        key, count = top
        out.append(((symbols.names[key >> 32], symbols.names[key & 0xFFFFFFFF]), count))
        if last(*out[-1][0]):
            break
        state.merge(key)
    return out


def apply_rounds(tokens: list[str], ranks: dict[Pair, list[int]]) -> list[str]:
    """One pass over all rounds in order: always the lowest round after the last one that has a pair here."""
    at = -1
    while len(tokens) > 1:
        best = None
        for pair in zip(tokens, tokens[1:]):
            if (places := ranks.get(pair)) and (i := bisect_right(places, at)) < len(places) and (best is None or places[i] < best[0]):
                best = places[i], pair
        if best is None:
            break
        at = best[0]
        tokens = merge_tokens(tokens, *best[1])
    return tokens


def ranks_of(rounds: Iterable[Pair]) -> dict[Pair, list[int]]:
    """The rounds of every pair."""
    ranks: dict[Pair, list[int]] = {}
    for n, pair in enumerate(rounds):
        ranks.setdefault(tuple(pair), []).append(n)
    return ranks


def symbols_of(word: str, mode: str) -> list[str]:
    """A word's code points, or its bytes in hexadecimal, and the end-of-word token."""
    return [*(list(word) if mode == "word" else [f"{b:02X}" for b in word.encode()]), T.EOW]


class Remembered(dict):
    """Word -> ``work`` of it; words met before are remembered, up to a bound."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, word: str):
        if len(self) >= MOST_SEEN:
            self.clear()
        found = self[word] = self.work(word)
        return found


def segmenter(rounds: list[Pair], mode: str):
    """A function from a word to its tokens: all rounds in order, by literal replacement if they are few."""
    ranks = ranks_of(rounds)
    if len(rounds) > FEW_ROUNDS:
        return lambda word: apply_rounds(symbols_of(word, mode), ranks)
    part = T.CLOSE + T.OPEN
    rules = [(f"{T.OPEN}{left}{part}{right}{T.CLOSE}", f"{T.OPEN}{left}{right}{T.CLOSE}") for left, right in rounds if not MARKS.search(left + right)]

    def segment(word: str) -> list[str]:
        symbols = symbols_of(word, mode)
        if MARKS.search(word):
            return apply_rounds(symbols, ranks)
        s = f"{T.OPEN}{part.join(symbols)}{T.CLOSE}"
        for old, new in rules:
            s = s.replace(old, new)
        return s[1:-1].split(part)

    return segment


def encoder(rounds: list[Pair], ids: dict[str, int], mode: str):
    """A function from a column of texts to one of all their words' ids (0: unknown)."""
    segment = segmenter(rounds, mode)
    seen = Remembered(lambda word: array("i", [ids.get(t, 0) for t in segment(word)]).tobytes())
    word = re.compile(T.WORD)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else b"".join(map(seen.__getitem__, word.findall(t))) for t in (t.as_py() for t in texts)]
        edge = np.concatenate([[0], np.cumsum([len(r) // 4 if r else 0 for r in rows])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(filter(None, rows)), np.int32))
        return pa.ListArray.from_arrays(pa.array(edge), values, mask=pa.array([r is None for r in rows], pa.bool_()))

    return run


def tokenizer(rounds: list[Pair], mode: str):
    """A function from a column of words to one of each word's tokens."""
    seen = Remembered(segmenter(rounds, mode))

    @F.pandas_udf("array<array<string>>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if words is None else [seen[w] for w in words] for words in lists], dtype=object)

    return run


def speller(tokens: dict[int, str]):
    """A function from a column of ids to one of tokens; an unknown id raises."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        def one(ids):
            try:
                return [tokens[i] for i in ids]
            except KeyError as unknown:
                raise ValueError(f"unknown id {unknown}") from None

        return pd.Series([None if ids is None else one(ids) for ids in lists], dtype=object)

    return run


def merged_by(s: Column, rounds: list[Pair]) -> Column:
    """A long list of merges on wrapped tokens; an expression of one call a merge would grow too deep."""
    ranks = ranks_of((T.escaped(left), T.escaped(right)) for left, right in rounds)

    @F.pandas_udf("string")
    def run(wrapped: pd.Series) -> pd.Series:
        def one(w):
            if not w:
                return w
            return T.OPEN + f"{T.CLOSE}{T.OPEN}".join(apply_rounds(w[1:-1].split(T.CLOSE + T.OPEN), ranks)) + T.CLOSE

        return wrapped.map(one)

    return run(s)
