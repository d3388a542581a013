"""Exact BPE training over any number of distinct words: the driver learns from pieces of them.

A pair of tokens that merges later meets at a place between two tokens of today, always the same
two, so it is counted as often as they are at most. So where a pair of today is counted less than
``least`` times, nothing merges as long as the commonest pair is counted ``least`` times. Words
are cut at such places on the executors, equal pieces are counted as one, and the driver learns
from the pieces until the commonest pair falls below ``least``, or a token is spelled by tokens of
today that end or begin otherwise (``Ends``). Then the words take over the merges, and it begins
again, with a smaller ``least``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.functions import textops as T
from lexloom.operators import merge_loop

#: Numbers: code points or bytes, the end of a word, then merged tokens.
END = 0x110000


class Names:
    """Numbers of tokens; tokens of one spelling are one."""

    def __init__(self, mode: str):
        self.mode, self.merged, self.number = mode, [], {T.EOW: END}

    def of(self, number: int) -> str:
        if number > END:
            return self.merged[number - END - 1]
        return T.EOW if number == END else chr(number) if self.mode == "word" else f"{number:02X}"

    def find(self, name: str) -> int:
        if name in self.number:
            return self.number[name]
        return ord(name) if self.mode == "word" else int(name, 16)

    def step(self, left: str, right: str) -> tuple[int, int, int]:
        """(left, right, merged) as numbers; a new token gets the next one."""
        pair, name = (self.find(left), self.find(right)), left + right
        if name not in self.number:
            self.merged.append(name)
            self.number[name] = END + len(self.merged)
        return *pair, self.number[name]


def binary(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of numbers as one binary value each."""
    edge = np.concatenate([[0], np.cumsum(sizes * 4)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(tokens.astype("<i4").tobytes())])


def numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """(numbers one after another, how many of each value)."""
    edge = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", "<i4", (edge[-1] - edge[0]) // 4, edge[0]), np.diff(edge) // 4


def begin(counts: DataFrame, mode: str) -> DataFrame:
    """(doc, pos, cnt, tokens) of (word, cnt, doc, pos)."""

    def run(batches):
        for batch in batches:
            words = batch.column(3).to_pylist()
            if mode == "word":
                flat, sizes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), [len(w) for w in words]
            else:
                raw = [w.encode() for w in words]
                flat, sizes = np.frombuffer(b"".join(raw), "u1"), [len(w) for w in raw]
            sizes = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), binary(np.insert(flat.astype(np.int32), np.cumsum(sizes), END), sizes + 1)], ["doc", "pos", "cnt", "tokens"])

    given = counts.select("doc", "pos", "cnt", "word")
    return given.mapInArrow(run, f"doc {given.schema['doc'].dataType.simpleString()}, pos int, cnt bigint, tokens binary")


def advance(state: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """The words after these merges."""

    def run(batches):
        for batch in batches:
            tokens, sizes = numbers(batch.column(3))
            tokens, word = tokens.copy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            present = set(np.unique(tokens).tolist())
            for left, right, new in steps:
                if left not in present or right not in present:
                    continue
                at = np.flatnonzero(tokens[:-1] == left)
                at = at[(tokens[at + 1] == right) & (word[at] == word[at + 1])]
                if len(at):
                    at = merge_loop.apart(at) if left == right else at
                    tokens[at] = new
                    keep = np.ones(len(tokens), bool)
                    keep[at + 1] = False
                    tokens, word = tokens[keep], word[keep]
                    present.add(new)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), binary(tokens, np.bincount(word, minlength=len(sizes)))], ["doc", "pos", "cnt", "tokens"])

    return state.mapInArrow(run, state.schema)


def adjacent(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of each token, which tokens have a neighbour on the right in their word, key of each of these pairs)."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.flatnonzero(word[:-1] == word[1:])
    return word, inner, tokens[inner].astype(np.int64) << 32 | tokens[inner + 1]


def pairs(state: DataFrame) -> DataFrame:
    """(key, weight): adjacent pairs, counted."""

    def run(batches):
        for batch in batches:
            word, inner, keys = adjacent(*numbers(batch.column(1)))
            keys, of = np.unique(keys, return_inverse=True)
            weights = np.bincount(of, batch.column(0).to_numpy()[word[inner]], len(keys)).round().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(weights)], ["key", "weight"])

    return state.select("cnt", "tokens").mapInArrow(run, "key bigint, weight bigint").groupBy("key").sum("weight").toDF("key", "weight")


def pieces(state: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc, pos, cnt, piece, place): words cut between pairs that aren't ``hot`` (rising keys), without pieces of one token."""
    sent = state.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot = sent.value
        for batch in batches:
            tokens, sizes = numbers(batch.column(3))
            word, inner, keys = adjacent(tokens, sizes)
            at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            opens = np.ones(len(tokens), bool)
            opens[inner[hot[at] == keys] + 1] = False
            heads = np.flatnonzero(opens)
            long = np.diff(np.append(heads, len(tokens)))
            some = long > 1
            of = word[heads[some]]
            place = heads[some] - (np.cumsum(sizes) - sizes)[of]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in range(3)), binary(tokens[np.repeat(some, long)], long[some]), pa.array(place.astype(np.int32))], ["doc", "pos", "cnt", "piece", "place"])

    return state.mapInArrow(run, f"doc {state.schema['doc'].dataType.simpleString()}, pos int, cnt bigint, piece binary, place int")


def symbols(table: pa.Table, names: Names) -> merge_loop.Symbols:
    """The pieces of (piece, cnt, doc, pos, place) in the order of their first places."""
    table = table.sort_by([(c, "ascending") for c in ("doc", "pos", "place")]).select(["piece", "cnt"]).combine_chunks()
    column = table.column("piece")
    tokens, sizes = numbers(column.chunk(0)) if column.num_chunks else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    values, flat = np.unique(tokens, return_inverse=True)
    return merge_loop.Symbols(flat, sizes, table.column("cnt").to_numpy(), [names.of(v) for v in values.tolist()])


class Ends:
    """The first and the last token of today in each token that merges make.

    Called with a merge, it says whether that gives one spelling two firsts or two lasts, after
    which a pair's count may be more than that of any one place of today.
    """

    def __init__(self, today: list[str]):
        self.today, self.of = set(today), {}

    def __call__(self, left: str, right: str) -> bool:
        ends = self.of.get(left, (left,))[0], self.of.get(right, (right, right))[1]
        name = left + right
        known = self.of.setdefault(name, (name, name) if name in self.today else ends)
        return known != ends
