"""Byte-level BPE encoding and decoding over public rank files.

Pre-tokenisation runs without a regular expression. Every code point has a class;
what a pattern would look ahead for (contractions after an apostrophe, the last
space of a run) is folded into the class by comparing shifted arrays. The
boundaries are then those of a finite automaton, whose transition functions are
composed block by block (composition is associative), so all blocks advance
together. Slices between boundaries are merged by rank once and then cached.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.bytesets import blocks, flat

# Classes of characters, after looking ahead.
LETTER, DIGIT, OTHER, QUOTE2, QUOTE3, SPACE_LAST, WHITE_LAST, WHITE_IN = range(8)
# States: what the current token is.
DONE, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES, CLASSES, STEP = 8, 8, 64

#: The White_Space property of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after an apostrophe that make a token with it.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def code_classes() -> np.ndarray:
    """Class of each code point before looking ahead.

    Python's Unicode tables can be older than the encoder's: the classes of code points that
    Python calls unassigned are asked of the tiktoken library, where it is installed.
    """
    kinds = [unicodedata.category(chr(point)) for point in range(0x110000)]
    table = np.array([LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER for kind in kinds], np.uint8)
    try:
        import tiktoken
    except ImportError:
        pass
    else:
        odd = [point for point, kind in enumerate(kinds) if kind == "Cn"]
        for follower, kind in (("a", LETTER), ("1", DIGIT)):
            ranks = {bytes([i]): i for i in range(256)} | {bytes([i]) + follower.encode(): 128 + i for i in range(128, 192)}
            names = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
            ids = np.array(names.encode_ordinary("".join(chr(point) + follower + "!" for point in odd)))
            breaks = np.flatnonzero(ids == ord("!"))
            joined = ids[breaks - 1] >= 256
            table[np.array(odd)[joined]] = kind
    table[WHITE] = WHITE_IN
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, is a boundary before) by class * STATES + state; the second half of the classes begins a text."""
    go, cut = np.zeros((2 * CLASSES, STATES), np.uint8), np.ones((2 * CLASSES, STATES), bool)
    go[LETTER] = IN_LETTERS
    go[LETTER, ONE_LEFT], go[LETTER, TWO_LEFT] = DONE, ONE_LEFT
    cut[LETTER, [IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT]] = False
    go[DIGIT] = IN_DIGITS
    cut[DIGIT, [IN_DIGITS, AFTER_SPACE]] = False
    for kind, opened in ((OTHER, IN_OTHER), (QUOTE2, ONE_LEFT), (QUOTE3, TWO_LEFT)):
        go[kind] = opened
        go[kind, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        cut[kind, [IN_OTHER, AFTER_SPACE]] = False
    go[SPACE_LAST], go[WHITE_LAST], go[WHITE_IN] = AFTER_SPACE, DONE, IN_WHITE
    cut[WHITE_IN, IN_WHITE] = False
    go[CLASSES:] = go[:CLASSES, [DONE]]
    return go.ravel(), cut.ravel()


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    point = lead.astype(np.int32)
    if len(at) == len(data):
        return at, point
    wide = np.flatnonzero(lead >= 0xC0)
    first, lead = at[wide], lead[wide]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead.astype(np.int32) & (0x7F >> size)
    for k in (1, 2, 3):
        more = size > k
        value[more] = value[more] << 6 | (data[first[more] + k] & 0x3F)
    point[wide] = value
    return at, point


def look_ahead(point: np.ndarray, new: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes with what follows folded in; new: where a text begins."""
    n = len(point)
    kind = classes[point]
    ends = np.ones(n, bool)  # the text ends after this character
    ends[:-1] = new[1:]
    white = kind == WHITE_IN
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~ends[:-1]
    kind[last] = np.where(point[last] == 0x20, SPACE_LAST, WHITE_LAST)
    quote = np.flatnonzero((point == 0x27) & ~ends)
    if len(quote):
        second = point[quote + 1]
        kind[quote[np.isin(second, [ord(c) for c in SHORT])]] = QUOTE2
        room = quote[(quote + 2 < n) & ~ends[np.minimum(quote + 1, n - 1)]]
        for pair in LONG:
            kind[room[(point[room + 1] == ord(pair[0])) & (point[room + 2] == ord(pair[1]))]] = QUOTE3
    kind[new] += CLASSES
    return kind


def cuts(kind: np.ndarray) -> np.ndarray:
    """Mask of the characters that begin a token, by composing transition functions over blocks."""
    go, cut = automaton()
    n = len(kind)
    rows = -(-n // STEP)
    grid = np.zeros(rows * STEP, np.int16)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(rows, STEP).T) * STATES
    reach = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for codes in grid:
        reach = go[codes[:, None] + reach]
    gap = 1  # inclusive scan of the blocks' functions
    while gap < rows:
        reach[gap:] = np.take_along_axis(reach[gap:], reach[:-gap].astype(np.int64), 1)
        gap *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = reach[:-1, DONE]
    out = np.empty((STEP, rows), bool)
    for i, codes in enumerate(grid):
        key = codes + state
        out[i] = cut[key]
        state = go[key]
    return out.T.ravel()[:n]


def boundaries(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which tokens begin, then the end; data holds whole texts."""
    if not len(data):
        return np.zeros(1, np.int64)
    at, point = characters(data)
    new = np.zeros(len(data), bool)
    begin = offsets[:-1]
    new[begin[begin < offsets[1:]]] = True
    starts = at[cuts(look_ahead(point, new[at], classes))]
    return np.append(starts, len(data))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token, space, rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def vocabulary(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """What the driver reads once and broadcasts, about 3 MB: ranks and code point classes."""
    return read_ranks(path), code_classes()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: join the adjacent pair of least rank, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked neighbours, for slices of any length."""
    import heapq

    n = len(parts)
    token: list[bytes | None] = list(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if token[i] is None or (j := after[i]) >= n or token[i] + token[j] != joined:
            continue
        token[i], token[j] = joined, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(token[a] + token[b])) is not None:
                heapq.heappush(heap, (r, a, token[a] + token[b]))
    return [ranks[t] for t in token if t is not None]


class Slices(dict):
    """Slice -> its ids as little-endian 32-bit integers; forgets all when it holds too many."""

    limit = 400_000

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_caches: dict[str, Slices] = {}


def slices_of(path: str, ranks: dict[bytes, int]) -> Slices:
    """The cache of this Python worker, which later tasks find filled."""
    if path not in _caches:
        _caches[path] = Slices(ranks)
    return _caches[path]


class Codec:
    """Encoder and decoder of one rank file; vocabulary: what ``vocabulary()`` read."""

    def __init__(self, path: str, vocabulary: tuple[dict[bytes, int], np.ndarray]):
        ranks, self.classes = vocabulary
        self.cache = slices_of(path, ranks)
        self.tokens = {i: t for t, i in ranks.items()}

    def encode(self, column) -> Iterator[tuple[int, bytes, bytes, list[int]]]:
        """(row, text, ids as bytes, slice lengths in ids) of each row."""
        data, offsets = flat(column)
        get = self.cache.__getitem__
        for row, end in blocks(offsets):
            part = data[offsets[row] : offsets[end]]
            own = offsets[row : end + 1] - offsets[row]
            raw, marks = part.tobytes(), boundaries(part, own, self.classes)
            firsts = np.searchsorted(marks, own).tolist()
            marks = marks.tolist()
            for k in range(end - row):
                a, b = firsts[k], firsts[k + 1]
                ids = [get(raw[i:j]) for i, j in zip(marks[a:b], marks[a + 1 : b + 1])]
                yield row + k, raw[own[k] : own[k + 1]], b"".join(ids), ids

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids; an unknown id raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset at which each id's bytes begin, then the length."""
        tokens = self.tokens
        sizes = [len(tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, ids (array of int), offsets (byte offset of each id, then the length).

    A null text encodes as an empty one, to no ids. Repeated rows and null keys stay as they
    are; other columns aren't read. No special token is ever made.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        codec = Codec(path, known.value)
        for batch in batches:
            ids, offsets = [], []
            for _, _, out, _ in codec.encode(batch.column(1)):
                ids.append(np.frombuffer(out, "<u4").astype(np.int32))
                offsets.append(codec.offsets(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Return doc_id and bytes of (doc_id, ids). Null ids decode to nothing; an unknown id raises."""
    known = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        codec = Codec(path, known.value)
        for batch in batches:
            out = [codec.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids; return digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers),
    decoded_sha256 (of the decoded bytes), n_bytes. Null texts count as empty; rows stay one to
    one, repeated rows and null keys too.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        codec = Codec(path, known.value)
        for batch in batches:
            counts, ids_sha, text_sha, sizes = [], [], [], []
            for _, _, ids, _ in codec.encode(batch.column(1)):
                back = codec.decode(ids)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                sizes.append(len(back))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
