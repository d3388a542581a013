"""Arrow text columns as flat byte arrays, cut into words and hashed by prefix polynomials.

Everything here is vectorised over a run of whole documents: ``data`` holds the
UTF-8 bytes of all of them, ``offsets`` the places where each begins and ends.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
BLOCK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of whole documents with at most ``size`` bytes, or one document."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words ``[^\\x20\\x09-\\x0D]+``; first[d] is the number of words before document d."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


#: The prime of the prefix hashes, and masks of its lower halves.
P61, M32, M31, M30 = U((1 << 61) - 1), U((1 << 32) - 1), U((1 << 31) - 1), U((1 << 30) - 1)
#: Items whose products are summed up before they are reduced.
SEGMENT = 1 << 16


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit value modulo P61."""
    x = (x & P61) + (x >> U(61))
    return np.minimum(x, x - P61)  # what is below the prime wraps round


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo P61 of values below it, by halves."""
    ah, al, bh, bl = a >> U(31), a & M31, b >> U(31), b & M31
    middle = al * bh + ah * bl
    return reduced((ah * bh << U(1)) + (middle >> U(30)) + ((middle & M30) << U(31)) + al * bl)


class Prefix:
    """Prefix polynomial hashes of a sequence modulo the prime 2**61 - 1: any range's hash in constant time.

    Two different ranges of n items collide with a chance of n / 2**61 in the choice of the base.
    (Modulo 2**64 structured strings collide under every base: see Rolling.)
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, salt: int = 0):
        n = len(values)
        self.up, self.down = up, _ = self.powers(salt, n + 1)
        small = values.dtype == np.uint8
        self.sums = np.zeros(n + 1, np.uint64)
        last = U(0)
        for a in range(0, n, SEGMENT):
            b = min(n, a + SEGMENT)
            if small:
                v = values[a:b].astype(np.uint64) + U(1)
                low, high = v * (up[a:b] & M32), v * (up[a:b] >> U(32))
            else:
                v = times(reduced(mix(values[a:b] + U(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1))), up[a:b])
                low, high = v & M32, v >> U(32)
            low, high = np.cumsum(low, out=low), np.cumsum(high, out=high)
            self.sums[a + 1 : b + 1] = reduced(((high << U(32)) & P61) + (high >> U(29)) + low + last)
            last = self.sums[b]

    @classmethod
    def powers(cls, salt: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(salt)
        if have is None or len(have[0]) < n:
            prime = int(P61)
            base = random.Random(f"base {salt}").randrange(1 << 60, prime)
            have = []
            for step in (base, pow(base, -1, prime)):
                row = np.ones(1, np.uint64)
                while len(row) < max(n, 1 << 12):
                    row = np.concatenate([row, times(row, np.full(len(row), pow(step, len(row), prime), np.uint64))])
                have.append(row)
            cls._powers[salt] = have = tuple(have)
        return have

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) for each pair."""
        out = self.sums[ends] + (P61 - self.sums[starts])
        return mix(times(np.minimum(out, out - P61), self.down[starts]))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all ranges of one length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for a in range(0, n, SEGMENT):
            b = min(n, a + SEGMENT)
            part = self.sums[a + length : b + length] + (P61 - self.sums[a:b])
            out[a:b] = mix(times(np.minimum(part, part - P61), self.down[a:b]))
        return out


class Rolling:
    """Cheap prefix polynomial hashes modulo 2**64, where equal ranges have to agree and others may.

    Strings built like the Thue-Morse sequence collide under every base, so nothing may rest on
    two ranges being equal because their hashes are; whoever compares them checks the items too.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    _tables: dict[int, np.ndarray] = {}

    def __init__(self, values: np.ndarray, salt: int = 0):
        up, self.down = self.powers(salt, len(values) + 1)
        if values.dtype == np.uint8:
            if salt not in self._tables:
                self._tables[salt] = np.random.default_rng(1000 + salt).integers(1, 1 << 63, 256, dtype=np.uint64)
            values = self._tables[salt][values]
        else:
            values = mix(values + U(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1))
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    @classmethod
    def powers(cls, salt: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(salt)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 12)
            base = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5, 0x2545F4914F6CDD1D)[salt]
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                have = np.cumprod(up), np.cumprod(down)
            cls._powers[salt] = have
        return have

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) for each pair."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all ranges of one length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    if width == 1:
        return x
    pad = -len(x) % width
    grid = np.concatenate([x, np.full(pad, x[-1], x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of the n places covered by some [start, start + length)."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + lengths, n), minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lead = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - lead, lengths)
