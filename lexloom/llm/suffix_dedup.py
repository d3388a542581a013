"""Suffix-array dedup of byte substrings, by a suffix sort that compares through hashes.

Starts of equal ``length``-byte strings have equal window minima (see windows.py), so
only starts whose minimum occurs twice in the corpus can repeat. Those are brought
together by their minimum, as runs of neighbouring starts with the bytes they need.
Runs with equal bytes settle at once. The rest are suffix sorted in each group: a
mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes; neighbours in the sorted order that share ``length``
bytes are repeats. Neighbours are always compared by their bytes, so a collision of hashes
can neither make a repeat nor hide one.

A minimum that occurs over HOT times would bring a group that grows with the corpus, so its
starts are dealt by hashes of their own strings. Equal ones are verified on the bytes within
a chunk; between chunks two hashes modulo 2**61 - 1 under different bases decide (a chance of about
(length / 2**61)**2 for each pair of different strings).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.bytesets import Prefix, Rolling, blocks, expand
from lexloom.llm.staging import parts_for
from lexloom.llm.windows import NONE, Chunk, blob_rows, chosen, deal, joined, minima, split_by

#: Bytes of input (as stored) in a chunk.
CHUNK = 4 << 20
#: Bytes of a gram whose hash can be a window's minimum.
GRAM = 48
#: Starts in a run at most; a longer one (periodic text) is cut.
RUN = 4096
#: Starts with a minimum that occurs more often are dealt by hashes of their own strings.
HOT = 1000

KEYS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())])
RUNS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("twice", pa.binary()), ("bytes", pa.binary()), ("first", pa.binary()), ("second", pa.binary()), ("start", pa.binary()), ("done_at", pa.binary()), ("done_n", pa.binary())])
FOUND = pa.schema([("chunk", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])


def unique_counts(values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorting order, heads of equal groups in it, their sizes)."""
    order = np.lexsort([*more[::-1], values])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = values[order][1:] == values[order][:-1]
        for column in more:
            new[1:] &= column[order][1:] == column[order][:-1]
        new[1:] = ~new[1:]
        new[0] = True
    heads = np.flatnonzero(new)
    return order, heads, np.diff(np.append(heads, len(order)))


def common(hashes: Rolling, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, up to ``limit``: binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    sums, down = hashes.sums, hashes.down
    base_a, base_b, down_a, down_b = sums[a], sums[b], down[a], down[b]
    while True:
        middle = (low + high + 1) >> 1
        same = (sums[a + middle] - base_a) * down_a == (sums[b + middle] - base_b) * down_b
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        if not (low < high).any():
            return low


class SuffixSort:
    """Sorts the suffixes at ``at`` of ``data`` inside each segment, as far as ``length`` bytes.

    The hashes may collide on structured strings, so neighbours of the sorted order are compared
    byte by byte; a segment where one of them stands wrong is sorted again by its bytes.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, segment: np.ndarray, length: int):
        self.data, self.at, self.length = data, at, length
        self.hashes = Rolling(data, 0)
        lead = np.zeros(len(at), np.uint64)
        for k in range(8):
            lead = lead << np.uint64(8) | data[at + k].astype(np.uint64)
        self.lead = lead
        self.order = self._sort(segment)
        self.shared, wrong = self._neighbours(segment)
        if wrong.any():
            for k in np.unique(segment[self.order[:-1][wrong]]):
                inside = np.flatnonzero(segment[self.order] == k)
                suffix = lambda i: data[at[i] : at[i] + length].tobytes()
                self.order[inside] = sorted(self.order[inside].tolist(), key=suffix)
            self.shared, _ = self._neighbours(segment)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; both share their leading bytes."""
        a, b = self.at[i], self.at[j]
        n = common(self.hashes, a, b, self.length)
        return (n < self.length) & (self.data[a + n] < self.data[b + n])

    def _sort(self, segment: np.ndarray) -> np.ndarray:
        """Deal by the leading eight bytes, then mergesort all ties at once, bottom up.

        In each round an element moves by its rank in the sibling run, found by binary search.
        """
        n = len(segment)
        order = np.lexsort([self.lead, segment])
        if not n:
            return order
        new = np.ones(n, bool)
        new[1:] = (segment[order[1:]] != segment[order[:-1]]) | (self.lead[order[1:]] != self.lead[order[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        ties = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places that aren't settled yet
        if not len(ties):
            return order
        sizes = sizes[sizes > 1]
        sub = order[ties]
        edge = np.cumsum(sizes)
        begin, stop = np.repeat(edge - sizes, sizes), np.repeat(edge, sizes)
        place, longest, width = np.arange(len(sub)), int(sizes.max()), 1
        while width < longest:
            local = place - begin
            block = local // width
            right = (block & 1).astype(bool)
            own = begin + block * width
            other = np.where(right, own - width, own + width)
            low = np.minimum(other, stop)
            high = np.minimum(low + width, stop)
            first = low.copy()
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) >> 1
                mine, theirs = sub[live], sub[middle]
                goes = np.where(right[live], ~self.less(mine, theirs), self.less(theirs, mine))
                low[live] = np.where(goes, middle + 1, low[live])
                high[live] = np.where(goes, high[live], middle)
                live = live[low[live] < high[live]]
            target = np.where(right, first, own) + (place - own) + (low - first)
            moved = np.empty_like(sub)
            moved[target] = sub
            sub, width = moved, width * 2
        order[ties] = sub
        return order

    def _neighbours(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the first ``length`` bytes are shared, whether the two stand wrong) of each suffix and the next, by their bytes."""
        shared, wrong = np.zeros(max(0, len(self.order) - 1), bool), np.zeros(max(0, len(self.order) - 1), bool)
        near = np.flatnonzero(segment[self.order[:-1]] == segment[self.order[1:]])
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length) if len(self.data) >= self.length else self.data.reshape(0, 1)
        for k in range(0, len(near), 4096):
            part = near[k : k + 4096]
            a, b = rows[self.at[self.order[part]]], rows[self.at[self.order[part + 1]]]
            differ = a != b
            place = differ.argmax(1)
            line = np.arange(len(part))
            same = ~differ[line, place]
            shared[part] = same
            wrong[part] = ~same & (a[line, place] > b[line, place])
        return shared, wrong

    def repeats(self, segment: np.ndarray) -> np.ndarray:
        """Mask of the suffixes whose first ``length`` bytes another suffix of the segment also has."""
        out = np.zeros(len(self.at), bool)
        out[self.order[:-1][self.shared]] = True
        out[self.order[1:][self.shared]] = True
        return out


def runs_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of starts) of the runs of starts with one minimum, cut at RUN."""
    heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(least)))
    real = least[heads] != NONE
    heads, sizes = heads[real], sizes[real]
    if len(sizes) and sizes.max() > RUN:
        pieces = -(-sizes // RUN)
        ends = np.repeat(heads + sizes, pieces)
        heads = np.repeat(heads, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        sizes = np.minimum(ends - heads, RUN)
    return heads, sizes


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n], for each pair."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 4096):
        size = n[k : k + 4096]
        if size.sum():
            equal = data[expand(a[k : k + 4096], size)] == data[expand(b[k : k + 4096], size)]
            out[k : k + 4096] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return out


def settle(data: np.ndarray, keys: np.ndarray, offset: np.ndarray, n: np.ndarray, twice: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(run, repeated starts in it) for runs gathered by key; runs flagged ``twice`` repeat where they come from."""
    sizes = n + length - 1
    prints = [np.empty(len(keys), np.uint64) for _ in range(2)]
    borders = np.append(offset, len(data))
    for row, end in blocks(borders):
        part = data[borders[row] : borders[end]]
        for salt in range(2):
            prints[salt][row:end] = Rolling(part, salt).ranges(offset[row:end] - borders[row], offset[row:end] - borders[row] + sizes[row:end])
    order, heads, counts = unique_counts(keys, n, *prints)
    a = np.delete(np.arange(len(order)), heads) if len(order) else order
    if len(a):
        good = same_bytes(data, offset[order[a - 1]], offset[order[a]], sizes[order[a]])
        if not good.all():  # a collision: the run stands alone
            heads = np.sort(np.append(heads, a[~good]))
            counts = np.diff(np.append(heads, len(order)))
    label = np.repeat(np.arange(len(heads)), counts)
    whole = (counts > 1) | (np.bincount(label, twice[order], len(heads)) > 0)
    out = [(int(r), np.arange(n[r])) for r in order[whole[label]] if not twice[r]]
    chief = order[heads]
    open_keys = np.unique(keys[chief[~whole]])
    sort_in = chief[np.isin(keys[chief], open_keys)]
    open_run = np.zeros(len(keys), bool)
    open_run[chief[~whole]] = True
    # whole groups of a key, as many as fit a block
    where = np.append(np.cumsum(sizes[sort_in]) - sizes[sort_in], sizes[sort_in].sum())
    heads_of = np.append(np.flatnonzero(np.concatenate([[True], keys[sort_in][1:] != keys[sort_in][:-1]])), len(sort_in)) if len(sort_in) else np.zeros(1, int)
    for g0, g1 in blocks(where[heads_of], 1 << 19) if len(sort_in) else []:
        mine = sort_in[heads_of[g0] : heads_of[g1]]
        text = np.append(data[expand(offset[mine], sizes[mine])], np.zeros(8, np.uint8))
        own = np.cumsum(sizes[mine]) - sizes[mine]
        at = expand(own, n[mine])
        run = np.repeat(mine, n[mine])
        hit = SuffixSort(text, at, keys[run], length).repeats(keys[run]) & open_run[run]
        local = at - np.repeat(own, n[mine])
        for r, places in split_by(run[hit]):
            out.append((r, local[hit][places]))
    return out


def to_ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, how many) of the maximal ranges of sorted, distinct integers."""
    if not len(starts):
        return starts, starts
    heads = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return starts[heads], np.diff(np.append(heads, len(starts)))


def remove_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of what is
    left) and, on request, kept (those bytes). Strings never cross documents and are judged on
    the input; overlaps count, the same document included. Null texts count as empty, short
    texts come back whole, repeated rows remove each other, other columns aren't read.
    """
    parts = parts_for(docs, CHUNK)
    dealt = deal(docs, parts, key, text)
    span = length - GRAM + 1
    bucket_of = lambda keys: ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)

    def parts_of(data, offsets):
        for row, end in blocks(offsets):
            part, own = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            yield offsets[row], part, *minima(part, own, length, GRAM)

    def list_keys(key_row, table):
        chunk, keys = Chunk(table), []
        for _, _, grams, least in parts_of(chunk.data, chunk.offsets):
            keys.append(grams[chosen(grams, least, span)])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        keys, counts = np.unique(keys, return_counts=True)
        own = key_row[0].as_py()
        return blob_rows(KEYS, [(b, own, keys[w].tobytes(), np.minimum(counts[w], 65535).astype("<u2").tobytes()) for b, w in split_by(bucket_of(keys))])

    def answer(table):
        keys, n = joined(table.column("keys"), "<u8")
        times = joined(table.column("times"), "<u2")[0]
        chunks = np.repeat(table.column("chunk").to_numpy(), n)
        order, heads, counts = unique_counts(keys)
        label = np.empty(len(order), np.int64)
        label[order] = np.repeat(np.arange(len(heads)), counts)
        total = np.bincount(label, times, len(heads))
        again, hot = (total > 1)[label], (total > HOT)[label]
        return blob_rows(ANSWERS, [(c, keys[w[~hot[w]]].tobytes(), keys[w[hot[w]]].tobytes()) for c, w in split_by_mask(chunks, again)])

    def split_by_mask(values, mask):
        at = np.flatnonzero(mask)
        return [(v, at[w]) for v, w in split_by(values[at])]

    def list_runs(key_row, left, right):
        chunk = Chunk(left)
        known, hot = (np.sort(joined(right.column(c), "<u8")[0]) for c in ("keys", "hot"))
        member = lambda keys, some: some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)
        keys, at, n, p1, p2, hots = [], [], [], [], [], [[], [], []]
        for base, part, _, least in parts_of(chunk.data, chunk.offsets) if len(known) + len(hot) else ():
            heads, sizes = runs_of(least)
            own = least[heads]
            for k in (np.flatnonzero(member(own, hot)),):
                if len(k):
                    starts = expand(heads[k], sizes[k])
                    for column, salt in zip(hots, (0, 1)):
                        column.append(Prefix(part, salt).ranges(starts, starts + length))
                    hots[2].append(starts + base)
            k = np.flatnonzero(member(own, known))
            heads, sizes = heads[k], sizes[k]
            for column, salt in ((p1, 0), (p2, 1)):
                column.append(Rolling(part, salt).ranges(heads, heads + sizes + length - 1))
            keys.append(own[k])
            at.append(heads + base)
            n.append(sizes)
        own, rows = key_row[0].as_py(), []
        done_at, done_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if keys:
            keys, at, n, p1, p2 = (np.concatenate(c) for c in (keys, at, n, p1, p2))
            order, heads, counts = unique_counts(keys, n, p1, p2)
            follower = np.delete(np.arange(len(order)), heads) if len(order) else order
            if len(follower):  # equal here: one speaks for all, if the bytes agree
                good = same_bytes(chunk.data, at[order[follower - 1]], at[order[follower]], n[order[follower]] + length - 1)
                heads = np.sort(np.append(heads, follower[~good]))
                counts = np.diff(np.append(heads, len(order)))
            many = np.repeat(counts > 1, counts)
            done_at.append(at[order[many]])
            done_n.append(n[order[many]])
            chief, twice = order[heads], counts > 1
            for b, w in split_by(bucket_of(keys[chief])):
                r = chief[w]
                body = chunk.data[expand(at[r], n[r] + length - 1)].tobytes()
                rows.append((b, own, keys[r].tobytes(), at[r].astype("<i8").tobytes(), n[r].astype("<i4").tobytes(), twice[w].astype(np.uint8).tobytes(), body, None, None, None, None, None))
        if hots[0]:
            h1, h2, start = (np.concatenate(c) for c in hots)
            order, heads, counts = unique_counts(h1, h2)
            follower = np.delete(np.arange(len(order)), heads) if len(order) else order
            if len(follower):
                good = same_bytes(chunk.data, start[order[follower - 1]], start[order[follower]], np.full(len(follower), length))
                heads = np.sort(np.append(heads, follower[~good]))
                counts = np.diff(np.append(heads, len(order)))
            many = np.repeat(counts > 1, counts)
            done_at.append(start[order[many]])
            done_n.append(np.ones(many.sum(), np.int64))
            chief = order[heads]
            start = np.where(counts > 1, -1, start[chief])
            for b, w in split_by(bucket_of(h1[chief])):
                rows.append((b, own, None, None, None, None, None, h1[chief[w]].tobytes(), h2[chief[w]].tobytes(), start[w].astype("<i8").tobytes(), None, None))
        done_at, done_n = np.concatenate(done_at), np.concatenate(done_n)
        if len(done_at):
            rows.append((own % parts, own, *[None] * 8, done_at.astype("<i8").tobytes(), done_n.astype("<i4").tobytes()))
        return blob_rows(RUNS, rows)

    def sort_runs(table):
        chunks = table.column("chunk").to_numpy()
        keys, count = joined(table.column("keys"), "<u8")
        at, n, twice = (joined(table.column(c), d)[0].astype(np.int64) for c, d in (("at", "<i8"), ("n", "<i4"), ("twice", "u1")))
        data = joined(table.column("bytes"), "u1")[0]
        owner = np.repeat(chunks, count)
        offset = np.cumsum(n + length - 1) - (n + length - 1)
        out: dict[int, list] = {}
        for run, places in settle(data, keys, offset, n, twice, length):
            first, size = to_ranges(np.sort(places))
            out.setdefault(int(owner[run]), []).append((first + at[run], size))
        h1, count = joined(table.column("first"), "<u8")
        h2, start = joined(table.column("second"), "<u8")[0], joined(table.column("start"), "<i8")[0]
        order, heads, counts = unique_counts(h1, h2)
        hit = order[np.repeat(counts > 1, counts)]
        hit = hit[start[hit] >= 0]
        for c, w in split_by(np.repeat(chunks, count)[hit]):
            out.setdefault(c, []).append(to_ranges(np.sort(start[hit[w]])))
        rows = [(c, np.concatenate([a for a, _ in found]).astype("<i8").tobytes(), np.concatenate([k for _, k in found]).astype("<i4").tobytes()) for c, found in out.items()]
        rows += [x for x in zip(chunks.tolist(), table.column("done_at").to_pylist(), table.column("done_n").to_pylist()) if x[1]]
        return blob_rows(FOUND, rows)

    def finish(left, right):
        chunk = Chunk(left)
        at, n = joined(right.column("at"), "<i8")[0], joined(right.column("n"), "<i4")[0].astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, until = at[order], (at + n + length - 1)[order]
        removed, spans, kept = [], [], []
        for row, end in blocks(chunk.offsets):
            base, total = chunk.offsets[row], int(chunk.offsets[end] - chunk.offsets[row])
            part, own = chunk.data[base : base + total], chunk.offsets[row : end + 1] - base
            a, b = np.searchsorted(at, [base, base + total])
            steps = np.bincount(at[a:b] - base, minlength=total + 1) - np.bincount(until[a:b] - base, minlength=total + 1)
            gone = np.cumsum(steps[:total]) > 0
            raw, sums = part[~gone].tobytes(), np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = own[:-1][own[:-1] < total]
            opens[inner] = gone[inner]
            removed += np.diff(sums[own]).tolist()
            spans += np.diff(np.concatenate([[0], np.cumsum(opens)])[own]).tolist()
            bounds = (own - sums[own]).tolist()
            kept += [raw[i:j] for i, j in zip(bounds, bounds[1:])]
        columns = {
            "doc_id": chunk.ids, "n_bytes": pa.array(np.diff(chunk.offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if with_text:
            columns["kept"] = pa.array(kept, pa.binary())
        return pa.table(columns)

    fields = lambda schema: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)
    answers = dealt.groupBy("chunk").applyInArrow(list_keys, fields(KEYS)).groupBy("bucket").applyInArrow(answer, fields(ANSWERS))
    found = (
        dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(list_runs, fields(RUNS))
        .groupBy("bucket").applyInArrow(sort_runs, fields(FOUND))
    )
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)
