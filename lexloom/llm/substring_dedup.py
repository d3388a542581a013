"""Substring dedup: a merged count-min sketch, then exact groups of what it can't rule out.

A window is ``length`` consecutive words. First every partition fills a sketch with
the grams that are minima of windows; the merged sketch overestimates how often a
minimum occurs, and so how often any window with that minimum does. The sketch has
a fixed size, so it can be broadcast. The second pass groups exactly, by two 61-bit
hashes modulo a prime under different bases, the windows estimated to occur twice or
more: first whole runs of windows with one minimum, then the single windows of runs whose minimum occurs again in
another run. None that repeats is lost, and collisions in the sketch only add runs.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytesets import Prefix, blocks, cover, expand, flat, mix, words
from lexloom.llm.staging import parts_for
from lexloom.llm.windows import NONE, Chunk, blob_rows, chosen, deal, joined, minima, split_by

#: Bytes of input (as stored) in a chunk.
CHUNK = 4 << 20
#: Words of a gram whose hash can be a window's minimum.
GRAM = 8
#: Counters in each of the sketch's two rows, and the sections in which it is merged.
WIDTH, SECTIONS = 1 << 24, 64


class Sketch:
    """A count-min sketch of two rows whose counters stop at 2."""

    def __init__(self, counters: np.ndarray | None = None):
        self.counters = np.zeros((2, WIDTH), np.uint8) if counters is None else counters

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # keys are minima and so mostly small: mixed, they spread over all counters
        return tuple((mix(keys ^ np.uint64(salt)) >> np.uint64(40)).astype(np.int64) % WIDTH for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))

    def add(self, keys: np.ndarray) -> None:
        for row, place in zip(self.counters, self.places(keys)):
            at, n = np.unique(place, return_counts=True)
            row[at] = np.minimum(2, row[at] + np.minimum(n, 2)).astype(np.uint8)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may have come twice."""
        a, b = self.places(keys)
        return (self.counters[0][a] >= 2) & (self.counters[1][b] >= 2)

    @staticmethod
    def pack(counters: np.ndarray) -> bytes:
        return zlib.compress(np.packbits(np.stack([counters >= 1, counters >= 2])).tobytes(), 1)

    @staticmethod
    def unpack(blob: bytes, n: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8))
        return bits[:n] + bits[n : 2 * n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    starts, ends, first = words(data, offsets)
    return Prefix(data, salt).ranges(starts, ends), starts, ends, first


def sketch_of(docs: DataFrame, text: str, length: int) -> Sketch:
    """The merged sketch of all windows' minima. What reaches the driver has a fixed size."""
    size = 2 * WIDTH // SECTIONS

    def fill(batches):
        sketch = Sketch()
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for row, end in blocks(offsets):
                part, own = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
                hashes, _, _, first = word_hashes(part, own, 0)
                grams, least = minima(hashes, first, length, GRAM)
                sketch.add(grams[chosen(grams, least, length - GRAM + 1)])
        cells = sketch.counters.reshape(SECTIONS, size)
        used = [i for i in range(SECTIONS) if cells[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([Sketch.pack(cells[i]) for i in used], pa.binary())], ["section", "cells"])

    def merge(batches):
        at, total = None, None
        for batch in batches:
            for section, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if section != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([Sketch.pack(total)], pa.binary())], ["section", "cells"])
                    at, total = section, np.zeros(size, np.uint8)
                total = np.minimum(2, total + Sketch.unpack(cells.as_py(), size)).astype(np.uint8)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([Sketch.pack(total)], pa.binary())], ["section", "cells"])

    kind = "section int, cells binary"
    parts = docs.select(text).mapInArrow(fill, kind)
    merged = parts.repartition(SECTIONS, "section").sortWithinPartitions("section").mapInArrow(merge, kind)
    cells = np.zeros((SECTIONS, size), np.uint8)
    for row in merged.collect():  # at most SECTIONS rows, 8 MB before compression
        cells[row.section] = Sketch.unpack(row.cells, size)
    return Sketch(cells.reshape(2, WIDTH))


#: A minimum with more different runs than this in one chunk skips the grouping of runs.
MANY = 64

RUNS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("first", pa.binary()), ("second", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("twice", pa.binary()), ("open", pa.binary()), ("done", pa.binary())])
STATES = pa.schema([("chunk", pa.int32()), ("open", pa.binary()), ("done", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("at", pa.binary()), ("done", pa.binary())])
FOUND = pa.schema([("chunk", pa.int32()), ("at", pa.binary())])
#: Stands for "no answer is needed".
NOWHERE = 0xFFFFFFFF


def equal_groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorting order, heads of the groups of equal rows in it, their sizes)."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    heads = np.flatnonzero(new)
    return order, heads, np.diff(np.append(heads, len(order)))


def pairs_of(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ranges as packed (first, count)."""
    return np.stack([at, n], 1).astype("<u4").tobytes()


def remove_repeats(docs: DataFrame, length: int = 35, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window whose words also start elsewhere in the corpus.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and,
    on request, kept (that text). Windows never cross documents and are judged on the input.
    Null and empty texts have no words; repeated rows repeat each other's windows; tables with
    fewer words than a window come back whole; other columns aren't read. A window that many
    documents share reaches its group once from each chunk.
    """
    spark = docs.sparkSession
    parts = parts_for(docs, CHUNK)
    sketch = spark.sparkContext.broadcast(sketch_of(docs, text, length).counters)
    dealt = deal(docs, parts, key, text)

    def parts_of(chunk):
        base = 0
        for row, end in blocks(chunk.offsets):
            part, own = chunk.data[chunk.offsets[row] : chunk.offsets[end]], chunk.offsets[row : end + 1] - chunk.offsets[row]
            hashes, starts, ends, first = word_hashes(part, own, 0)
            yield base, part, hashes, starts, ends, first
            base += len(starts)

    def list_runs(key_row, table):
        """Runs of windows with one minimum, where the sketch allows a repeat."""
        chunk, known, found = Chunk(table), Sketch(sketch.value), [[] for _ in range(6)]
        for base, part, hashes, starts, ends, first in parts_of(chunk):
            grams, least = minima(hashes, first, length, GRAM)
            if not len(least):
                continue
            heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            sizes = np.diff(np.append(heads, len(least)))
            good = least[heads] != NONE
            good[good] = known.repeated(least[heads[good]])
            heads, sizes = heads[good], sizes[good]
            if len(heads):
                other = Prefix(part, 1).ranges(starts, ends)
                stops = heads + sizes + length - 1
                spans = sizes + length - GRAM  # grams of the run; its minimum twice among them: the run may repeat itself
                equal = grams[expand(heads, spans)] == np.repeat(least[heads], spans)
                times = np.add.reduceat(equal.astype(np.int32), np.cumsum(spans) - spans)
                for column, values in zip(found, (least[heads], Prefix(hashes, 0).ranges(heads, stops), Prefix(other, 1).ranges(heads, stops), heads + base, sizes, times > 1)):
                    column.append(values)
        own = key_row[0].as_py()
        if not found[0]:
            return blob_rows(RUNS, [])
        keys, h1, h2, at, n, folded = (np.concatenate(c) for c in found)
        order, heads, counts = equal_groups(keys, h1, h2, n)
        many = np.repeat(counts > 1, counts)  # these repeat here
        done = pairs_of(at[order[many]], n[order[many]])
        chief, twice = order[heads], counts > 1
        group = np.flatnonzero(np.concatenate([[True], keys[chief][1:] != keys[chief][:-1]]))
        size = np.diff(np.append(group, len(chief)))
        crowd = np.repeat(size > MANY, size)
        alone = chief[crowd | (folded[chief] & ~twice)]
        open_ = pairs_of(at[alone], n[alone])
        rows = [(own % parts, own, *[None] * 6, open_, done)]
        speaks = ~crowd
        speaks[group[size > MANY]] = True  # one row says that the minimum occurs
        crowd_head = crowd[speaks]
        chief, twice = chief[speaks], twice[speaks] | crowd_head
        place = at[chief].astype("<u4")
        for bucket, w in split_by(((keys[chief] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)):
            rows.append((bucket, own, keys[chief[w]].tobytes(), h1[chief[w]].tobytes(), h2[chief[w]].tobytes(), place[w].tobytes(), n[chief[w]].astype("<u4").tobytes(), (twice[w] * 1 + crowd_head[w] * 1).astype(np.uint8).tobytes(), None, None))
        return blob_rows(RUNS, rows)

    def group_runs(table):
        """Equal runs repeat whole; other runs whose minimum occurs again stay open."""
        keys, count = joined(table.column("keys"), "<u8")
        h1, h2 = joined(table.column("first"), "<u8")[0], joined(table.column("second"), "<u8")[0]
        at, n, twice = (joined(table.column(c), d)[0] for c, d in (("at", "<u4"), ("n", "<u4"), ("twice", "u1")))
        chunks = np.repeat(table.column("chunk").to_numpy(), count)
        # a row that only says that a minimum occurs (twice = 2) equals no run
        order, heads, counts = equal_groups(keys, h1, h2, n, np.where(twice == 2, np.arange(len(keys)) + 1, 0))
        label = np.empty(len(order), np.int64)
        label[order] = np.repeat(np.arange(len(heads)), counts)
        whole = ((counts > 1) | (np.bincount(label, twice == 1, len(heads)) > 0))[label]
        chief = np.zeros(len(order), bool)
        chief[order[heads]] = True
        # minima with different runs: those that don't repeat whole are open, and one of each that does stands by them
        group = np.unique(keys, return_inverse=True)[1]
        mixed = (np.bincount(group, chief) > 1)[group]
        open_mask = mixed & (twice != 2) & np.where(whole, chief, True)
        done_mask = whole & (twice == 0)
        rows = []
        for c, w in split_by(chunks):
            open_, done = w[open_mask[w]], w[done_mask[w]]
            rows.append((c, pairs_of(at[open_], n[open_]), pairs_of(at[done], n[done])))
        rows += [x for x in zip(table.column("chunk").to_pylist(), table.column("open").to_pylist(), table.column("done").to_pylist()) if x[1] or x[2]]
        return blob_rows(STATES, rows)

    def list_windows(key_row, left, right):
        """Single windows of the open runs."""
        chunk, own = Chunk(left), key_row[0].as_py()
        open_, done = (joined(right.column(c), "<u4")[0].reshape(-1, 2).astype(np.int64) for c in ("open", "done"))
        rows = [(own % parts, own, None, None, None, done.astype("<u4").tobytes())] if len(done) else []
        open_ = np.unique(open_, axis=0)  # a run can be open for two reasons
        h1, h2, at = [], [], []
        for base, part, hashes, starts, ends, first in parts_of(chunk) if len(open_) else ():
            a, b = np.searchsorted(open_[:, 0], [base, base + len(starts)])
            if a < b:
                where = expand(open_[a:b, 0] - base, open_[a:b, 1])
                h1.append(Prefix(hashes, 0).ranges(where, where + length))
                h2.append(Prefix(Prefix(part, 1).ranges(starts, ends), 1).ranges(where, where + length))
                at.append(where + base)
        if h1:
            h1, h2, at = np.concatenate(h1), np.concatenate(h2), np.concatenate(at)
            order, heads, counts = equal_groups(h1, h2)
            many = order[np.repeat(counts > 1, counts)]
            rows.append((own % parts, own, None, None, None, pairs_of(at[many], np.ones(len(many)))))
            h1, h2 = h1[order[heads]], h2[order[heads]]
            at = np.where(counts > 1, NOWHERE, at[order[heads]]).astype("<u4")
            for bucket, w in split_by(((h1 >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)):
                rows.append((bucket, own, h1[w].tobytes(), h2[w].tobytes(), at[w].tobytes(), None))
        return blob_rows(WINDOWS, rows)

    def group_windows(table):
        h1, count = joined(table.column("first"), "<u8")
        h2, at = joined(table.column("second"), "<u8")[0], joined(table.column("at"), "<u4")[0]
        order, heads, counts = equal_groups(h1, h2)
        hit = order[np.repeat(counts > 1, counts)]
        hit = hit[at[hit] != NOWHERE]
        rows = [(c, pairs_of(at[hit[w]], np.ones(len(w)))) for c, w in split_by(np.repeat(table.column("chunk").to_numpy(), count)[hit])]
        rows += [x for x in zip(table.column("chunk").to_pylist(), table.column("done").to_pylist()) if x[1]]
        return blob_rows(FOUND, rows)

    def finish(left, right):
        chunk = Chunk(left)
        hits = joined(right.column("at"), "<u4")[0].reshape(-1, 2).astype(np.int64)
        hits = hits[np.argsort(hits[:, 0])]
        n_words, n_removed, digests, texts, base = [], [], [], [], 0
        for row, end in blocks(chunk.offsets):
            part, own = chunk.data[chunk.offsets[row] : chunk.offsets[end]], chunk.offsets[row : end + 1] - chunk.offsets[row]
            starts, ends, first = words(part, own)
            a, b = np.searchsorted(hits[:, 0], [base, base + len(starts)])
            gone = cover(hits[a:b, 0] - base, hits[a:b, 1] + length - 1, len(starts))
            base += len(starts)
            kept = np.flatnonzero(~gone)
            sizes = ends[kept] - starts[kept] + 1
            stops = np.cumsum(sizes)
            bytes_kept = np.append(part, np.uint8(32))[expand(starts[kept], sizes)] if len(kept) else part[:0]
            bytes_kept[stops - 1] = 32
            bounds = np.searchsorted(kept, first)
            cuts = np.concatenate([[0], stops])[bounds]
            n_words += np.diff(first).tolist()
            n_removed += (np.diff(first) - np.diff(bounds)).tolist()
            raw = bytes_kept.tobytes()
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                out = raw[i : j - 1] if j > i else b""
                digests.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    texts.append(out)
        columns = {"doc_id": chunk.ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            columns["kept"] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.table(columns)

    fields = lambda schema: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)
    states = dealt.groupBy("chunk").applyInArrow(list_runs, fields(RUNS)).groupBy("bucket").applyInArrow(group_runs, fields(STATES))
    found = (
        dealt.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(list_windows, fields(WINDOWS))
        .groupBy("bucket").applyInArrow(group_windows, fields(FOUND))
    )
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)
