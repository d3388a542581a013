"""What the two substring operators share: dealing documents and window minima.

Any ``length`` consecutive items (bytes or words) hold ``span = length - gram + 1``
short grams. The least gram hash of a window depends on its content alone, so
equal windows have equal minima: the minimum is a sound key for finding them.
Documents are dealt once into chunks; both uses of the dealt table have the same
exchange, which Spark runs once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytesets import Rolling, flat, sliding_min

NONE = np.uint64(0)


def deal(docs: DataFrame, parts: int, key: str, text: str) -> DataFrame:
    """Columns chunk, doc_id, body, print: rows dealt by a hash of (key, text), nulls as empty texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.pmod(F.xxhash64(F.col(key), body), F.lit(parts)).cast("int").alias("chunk"),
        F.col(key).alias("doc_id"),
        body.alias("body"),
        F.xxhash64(body).alias("print"),
    )


class Chunk:
    """The documents of one chunk in an order that doesn't depend on how they arrived."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        prints = table.column("print").to_numpy()
        if pa.types.is_integer(ids.type):
            tie = [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)]
        else:
            tie = [np.array([str(x) for x in ids.to_pylist()])]
        self.order = np.lexsort([*tie, prints])
        order = pa.array(self.order)
        self.ids = ids.take(order)
        body = table.column("body").combine_chunks()
        self.data, self.offsets = flat(body.cast(pa.large_string()).take(order))
        pa.default_memory_pool().release_unused()


def minima(items: np.ndarray, borders: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, least gram hash of each window start); windows over a border get NONE."""
    grams = Rolling(items, 2).windows(gram) | np.uint64(1)
    least = sliding_min(grams, length - gram + 1)
    if len(least):
        step = np.zeros(len(least) + 1, np.int32)
        ends = borders[1:]
        bad = np.maximum(ends - length + 1, borders[:-1])  # starts from here to the sequence's end run over it
        np.add.at(step, np.minimum(bad, len(least)), 1)
        np.add.at(step, np.minimum(ends, len(least)), -1)
        least = least.copy()
        least[np.cumsum(step[:-1]) > 0] = NONE
    return grams, least


def chosen(grams: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Places of the grams that are the minimum of some window."""
    if not len(least):
        return np.zeros(0, np.int64)
    room = np.full(span - 1, ~NONE)
    most = ~sliding_min(np.concatenate([room, ~least, room]), span)
    return np.flatnonzero(grams[: len(most)] == most)


def split_by(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) for each bucket that occurs."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    values = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return [(int(values[a]), order[a:b]) for a, b in zip(heads, [*heads[1:], len(order)])]


def blob_rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    """A table of rows."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def joined(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many of each row) of a column of packed arrays."""
    parts = [np.frombuffer(x or b"", dtype) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)
