"""Matrices of a fixed size, summed over all partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Blocks at least into which a matrix is cut, so that no few tasks add up what all have.
PARTS = 64


def total_blocks(rows: DataFrame, make, n_rows: int, n_columns: int) -> np.ndarray:
    """Sum over all partitions of an n_rows x n_columns matrix; make(batches) gives a partition's.

    Partitions' matrices are added up block by block on the executors; the driver gets the sum,
    whose size depends on the benchmark alone.
    """
    block = max(1, min((1 << 17) // n_columns, -(-n_rows // PARTS)))
    spec = "part int, cells binary"

    def fill(batches):
        total = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(0, n_rows, block), pa.int32()), pa.array([total[a : a + block].astype("<f8").tobytes() for a in range(0, n_rows, block)], pa.binary())], ["part", "cells"])

    def add(batches):
        at, total = None, None
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = np.frombuffer(cells.as_buffer(), "<f8")
                if part == at:
                    total = total + cells
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "cells"])
                at, total = part, cells
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "cells"])

    partial = rows.mapInArrow(fill, spec)
    parts = partial.repartition(-(-n_rows // block), "part").sortWithinPartitions("part").mapInArrow(add, spec).collect()
    out = np.zeros((n_rows, n_columns))
    for row in parts:
        cells = np.frombuffer(row.cells, "<f8").reshape(-1, n_columns)
        out[row.part : row.part + len(cells)] = cells
    return out


def sorted_sum(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by an index that never falls."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        heads = np.flatnonzero(np.concatenate([[True], np.diff(index) != 0]))
        out[index[heads]] = np.add.reduceat(values, heads, axis=0)
    return out
