"""Deal small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A small file may be a single row group, which one task reads whole. Inputs of more than
    32 MB a core are split well enough by their own row groups and stay as they are, so what
    this shuffles is bounded by the cluster and not by the data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (32 << 20) else df
