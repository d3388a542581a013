"""Token streams, shifted windows and batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.plans.cut import cut
from lexloom.sources import corpus


#: Documents whose lengths are summed up in order at once.
GROUP = 10_000


def token_stream(ids: DataFrame) -> DataFrame:
    """(pos, id) of the concatenated arrays of (doc, ids), in the order of doc.

    Places come from sums in two levels: documents are dealt into ranges by doc, lengths are summed
    up inside each range, and only the ranges' totals (one row for each GROUP documents or so) in one task.
    """
    sizes = ids.select("doc", F.size("ids").cast("long").alias("n"))
    parts = max(1, -(-sizes.count() // GROUP))
    ranged = cut(sizes.repartitionByRange(parts, "doc").withColumn("part", F.spark_partition_id()))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.select("doc", "part", inside.alias("inside")).join(before, "part").select("doc", (F.col("base") + F.col("inside")).alias("start"))
    return ids.join(starts, "doc").select("start", F.posexplode("ids").alias("i", "id")).select((F.col("start") + F.col("i")).alias("pos"), "id")


def windows(stream: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """(start, x, y) of each start: ``block`` ids and the same shifted by one. A window lies in two buckets, so one join does."""
    bucketed = stream.groupBy(F.floor(F.col("pos") / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("v")).select("b", F.transform("v", lambda v: v.getField("id")).alias("v"))
    after = bucketed.select((F.col("b") - 1).alias("b"), F.col("v").alias("w"))
    both = bucketed.join(after, "b", "left").withColumn("v", F.concat("v", F.coalesce("w", F.array().cast("array<int>"))))
    at = starts.withColumn("b", F.floor(F.col("start") / block)).join(both, "b")
    offset = (F.col("start") - F.col("b") * block).cast("int")
    cut = at.select("start", F.slice("v", offset + 1, block).alias("x"), F.slice("v", offset + 2, block).alias("y"))
    return cut.where(F.size("y") == block)


def token_range(stream: DataFrame, first: int, end: int) -> DataFrame:
    """One row with the ids of first <= pos < end; a range is cut to fit one row. Negative places count from the stream's end."""
    if first < 0 or end < 0:
        size = (stream.agg(F.max("pos")).first()[0] or -1) + 1
        first, end = (max(0, place + size) if place < 0 else place for place in (first, end))
    part = stream.where(F.col("pos").between(first, end - 1)).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("v"))
    return part.select(F.transform("v", lambda v: v.getField("id")).alias("ids"))


def strided_starts(stream: DataFrame, block: int, stride: int) -> DataFrame:
    """Every stride-th start of a whole window."""
    return stream.where(F.col("pos") % stride == 0).select(F.col("pos").alias("start"))


def random_starts(n_tokens: int, block: int, batch: int, seed: int = 1337) -> list[int]:
    """Starts of a batch, with replacement."""
    if n_tokens < block + 1:
        raise ValueError("the dataset is shorter than a block")
    return np.random.RandomState(seed).randint(0, n_tokens - block, batch).tolist()


def ensure_trained(tokenizer, docs: DataFrame) -> None:
    """Train a tokenizer that knows no more than the unknown token."""
    if tokenizer.vocab_size() <= 1:
        tokenizer.train(docs)


class TextDataset:
    """The token ids of a text, or of the text files at a path, as a stream.

    Blank input without a path is an error. With ``auto_train`` a tokenizer that knows nothing yet
    learns from the same corpus first.
    """

    def __init__(self, tokenizer, text: str | None = None, path: str | None = None, block_size: int = 128, auto_train: bool = True):
        if not (text or "").strip() and not (path or "").strip():
            raise ValueError("give a text or a path")
        self.tokenizer, self.block_size, spark = tokenizer, block_size, tokenizer.spark
        self.docs = spark.createDataFrame([(0, text)], "doc_id bigint, text string") if text is not None else cut(corpus.read_texts(spark, path))
        if auto_train:
            ensure_trained(tokenizer, self.docs)
        self.stream = cut(token_stream(tokenizer.encode(self.docs)))

    def __len__(self) -> int:
        return self.stream.count()

    def __getitem__(self, places: slice) -> list[int]:
        """The ids of a range; negative places count from the end."""
        end = places.stop if places.stop is not None else len(self)
        return token_range(self.stream, places.start or 0, end).first().ids

    def windows(self, stride: int | None = None) -> DataFrame:
        """(start, x, y) of every stride-th window of block_size ids."""
        return windows(self.stream, strided_starts(self.stream, self.block_size, stride or self.block_size), self.block_size)
