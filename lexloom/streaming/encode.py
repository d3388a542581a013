"""Texts that arrive as a stream, encoded by a trained tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.bpe import Bpe


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that come to lie in ``folder``, a bounded number of them at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def encode_stream(documents: DataFrame, model: Bpe, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ids) of a stream of texts. Encoding needs no state: each text is encoded as in a batch."""
    return model.encode(documents, vocabulary, key, text)


def write_ids(encoded: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append (doc, ids) to Parquet files until all that is there has been read; with the checkpoint each text comes out once."""
    return encoded.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
