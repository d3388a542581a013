"""Text corpora from files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _lenient(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of a file, or of all .txt files below a folder in the order of their paths; invalid bytes go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.endswith(".txt"):
        files = files.option("pathGlobFilter", "*.txt")
    rows = files.load(path)
    ids = rows.select("path").withColumn("doc_id", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))
    return rows.join(ids, "path").select("doc_id", "path", _lenient("content").alias("text"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Files and characters of the corpus joined by two line feeds."""
    return docs.agg(F.count("*").alias("file_count"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("chars"))


def joined(docs: DataFrame) -> DataFrame:
    """One row (text): the corpus of (doc_id, text) as one text, its files parted by two line feeds in order. A demo corpus fits one row."""
    every = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    return docs.agg(F.array_join(F.transform(every, lambda e: e.getField("text")), "\n\n").alias("text"))
