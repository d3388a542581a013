"""The corpus pipeline: documents in, clean documents encoded.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
``documents``, and further columns of the table too, whatever they are called; rows equal in id
and text stay or go together, and an empty table stays empty. ``run`` writes what each stage
returns and hands the next one the table read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import byte_bpe, decontaminate, line_dedup, minhash, quality_rules, staging
from lexloom.llm.queries import PASSAGE, RANKS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines, long lines and whole texts go from the texts; no document does.

    Null texts stay null; ``n_chars``, where the table has it, follows a text that was cut.
    """
    cut = line_dedup.cut_rows(docs, words=PASSAGE)
    row = F.col("row")
    if "n_chars" in docs.columns:
        length = F.length(row.getField("text")).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(row.getField("n_chars")))
    return cut.select(row.alias("row")).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; texts without words are near to nothing and stay."""
    return minhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document that is left; null texts count as empty."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", encode_stage),
]

#: Robust estimates, sketches and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
