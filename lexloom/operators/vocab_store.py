"""Vocabularies and merges on disk: Parquet tables, and JSON for other readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import textops as T
from lexloom.operators.bpe import Bpe, renumber
from lexloom.plans.cut import cut


def save(tokenizer: Bpe, path: str) -> None:
    """Write ``vocab`` (token, freq, id) and ``merges`` (rank, l, r, replacement, freq) below ``path``."""
    tokenizer.vocabulary().write.mode("overwrite").parquet(f"{path}/vocab")
    tokenizer.merge_table(tokenizer.state.sparkSession).write.mode("overwrite").parquet(f"{path}/merges")


def load(spark: SparkSession, path: str, mode: str = "word") -> tuple[Bpe, DataFrame]:
    """(tokenizer with its merges, vocabulary with dense ids)."""
    rows = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    return Bpe(mode, merges=[(r.l, r.r) for r in rows], freqs=[r.freq for r in rows]), renumber(spark.read.parquet(f"{path}/vocab"))


def _entries():
    return F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("id", "token"))), lambda e: F.struct(e.getField("token"), e.getField("id"))))


def to_json(vocabulary: DataFrame) -> DataFrame:
    """One row with the map of tokens to ids as JSON; a vocabulary fits one row."""
    return vocabulary.agg(F.to_json(_entries()).alias("token_to_id"))


def save_json(vocabulary: DataFrame, path: str) -> None:
    """Write the map under ``token_to_id`` as pretty JSON below ``path``, in the order of ids."""
    row = vocabulary.agg(F.to_json(F.struct(_entries().alias("token_to_id")), {"pretty": "true"}).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a JSON file, or of a folder with one: ids made dense again, unknown first (added if it is missing)."""
    parsed = F.from_json("value", "token_to_id map<string,bigint>").getField("token_to_id")
    known = spark.read.text(path, wholetext=True).select(F.explode(F.map_concat(F.create_map(F.lit(T.UNK), F.lit(0).cast("long")), F.map_filter(parsed, lambda token, _: token != T.UNK))).alias("token", "id"))
    return cut(renumber(known))
