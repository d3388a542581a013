"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import byte_bpe, decontaminate, line_dedup, lm_score, minhash, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup

#: The public rank file that operator 6 and the pipeline use.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words of a passage that line dedup removes although it has less than three lines.
PASSAGE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("print")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = quality_classifier.score(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("print")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_score.score(table(spark, sf_dir, "documents"), held_out, public_tokenizers.path(RANKS))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("print")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.remove_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.remove_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), words=PASSAGE)
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
windows AS (
  SELECT doc_id, pos, [line, lead(line, 1) OVER d, lead(line, 2) OVER d] AS w, lead(pos, 2) OVER d AS last
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows WHERE last IS NOT NULL)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM later, (VALUES (0), (1), (2)) v(i))
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_decontamination, op4_suffix_array, op5_substring_dedup, op6_byte_bpe, op7_lm_score, op8_minhash, op9_line_dedup, op9_line_passages, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": OP9_SQL}
