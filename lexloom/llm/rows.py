"""Rows of a table kept or left by marks, whatever its columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, body_print): each row as a struct, its key and the hash of its text (null counts as empty)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("row"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body_print"))


def marked(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``tagged`` rows joined to marks (doc_id, print, ...); a null key meets a null key."""
    return rows.join(marks, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("body_print") == F.col("print")), how)


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The table's rows that (doc_id, print) names, with all their columns."""
    return marked(tagged(docs), marks.select("doc_id", "print").distinct(), "left_semi").select("row.*")


def without_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The table's rows that (doc_id, print) does not name, with all their columns."""
    return marked(tagged(docs), marks.select("doc_id", "print").distinct(), "left_anti").select("row.*")
