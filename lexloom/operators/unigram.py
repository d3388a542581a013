"""Unigram sub-word model: n-gram candidates, hard EM with Viterbi segmentation, pruning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import textops as T
from lexloom.plans.cut import cut


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, sentence) of every line that isn't empty."""
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    return lines.select("doc", "line", T.sentence(F.col("raw")).alias("sentence")).where("sentence <> ''")


def ngrams(lines: DataFrame, longest: int = 6) -> DataFrame:
    """(piece, freq, doc, line, place, size): substrings of 1..longest characters with first places."""
    at = F.explode(F.sequence(F.lit(1), F.length("sentence")))
    starts = lines.select("doc", "line", "sentence", at.alias("place"))
    sizes = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("sentence") - F.col("place") + 1))).alias("size"))
    pieces = sizes.select("doc", "line", "place", "size", F.substring("sentence", F.col("place"), F.col("size")).alias("piece"))
    counted = pieces.groupBy("piece").agg(F.count("*").alias("freq"), F.min(F.struct("doc", "line", "place", "size")).alias("first"))
    return counted.select("piece", "freq", "first.*")


def initial_pieces(grams: DataFrame, most: int) -> DataFrame:
    """(piece, ord): characters by first place, then candidates by frequency (ties by first place), ``most`` in all."""
    one = F.length("piece") == 1
    order = [F.when(one, 0).otherwise(1), F.when(one, 0).otherwise(-F.col("freq")), F.col("doc"), F.col("line"), F.col("place"), F.col("size")]
    first = grams.orderBy(*order).limit(most)  # every task hands on ``most`` rows at most
    return first.withColumn("ord", F.row_number().over(Window.orderBy(*order))).select("piece", "ord")


def viterbi(text: str, cost: dict[str, float], longest: int) -> list[str]:
    """Cheapest pieces; ties keep the longest last piece; characters if the end can't be reached."""
    n = len(text)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            if (price := cost.get(text[start:end])) is not None and best[start] + price < best[end]:
                best[end], back[end] = best[start] + price, start
    if n and best[n] == math.inf:
        return list(text)
    out = []
    while n:
        out.append(text[back[n] : n])
        n = back[n]
    return out[::-1]


def segment(lines: DataFrame, costs: dict[str, float], longest: int = 6) -> DataFrame:
    """Add pieces to (doc, line, sentence); the costs (vocab_size pieces) are broadcast."""
    given = lines.sparkSession.sparkContext.broadcast(costs)

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: viterbi(t, given.value, longest))

    return lines.withColumn("pieces", run("sentence"))


def prune(pieces: DataFrame, freq: DataFrame, size: int) -> DataFrame:
    """(piece, ord, freq): base characters first, then by frequency and shortness, ``size`` in all."""
    one = F.length("piece") == 1
    scored = pieces.join(freq, "piece", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    order = Window.orderBy(F.when(one, 0).otherwise(1), F.when(one, F.col("ord")), F.desc("freq"), F.length("piece"), "ord")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("piece", F.col("rank").alias("ord"), "freq")


def rescore(pieces: DataFrame) -> DataFrame:
    """Cost -ln(freq / total) of each piece; absent ones count once in both."""
    n = F.greatest(F.col("freq"), F.lit(1))
    return pieces.select("piece", "ord", "freq", (-F.log(n / F.sum(n).over(Window.partitionBy()))).alias("cost"))


@dataclass
class Unigram:
    """Trainer; costs holds the model's pieces."""

    vocab_size: int = 8000
    longest: int = 6
    pruning_factor: int = 2
    em_steps: int = 5
    costs: dict[str, float] | None = None

    def train(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> "Unigram":
        lines = cut(sentences(docs, key, text))
        pieces = cut(initial_pieces(ngrams(lines, self.longest), self.vocab_size * self.pruning_factor))
        names = [r.piece for r in pieces.collect()]  # vocab_size * pruning_factor at most
        if not names:
            raise ValueError("the corpus is empty")
        self.costs = dict.fromkeys(names, math.log(len(names)))
        for _ in range(self.em_steps):
            used = segment(lines, self.costs, self.longest).select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("freq"))
            scored = cut(rescore(prune(pieces, used, self.vocab_size)))
            pieces, self.costs = scored.select("piece", "ord"), {r.piece: r.cost for r in scored.collect()}
        return self

    def tokenize(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        if self.costs is None:
            raise ValueError("the model isn't trained")
        return segment(sentences(docs, key, text), self.costs, self.longest)
