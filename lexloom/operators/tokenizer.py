"""Tokenizers as objects: a base class to extend, and the word, byte and pre-trained ones.

A subclass says how it trains, tokenizes and detokenizes; ids, unknown tokens and vocabularies
on disk are the base's. Texts are (key, text) tables throughout.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import textops as T
from lexloom.operators import bpe, pretrained, vocab_store


class Tokenizer(ABC):
    """A new one knows the unknown token alone, as id 0."""

    def __init__(self, spark: SparkSession, logger: logging.Logger | None = None):
        self.spark, self.logger = spark, logger or logging.getLogger("lexloom")
        self.vocabulary: DataFrame = spark.createDataFrame([(T.UNK, 0)], "token string, id int")

    @abstractmethod
    def train(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> "Tokenizer":
        """Learn from all texts."""

    @abstractmethod
    def tokenize(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, pos, word, tokens) of every word."""

    @abstractmethod
    def detokenize(self, tokens: Column) -> Column:
        """The text of an array of tokens."""

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, ids); a token that the vocabulary lacks has id 0."""
        return bpe.encode(self.tokenize(docs, key, text), self.vocabulary)

    def decode(self, ids: DataFrame) -> DataFrame:
        """(doc, text) of (doc, ids); an id that the vocabulary lacks raises."""
        return bpe.decode(ids, self.vocabulary).select("doc", self.detokenize(F.col("tokens")).alias("text"))

    def vocab_size(self) -> int:
        return self.vocabulary.count()

    def save_vocab(self, path: str) -> None:
        vocab_store.save_json(self.vocabulary, path)

    def load_vocab(self, path: str) -> "Tokenizer":
        """Take the vocabulary of a JSON file; merges aren't part of it."""
        self.vocabulary = vocab_store.load_json(self.spark, path)
        return self


class BpeTokenizer(Tokenizer):
    """Byte pair encoding; mode is 'word' or 'byte'."""

    def __init__(self, spark: SparkSession, mode: str = "word", num_merges: int | None = None, min_freq: int = 2, logger: logging.Logger | None = None):
        super().__init__(spark, logger)
        self.model = bpe.Bpe(mode, num_merges=num_merges, min_freq=min_freq)

    def train(self, docs, key="doc_id", text="text"):
        self.model.train(docs, key, text)
        self.vocabulary = vocab_store.cut(self.model.vocabulary())
        self.logger.info("%d merges learned", len(self.model.merges))
        return self

    def tokenize(self, docs, key="doc_id", text="text"):
        return self.model.tokenize(docs, key, text)

    def detokenize(self, tokens):
        return bpe.detokenize(tokens, self.model.mode)

    def encode(self, docs, key="doc_id", text="text"):
        return self.model.encode(docs, self.vocabulary, key, text)


class PretrainedTokenizer(Tokenizer):
    """A local file of a pre-trained tokenizer; its vocabulary stays in the file."""

    def __init__(self, spark: SparkSession, path: str, logger: logging.Logger | None = None):
        super().__init__(spark, logger)
        self.model = pretrained.Pretrained(spark, path)

    def train(self, docs, key="doc_id", text="text"):
        self.model.train()
        return self

    def tokenize(self, docs, key="doc_id", text="text"):
        """(doc, pos, word, tokens): the whole text is one word."""
        return docs.select(F.col(key).alias("doc"), F.lit(0).alias("pos"), F.col(text).alias("word"), self.model.tokenize(F.col(text)).alias("tokens"))

    def detokenize(self, tokens):
        return pretrained.detokenize(tokens)

    def encode(self, docs, key="doc_id", text="text"):
        return docs.select(F.col(key).alias("doc"), self.model.encode(F.col(text)).alias("ids"))

    def decode(self, ids):
        return ids.select("doc", self.model.decode(F.col("ids")).alias("text"))

    def vocab_size(self):
        return self.model.vocab_size()
