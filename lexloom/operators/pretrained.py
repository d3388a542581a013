"""Adapter over a local file of a pre-trained tokenizer, as vectorised functions.

The file (a vocabulary, some megabytes) is read once and sent to the executors, which
need no copy of it. Nothing is downloaded.
"""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("lexloom")

#: Short names of published models and the one meant by an empty name.
MODELS = {
    "qwen3-0.6b": "Qwen/Qwen3-0.6B",
    "qwen3-1.7b": "Qwen/Qwen3-1.7B",
    "qwen3-4b": "Qwen/Qwen3-4B",
    "qwen3-8b": "Qwen/Qwen3-8B",
    "qwen3-14b": "Qwen/Qwen3-14B",
    "qwen3-32b": "Qwen/Qwen3-32B",
    "qwen3-30b-a3b": "Qwen/Qwen3-30B-A3B",
    "qwen3-next": "Qwen/Qwen3-Next-80B-A3B-Instruct",
    "qwen3.5-plus": "Qwen/Qwen3.5-397B-A17B",
}
DEFAULT = "qwen3.5-plus"
#: A larger file is refused rather than broadcast.
MOST_BYTES = 256 << 20

_loaded: dict[str, object] = {}


def resolve(name: str | None, folder: str) -> str:
    """The tokenizer.json of a model below ``folder``; a path to a file stands for itself."""
    name = name or DEFAULT
    if os.path.isfile(name):
        return name
    path = os.path.join(folder, MODELS.get(name, name), "tokenizer.json")
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return path


class Pretrained:
    """tokenize, encode and decode as column expressions; training does nothing."""

    def __init__(self, spark: SparkSession, path: str):
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.here = _parse(text)
        self._shared, self._name = spark.sparkContext.broadcast(text), uuid.uuid4().hex

    def train(self, *_, **__) -> "Pretrained":
        log.warning("a pre-trained tokenizer is not trained")
        return self

    def vocab_size(self) -> int:
        return self.here.get_vocab_size()

    def _each(self, kind: str, work: Callable) -> Callable[[Column], Column]:
        shared, name = self._shared, self._name

        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            if name not in _loaded:  # once a worker
                _loaded[name] = _parse(shared.value)
            return pd.Series([None if v is None else work(_loaded[name], v) for v in values], dtype=object)

        return run

    def tokenize(self, text: Column) -> Column:
        """Token strings; null stays null."""
        return self._each("array<string>", lambda t, v: t.encode(v).tokens)(text)

    def encode(self, text: Column) -> Column:
        return self._each("array<int>", lambda t, v: t.encode(v).ids)(text)

    def decode(self, ids: Column) -> Column:
        return self._each("string", lambda t, v: t.decode([int(i) for i in v]))(ids)


def detokenize(tokens: Column) -> Column:
    """Token strings joined as they are."""
    return F.array_join(tokens, "")


def _parse(text: str):
    from tokenizers import Tokenizer  # only this adapter needs the library

    return Tokenizer.from_str(text)
